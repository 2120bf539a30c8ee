"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Returns (node, label). Each round joins the edges with the labels of one end, takes the
    minimum per other end (a partial aggregate, so a hub sends one row per task), then
    replaces a label by its own label. Rounds stop when no label changes; only that count
    reaches the driver. Null ends are ignored; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    both = materialize(pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low"))
    labels = materialize(labels.select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        former = labels
        offers = (
            both.join(labels.withColumnRenamed("node", "x"), "x")
            .groupBy(F.col("y").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        step = labels.join(offers, "node", "left").select("node", "label", F.least("label", F.coalesce("offer", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        discard(former)
        changed = step.filter("next <> label").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            discard(both)
            return labels
        labels._table_path = step._table_path
