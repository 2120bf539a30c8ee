"""Scores of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(targets: DataFrame, ranked: DataFrame, cutoff: int) -> DataFrame:
    """A16, E1 per query: targets, hits within the cutoff, recall, complete, reciprocal rank of the first hit."""
    found = targets.join(ranked.filter(F.col("rank") <= cutoff), ["query", "doc"], "left")
    return found.groupBy("query").agg(
        F.count("*").alias("targets"),
        F.count("rank").alias("hits"),
        F.round(F.count("rank") / F.count("*"), 6).alias("recall"),
        (F.count("rank") == F.count("*")).alias("complete"),
        F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def micro_macro(metrics: DataFrame) -> DataFrame:
    """Recall over all targets, mean recall, mean reciprocal rank."""
    return metrics.agg(
        F.count("*").alias("queries"),
        F.round(F.sum("hits") / F.sum("targets"), 6).alias("micro_recall"),
        F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
    )


def nonzero_fraction(rows: DataFrame, value: str) -> DataFrame:
    """E5: the share of rows whose value is not zero (a precision above zero counts as one)."""
    return rows.agg(F.round(F.avg((F.coalesce(value, F.lit(0)) != 0).cast("int")), 6).alias("nonzero_fraction"))


def gate(summary: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Which metrics of a one-row summary fail; a missing one fails."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(F.col(m) < t, F.lit(True)), F.lit(m)) for m, t in thresholds.items()]))
    return summary.select(F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


def group_holdout(rows: DataFrame, group: str, ratio: float) -> DataFrame:
    """Mark the rows of the last max(1, round(n ratio)) groups in order."""
    groups = rows.select(group).distinct()
    n = groups.count()
    held = groups.orderBy(F.desc(group)).limit(max(1, round(n * ratio))) if n else groups
    held = held.withColumn("_held", F.lit(True))
    return rows.join(held, group, "left").withColumn("holdout", F.coalesce("_held", F.lit(False))).drop("_held")
