"""Streaming forms (an extension): request rates and incremental lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.versions import version_chain


def request_rate(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per window and key; the same plan runs on a batch and on a stream."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    counted = rows.groupBy(F.window("_at", window).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def refresh_lineage(batch: DataFrame, known: DataFrame, event: str, at: str, key: str) -> DataFrame:
    """Chains of the events that a micro-batch touches, over known and new rows (for foreachBatch)."""
    touched = batch.select(event).distinct()
    rows = known.join(touched, event, "left_semi").unionByName(batch).dropDuplicates([key])
    return version_chain(rows, event, at, key)
