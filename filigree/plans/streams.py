"""Queries that read a table as a stream into a resumable sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from filigree.plans.registry import query
from filigree.session import load_table, tables_root
from filigree.streaming import sinks


@query("s19_stream_sink", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_sink(s: SparkSession, d: str) -> DataFrame:
    """The kinds of events of each user, once each, through a sink that is started twice."""
    root = f"{tables_root(s)}/tables/sink-{uuid.uuid4().hex}"
    like = load_table(s, d, "events").select("user_id", "event_type")
    # a pattern, as a stream reads folders and patterns, not single files
    stream = s.readStream.schema(load_table(s, d, "events").schema).parquet(f"{d}/events.parque[t]").select(*like.columns)
    for _ in range(2):
        sinks.sink(stream, root, like.columns).awaitTermination()
    return sinks.read_batches(s, f"{sinks.folder_of(root, {})}/table", like).select(*like.columns)
