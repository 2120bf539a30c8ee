"""A stream into a table that a crash at any point neither doubles nor loses rows of."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from filigree.session import spare_name


def folder_of(root: str, settings: dict) -> str:
    """The folder of a run with these settings: other settings start anew, the same ones go on where they stopped."""
    return f"{root}/{hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def batch_writer(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: of each key its first batch's row is written, into a folder of the batch's number.

    A batch that comes again after a crash, with the same number and rows, replaces its own folder, whether that was
    written whole, in part or not at all; it looks only at batches before it, so what it wrote itself does not
    hide its rows. Of rows with one key within a batch any one stays. A null key is a key.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, spare_name(batch, "_batch")
        new = batch.dropDuplicates(key)
        if _exists(spark, path):
            before = read_batches(spark, path, batch).filter(F.col(name) < number).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
            same = [new[k].eqNullSafe(before[f"_k{i}"]) for i, k in enumerate(key)]
            new = new.join(before, same, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/{name}={number}")

    return write


def read_batches(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table that ``batch_writer`` wrote from rows like ``like``, with the number of each row's batch as a last column."""
    name = spare_name(like, "_batch")
    return spark.read.schema(StructType([*like.schema.fields, StructField(name, LongType())])).parquet(path)


def sink(stream: DataFrame, root: str, key: list[str], settings: dict | None = None) -> StreamingQuery:
    """Write all that is there of ``stream`` under ``root``, once per key; started again it goes on after the last whole batch.

    Spark's checkpoint holds the batches' ranges of the source and which are done, the folders hold what was written.
    Between the writing of a batch and its entry as done a crash is harmless, see ``batch_writer``.
    """
    folder = folder_of(root, settings or {})
    writer = stream.writeStream.foreachBatch(batch_writer(f"{folder}/table", key))
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
