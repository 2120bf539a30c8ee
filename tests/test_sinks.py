"""A sink that is killed between the writing of a batch and its entry as done, and in the midst of a write."""

import shutil
from pathlib import Path

import pytest

from filigree.streaming import sinks

SCHEMA = "k int, v string"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def held(spark, root):
    like = spark.createDataFrame([], SCHEMA)
    return sorted(((r["k"], r["v"]) for r in sinks.read_batches(spark, f"{sinks.folder_of(str(root), {})}/table", like).collect()), key=str)


def test_killed_between_write_and_checkpoint(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    feed(spark, source, [(1, "a"), (2, "a"), (None, "a")])
    sinks.sink(stream(spark, source), str(root), ["k"]).awaitTermination()
    feed(spark, source, [(2, "b"), (3, "b"), (None, "b")])
    folder = sinks.folder_of(str(root), {})
    write = sinks.batch_writer(f"{folder}/table", ["k"])

    def dies(batch, number):
        write(batch, number)
        raise RuntimeError("killed here")

    q = stream(spark, source).writeStream.foreachBatch(dies).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed here"):
        q.awaitTermination()
    want = [(1, "a"), (2, "a"), (3, "b"), (None, "a")]
    assert held(spark, root) == want, "the batch stands, its entry does not"
    for _ in range(2):
        sinks.sink(stream(spark, source), str(root), ["k"]).awaitTermination()
        assert held(spark, root) == want
    feed(spark, source, [(4, "c"), (1, "c")])
    sinks.sink(stream(spark, source), str(root), ["k"]).awaitTermination()
    assert held(spark, root) == [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (None, "a")]


def test_killed_in_a_write(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    feed(spark, source, [(1, "a"), (2, "a")])
    # what a dead writer leaves: the batch's folder without its rows, or with part of them
    table = Path(sinks.folder_of(str(root), {})) / "table"
    for rows in ([], [(2, "a")]):
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(str(table / "_batch=0"))
        sinks.batch_writer(str(table), ["k"])(spark.read.schema(SCHEMA).parquet(str(source)), 0)
        assert held(spark, root) == [(1, "a"), (2, "a")]
    shutil.rmtree(table)


def test_settings_part_runs(spark, tmp_path):
    assert sinks.folder_of("r", {"a": 1, "b": 2}) == sinks.folder_of("r", {"b": 2, "a": 1}) != sinks.folder_of("r", {"a": 1})
