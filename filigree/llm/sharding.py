"""Sharding by histogram sort (operator 3), law ``bytes``: shards of near equal size.

Rows are ordered by (hash of the text, hash of the id and row number), so equal texts are neighbours and stay
together unless a shard border has to fall among them. The border of shard k is the key below
which k/n of all bytes lie. Each round counts the exact bytes below a set of candidate keys in
every open bracket (a sum per task, then a sum of those), narrows each bracket to the candidate
neighbours around its target, and stops when a candidate meets the tolerance or none is left to
try. A group of equal texts that is larger than the tolerance is probed again by the id's hash
within it. Then all rows are exchanged once, by (shard, salt), and numbered.

Memory: a probe set has shards x probes entries; rows are read as 24-byte keys, never gathered.

Defined cases: null text has no bytes (size 16) and counts as one text of its own; rows equal in
text and id, or without an id, are told apart by their row number, so that a group of them can be
split like any other (which of them lies where then depends on how the table was read); null ids are
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import shuffle_partitions
from filigree.session import materialize

SHARDS, OVERHEAD = 40, 16
LOW, HIGH = -(2**63), 2**63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two halves of the sort key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.lit("text")).alias("h1"),
        F.xxhash64(F.lit("id"), "doc_id", F.monotonically_increasing_id()).alias("h2"),
    )


def below(rows: DataFrame, probes: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and number of the rows whose ``key`` lies below each of the ascending ``probes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(total, at, batch.column(1).to_numpy())
            np.add.at(number, at, 1)
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(number[some])], names=["cell", "bytes", "rows"])

    cells = rows.select(key, "size").mapInArrow(run, "cell long, bytes long, rows long").groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    out = np.zeros((2, len(probes) + 1), dtype=np.int64)
    for row in cells.collect():  # one row per probe at most
        out[:, row["cell"]] = row["bytes"], row["rows"]
    return tuple(np.cumsum(out, axis=1)[:, :-1])


class Bracket:
    """Two keys with the target between the bytes below them: low (at or below it) and high (above it)."""

    def __init__(self, target: float, start: tuple[int, int], end: tuple[int, int]):
        self.target, self.low, self.high = target, LOW, HIGH
        self.under, self.rows_under = start
        self.over, self.rows_over = end

    def narrow(self, points: np.ndarray, size: np.ndarray, rows: np.ndarray) -> None:
        inside = (points > self.low) & (points < self.high)
        under, over = np.flatnonzero(inside & (size <= self.target)), np.flatnonzero(inside & (size > self.target))
        if len(under):
            k = under[-1]
            self.low, self.under, self.rows_under = int(points[k]), int(size[k]), int(rows[k])
        if len(over):
            k = over[0]
            self.high, self.over, self.rows_over = int(points[k]), int(size[k]), int(rows[k])

    def miss(self) -> float:
        return min(self.target - self.under, self.over - self.target)

    def settled(self, tolerance: float) -> bool:
        return self.miss() <= tolerance or self.rows_over - self.rows_under <= 1 or self.high - self.low <= 1

    def best(self) -> int:
        return self.low if self.target - self.under <= self.over - self.target else self.high


def narrow_all(rows: DataFrame, key: str, brackets: list[Bracket], tolerance: float, probes: int, base: tuple[int, int] = (0, 0)) -> None:
    """Probe all open brackets together, round by round, until each is settled."""
    while open_ := [b for b in brackets if not b.settled(tolerance)]:
        tried: set[int] = set()
        for b in open_:
            step = max(1, (b.high - b.low) // (probes + 1))
            tried.update(range(b.low + step, b.high, step))
        points = np.array(sorted(tried), dtype=np.int64)
        size, number = below(rows, points, key)
        for b in open_:
            b.narrow(points, size + base[0], number + base[1])


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = 0.001, probes: int = 63) -> list[tuple[int, int]]:
    """Ascending (h1, h2): a row belongs to the shard whose number is how many splitters are at or below it."""
    total, number = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    allowed = tolerance * total / shards
    brackets = [Bracket(total * k / shards, (0, 0), (total, number)) for k in range(1, shards)]
    narrow_all(rows, "h1", brackets, allowed, probes)
    out: list[tuple[int, int]] = []
    heavy: dict[int, list[Bracket]] = {}
    for b in brackets:
        if b.miss() <= allowed or b.rows_over - b.rows_under <= 1:
            out.append((b.best(), LOW))
        else:  # all rows between the two keys share one text hash: low
            heavy.setdefault(b.low, []).append(b)
    for h1, group in heavy.items():
        start, end = (group[0].under, group[0].rows_under), (group[0].over, group[0].rows_over)
        inside = [Bracket(b.target, start, end) for b in group]
        narrow_all(rows.filter(F.col("h1") == h1), "h2", inside, allowed, probes, start)
        out += [(h1, b.best()) for b in inside]
    return sorted(out)


def assign(rows: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    """Add ``shard`` by the row's place among the splitters."""
    firsts = np.array([b[0] for b in borders], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("h1", "h2"))
            shard = np.searchsorted(firsts, h1, side="left").astype(np.int32)
            for a, b in borders:
                shard += (h1 == a) & (h2 >= b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``)."""
    rows = materialize(keyed(docs), "shard-keys")
    salts = max(8, 4 * shuffle_partitions(docs) // shards)
    placed = assign(rows, splitters(rows, shards, tolerance)).withColumn("salt", F.pmod("h2", F.lit(salts)))
    placed = materialize(placed, "shard-rows")
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("h1", "h2", "doc_id"))
    return placed.withColumn("within", within).join(F.broadcast(counts), ["shard", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
