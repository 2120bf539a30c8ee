"""Chunks over the fragments of a group (filing, source, section), for groups of any size, with the evidence of every token.

A group's fragments are one row of tokens. A chunk that starts at token s ends at a place that follows from
s and the fragments' ends, and the next one starts ``overlap`` tokens before that: a chain. It is not walked in one task:

1. Places of fragments are running sums over ranges of the order, with the sums of earlier ranges added.
2. The token row is cut in segments of ``SEGMENT`` tokens. For every place where a chain may enter a segment (as many
   as a chunk has tokens at most) the segment tells where the chain leaves it and after how many chunks.
3. Those small tables are read in order, one number carried from segment to segment: the entries.
4. Each segment writes the chunks that start in it, and chunks meet the pieces of fragments under buckets of tokens.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.functions.chunks import MOST, OVERLAP, TARGET
from filigree.operators.ordering import in_ranges
from filigree.session import materialize

#: Tokens of a segment, and of a bucket under which chunks and pieces meet.
SEGMENT, BUCKET = 65_536, 1024

#: A token as ``chunks.tokens`` counts them, with the white space after it.
PIECE = r"(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])\s*"


def running_places(units: DataFrame, group: list[str], order: list[str], size: str, parts: int | None = None) -> DataFrame:
    """``units`` with ``begin`` and ``stop``: running sums of ``size`` within a group in the order; no group is one window."""
    dealt = in_ranges(units, [*group, *order], parts)
    sums = dealt.groupBy("_range", *group).agg(F.sum(size).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    sums = sums.select("_range", *group, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(size).over(Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_within", within).join(sums.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group], "_before"), (F.col("_range") == F.col("_r")) & _all([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]))
    stop = F.col("_before") + F.col("_within")
    return placed.select(*units.columns, (stop - F.col(size)).cast("long").alias("begin"), stop.cast("long").alias("stop"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def next_stop(start: int, ends: list[int], total: int, goal: int, limit: int) -> int:
    """Where the chunk that starts at ``start`` ends: with the first fragment that passes the goal, if it fits the limit."""
    passing = bisect_right(ends, start + goal)
    return min(ends[passing] if passing < len(ends) else total, start + limit, total)


def budget(before: int, target: int, most: int, overlap: int) -> tuple[int, int, int]:
    """(goal, limit, overlap) of chunks behind a prefix of ``before`` tokens, which leaves room for one at least."""
    limit = most - before
    goal = min(limit, target - before) if target > before else limit
    return goal, limit, min(overlap, max(0, goal - 1))


def exits_udf(target: int, most: int, overlap: int):
    """Per segment (low, total, before, ends): for entry low + k the place of the first chunk that starts beyond, less low (-1: the chain ended), and the chunks started."""

    @F.pandas_udf(T.StructType([T.StructField("to", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType()))]))
    def udf(low: pd.Series, total: pd.Series, before: pd.Series, ends: pd.Series) -> pd.DataFrame:
        to_all, n_all = [], []
        for lo, tot, pre, e in zip(low, total, before, ends):
            goal, limit, over = budget(int(pre), target, most, overlap)
            e = sorted(int(x) for x in e)
            width = min(SEGMENT, int(tot) - int(lo))
            to, n = np.empty(width, dtype=np.int64), np.empty(width, dtype=np.int32)
            for k in range(width - 1, -1, -1):
                stop = next_stop(int(lo) + k, e, int(tot), goal, limit)
                go = stop - over - int(lo)
                if stop >= tot:
                    to[k], n[k] = -1, 1
                elif go >= width:
                    to[k], n[k] = go, 1
                else:
                    to[k], n[k] = to[go], n[go] + 1
            to_all.append(to[:limit])
            n_all.append(n[:limit])
        return pd.DataFrame({"to": to_all, "n": n_all})

    return udf


def chunks_udf(target: int, most: int, overlap: int):
    """Per segment with its entry: (start, stop) of the chunks that start in it."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))
    def udf(low: pd.Series, total: pd.Series, before: pd.Series, ends: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for lo, tot, pre, e, at in zip(low, total, before, ends, entry):
            goal, limit, over = budget(int(pre), target, most, overlap)
            e, at, found = sorted(int(x) for x in e), int(at), []
            while at < lo + SEGMENT:
                stop = next_stop(at, e, int(tot), goal, limit)
                found.append({"start": at, "stop": stop})
                if stop >= tot:
                    break
                at = stop - over
            out.append(found)
        return pd.Series(out)

    return udf


def entries(segments: DataFrame) -> DataFrame:
    """(g, seg, entry, first): the chain's entry to each segment and the chunks before it; only segments that it enters.

    Each task reads its groups' small tables in order and keeps one number between two of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, count = None, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for g, seg, low, to, n in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    group, at, count = g, 0, 0
                k = at - low
                if at >= 0 and 0 <= k < SEGMENT:
                    rows.append((g, seg, at, count))
                    count += n[k]
                    at = low + to[k] if to[k] >= 0 else -1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["g", "seg", "entry", "first"])

    ordered = segments.select("g", "seg", "low", "exits.to", "exits.n").repartition("g").sortWithinPartitions("g", "seg")
    return ordered.mapInArrow(run, "g string, seg long, entry long, first long")


def chunk_fragments(fragments: DataFrame, group: list[str], order: list[str], text: str, evidence: str, prefix: Column | None = None, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, parts: int | None = None) -> DataFrame:
    """Chunks of every group: the group, ordinal, start, n_tokens, evidence_ids (in the order of their tokens, overlap included), text.

    ``order`` tells a group's fragments apart. ``prefix``: a text per group whose tokens count in each of its chunks; a group
    whose prefix leaves no room has no chunks. Fragments without tokens have no part.
    """
    g = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(group)]), {"ignoreNullFields": "false"}), 256)
    before = F.size(F.regexp_extract_all(prefix, F.lit(PIECE), 0)) if prefix is not None else F.lit(0)
    keys = [f"_k{n}" for n in range(len(group))]
    sorts = [f"_o{n}" for n in range(len(order))]
    units = fragments.select(*[F.col(c).alias(k) for c, k in zip(group, keys)], *[F.col(c).alias(o) for c, o in zip(order, sorts)], g.alias("g"), F.col(evidence).alias("_evidence"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), 0).alias("pieces"), before.alias("before"))
    units = units.withColumn("size", F.size("pieces").cast("long")).filter((F.col("size") > 0) & (F.col("before") < most))
    placed = materialize(running_places(units, ["g"], sorts, "size", parts), "places")
    groups = placed.groupBy("g").agg(F.max("stop").alias("total"), F.max("before").alias("before"), *[F.first(c).alias(c) for c in keys])
    groups = materialize(groups, "groups")
    # a fragment's end counts in its own segment and, for chunks that start before, up to a chunk's length back
    seg_of = lambda x: F.floor(x / SEGMENT).cast("long")
    ends = placed.select("g", "stop", F.explode(F.sequence(seg_of(F.greatest(F.lit(0), F.col("stop") - most)), seg_of(F.col("stop") - 1))).alias("seg")).groupBy("g", "seg").agg(F.collect_list("stop").alias("ends"))
    segments = groups.select("g", "total", "before", F.explode(F.sequence(F.lit(0).cast("long"), seg_of(F.col("total") - 1))).alias("seg"))
    segments = segments.join(ends, ["g", "seg"], "left").withColumns({"low": F.col("seg") * SEGMENT, "ends": F.coalesce("ends", F.array().cast("array<bigint>"))})
    segments = materialize(segments, "segments")
    into = entries(segments.withColumn("exits", exits_udf(target, most, overlap)("low", "total", "before", "ends")))
    chunks = segments.join(into, ["g", "seg"]).select("g", "first", F.posexplode(chunks_udf(target, most, overlap)("low", "total", "before", "ends", "entry")).alias("k", "c"))
    chunks = materialize(chunks.select("g", (F.col("first") + F.col("k")).cast("long").alias("ordinal"), "c.start", "c.stop"), "chunks")
    # the pieces of a fragment go to their buckets of tokens, never the whole fragment to each
    bucket = lambda x: F.floor(x / BUCKET).cast("long")
    parts_of = placed.select("g", "begin", "stop", "_evidence", "pieces", F.explode(F.sequence(bucket(F.col("begin")), bucket(F.col("stop") - 1))).alias("bucket"))
    low = F.greatest(F.col("begin"), F.col("bucket") * BUCKET)
    high = F.least(F.col("stop"), (F.col("bucket") + 1) * BUCKET)
    parts_of = parts_of.select("g", "bucket", "_evidence", low.alias("low"), (F.col("begin") == low).alias("fresh"), F.slice("pieces", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("pieces"))
    wanted = chunks.select("*", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop") - 1))).alias("bucket"))
    met = wanted.join(parts_of, ["g", "bucket"]).withColumns({"a": F.greatest("start", "low"), "b": F.least(F.col("stop"), F.col("low") + F.size("pieces"))}).filter("a < b")
    own = F.struct("a", (F.col("fresh") & (F.col("a") == F.col("low"))).alias("fresh"), "_evidence", F.array_join(F.slice("pieces", (F.col("a") - F.col("low") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), "").alias("words"))
    made = met.groupBy("g", "ordinal", "start", "stop").agg(F.array_sort(F.collect_list(own)).alias("own"))
    trimmed = lambda x: F.rtrim(x, F.lit(" \t\n\x0b\x0c\r"))
    # fragments are apart by a line end; a fragment that two buckets share is not
    text_of = F.aggregate("own", F.lit(""), lambda t, x: F.when(t == "", x["words"]).otherwise(F.concat(F.when(x["fresh"], F.concat(trimmed(t), F.lit("\n"))).otherwise(t), x["words"])))
    named = made.join(groups.select("g", *keys), "g")
    return named.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.array_distinct(F.transform("own", lambda x: x["_evidence"])).alias("evidence_ids"), trimmed(text_of).alias("text"))


__all__ = ["chunk_fragments", "entries", "next_stop", "running_places"]
