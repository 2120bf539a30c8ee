"""Mixing sources to target weights by the cube method (operator 5).

Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, …; they share the
total of all sizes, and a target stops at three times its source's size, the excess being
shared again by weight until none is above. Sources are a table: their numbers come from ranges of the
order, and a round of sharing is one sum over it, in whole numbers; two numbers per round reach the driver.

Taking. A document is taken floor(r) times for r = target / size of its source, plus once more
with inclusion probability r - floor(r). Documents of one source and size are alike to every
constraint, so they are counted first: a cell of n documents takes floor(n p) of them and one
more with the probability that is left. The cube method moves these probabilities, three cells
at a time, along the null space of the balancing constraints (their number and their tokens) until
one of them is 0 or 1. Blocks of a source, salted by size, fly apart in parallel (large sizes
first); each leaves two open cells at most and ``SPARE`` of all sizes, and those fly again in fewer
blocks until a source fits one block. There the landing decides the last ones so that its tokens
come nearest to its target. Which documents of a cell are taken goes by the hash of id and text (``mark``), counted in ``SALTS``
buckets, so a cell that holds a third of all rows is many tasks' work. Rows of one mark count as one
with a number; only at the one mark that a bucket's quota cuts do row numbers tell its equal rows apart. So the
mix does not depend on splits, cores or shuffle partitions.

Random directions come from the hash of the block, so reruns agree.

Defined cases: null text has size 0 and moves no token; null source is a source of its own,
last; null ids and repeated rows are documents like any other; an empty table gives an empty
result; extra columns are ignored (``mix`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import word_count
from filigree.operators.ordering import numbered
from filigree.session import materialize, spare_name

CEILING, BLOCK_ROWS, SPARE, SEED = 3, 8192, 64, 20240229

#: Buckets of a cell; equal rows that one window numbers.
SALTS, PART = 256, 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = CEILING) -> DataFrame:
    """(src, source_size, target, whole, prob) of a table (src, total) of sources; ``src`` sorts as the order of sources.

    Above its ceiling is a source with unit x weight > ceiling x size, where unit = rest / sum of the
    weights of the others; all sides are whole numbers.
    """
    at = F.pmod(F.col("number"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int"))
    rows = materialize(numbered(sizes, ["src"], "number").select("src", "total", weight.cast("decimal(10,0)").alias("weight")), "sources")
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    everything = int(rows.agg(F.coalesce(F.sum(wide("total")), F.lit(0))).first()[0])

    def above(rest: int, units: int) -> Column:
        return F.lit(rest).cast("decimal(20,0)") * F.col("weight") > (wide("total") * F.lit(ceiling * units).cast("decimal(18,0)"))

    full, known = F.lit(False), -1
    while True:  # the unit only grows, so the sources above their ceiling stay so
        s = rows.agg(F.sum(F.when(~full, F.col("weight"))).alias("units"), F.coalesce(F.sum(F.when(full, wide("total"))), F.lit(0)).alias("taken"), F.count_if(full).alias("n")).first()
        rest, units = everything - ceiling * int(s["taken"]), int(s["units"] or 0)
        if s["n"] == known or not units:
            break
        full, known = above(rest, units), s["n"]
    unit = F.lit(rest / units if units else 0.0)
    target = F.when(full, F.col("total") * F.lit(float(ceiling))).otherwise(unit * F.col("weight").cast("double"))
    ratio = F.when(full, F.lit(float(ceiling))).when(F.col("total") > 0, target / F.col("total")).otherwise(0.0)
    return rows.select("src", F.col("total").alias("source_size"), target.alias("target"), F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("prob"))


def flight(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move probabilities until two at most are neither 0 nor 1, keeping their sum and that of prob x size."""
    rng = np.random.default_rng(seed)
    p = prob.astype(float).copy()
    draws = rng.random(len(p) + 1)
    held: list[int] = []
    eps = 1e-9
    for nth, i in enumerate(np.flatnonzero((p > eps) & (p < 1 - eps))):
        held.append(int(i))
        if len(held) < 3:
            continue
        a, b, c = held
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        x = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
            down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
        x = x + up * u if draws[nth] * (up + down) < down else x - down * u
        x[x < eps], x[x > 1 - eps] = 0.0, 1.0
        p[held] = x
        held = [k for k in held if 0 < p[k] < 1]
    return p


def landing(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Decide what the last flight left open: the choice whose tokens, then documents, come nearest.

    Where that misses the tokens, the two documents (one taken, one not) whose exchange, or the
    one whose change, comes nearest are exchanged; three times at most.
    """
    want = float((prob * size).sum())
    p = flight(prob, size, seed)
    left = np.flatnonzero((p > 0) & (p < 1))
    goal, number = want - float((np.delete(p, left) * np.delete(size, left)).sum()), p[left].sum()
    choices = [np.array([m >> k & 1 for k in range(len(left))], dtype=float) for m in range(1 << len(left))]
    p[left] = min(choices, key=lambda x: (abs(float((x * size[left]).sum()) - goal), abs(x.sum() - number), tuple(x)))
    for _ in range(3):
        short = want - float((p * size).sum())
        ins, outs = np.flatnonzero(p == 0), np.flatnonzero(p == 1)
        moves = [(abs(short - size[i]), i, -1) for i in ins[np.abs(short - size[ins]).argsort(kind="stable")[:1]]]
        moves += [(abs(short + size[o]), -1, o) for o in outs[np.abs(short + size[outs]).argsort(kind="stable")[:1]]]
        if len(ins) and len(outs):
            order = ins[np.argsort(size[ins], kind="stable")]
            wanted = size[outs] + short
            at = np.searchsorted(size[order], wanted)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)):
                miss = np.abs(size[order[near]] - wanted)
                k = int(miss.argmin())
                moves.append((float(miss[k]), int(order[near[k]]), int(outs[k])))
        best = min(moves, default=(np.inf, -1, -1))
        if best[0] >= abs(short):
            break
        if best[1] >= 0:
            p[best[1]] = 1.0
        if best[2] >= 0:
            p[best[2]] = 0.0
    return p


FLOWN = "src string, size long, prob double, tie long"


def _fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block: the landing if it is its source's only one, else a flight that spares a few cells of all sizes."""
    _, block, blocks = key
    rows = rows.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
    seed = SEED + int(block) * 1_000_003 + int(rows["tie"].iloc[0]) % 1_000_003
    prob, size = rows["prob"].to_numpy().copy(), rows["size"].to_numpy()
    if blocks == 1:
        prob = landing(prob, size, seed)
    elif len(rows) > SPARE:
        fly = np.ones(len(rows), dtype=bool)
        fly[np.linspace(0, len(rows) - 1, SPARE).astype(int)] = False
        prob[fly] = flight(prob[fly], size[fly], seed)
    rows["prob"] = prob
    return rows[["src", "size", "prob", "tie"]]


def decide(cells: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, size, extra): the balanced sample of a table (src, size, prob, tie) of cells, each 0 or 1."""
    block_rows = max(block_rows, 4 * SPARE)
    rows, done, level = cells, None, 0
    while True:
        counts = rows.groupBy("src").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        level += 1
        dealt = rows.join(counts, "src").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "tie"), F.col("blocks")))
        flown = materialize(dealt.groupBy("src", "block", "blocks").applyInPandas(_fly, FLOWN), "flown")
        part = flown.filter("prob = 0 or prob = 1").select("src", "size", F.col("prob").cast("int").alias("extra"))
        done = part if done is None else done.union(part)
        rows = flown.filter("prob > 0 and prob < 1")
        if not rows.limit(1).count():
            return done


def source_key(source: Column) -> Column:
    """A text that sorts as the order of sources and is null for none: code points, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def take(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table (rid, mark, doc_id, source, size) with source_size, target and copies added."""
    rows = marked.withColumn("src", source_key(F.col("source")))
    goal = materialize(targets(rows.groupBy("src").agg(F.sum("size").alias("total"))), "targets")
    # rows that are alike to every constraint become one in each task before anything moves
    units = materialize(rows.groupBy("src", "size", "mark").agg(F.count("*").alias("n")).withColumn("salt", F.pmod("mark", F.lit(SALTS))), "units")
    counts = materialize(units.groupBy("src", "size", "salt").agg(F.sum("n").alias("n")), "cells")
    cells = counts.groupBy("src", "size").agg(F.sum("n").alias("n")).join(goal.select("src", "prob"), "src").withColumn("want", F.col("n") * F.col("prob"))
    # a product that is whole but for rounding is whole
    sure = F.when(F.abs(F.col("want") - F.round("want")) < 1e-7, F.round("want")).otherwise(F.floor("want"))
    cells = materialize(cells.select("src", "size", sure.cast("long").alias("sure"), F.greatest(F.lit(0.0), F.col("want") - sure).alias("prob"), F.xxhash64("src", "size").alias("tie")), "wanted")
    extra = decide(cells.filter("prob > 1e-7").select("src", "size", "prob", "tie"), block_rows)
    number = cells.join(extra, ["src", "size"], "left").select("src", "size", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("number"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of each bucket the first so many in the order of the documents' hashes
    quota = counts.withColumn("before", before).join(number, ["src", "size"]).join(goal, "src")
    quota = quota.withColumn("quota", F.greatest(F.lit(0), F.least("n", F.col("number") - F.col("before")))).drop("n", "before", "number")
    upto = F.sum("n").over(Window.partitionBy("src", "size", "salt").orderBy("mark"))
    units = units.withColumn("upto", upto).join(quota, ["src", "size", "salt"])
    more = F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("upto") + F.col("n")))
    units = materialize(units.select("src", "size", "mark", "n", more.alias("more"), "source_size", "target", "whole"), "taken-units")
    keys = ["src", "size", "mark"]
    settled = rows.join(units.filter("more = 0 or more = n"), keys).withColumn("copies", F.col("whole") + (F.col("more") > 0).cast("int"))
    # of the equal rows at a border any will do: the first by row number, numbered in parts
    border = rows.join(units.filter("more > 0 and more < n"), keys).withColumn("part", F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / PART)))
    parts = border.groupBy(*keys, "part").agg(F.count("*").alias("m"))
    parts = parts.select(*keys, "part", (F.sum("m").over(Window.partitionBy(*keys).orderBy("part")) - F.col("m")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("rid"))
    border = border.withColumn("within", within).join(parts, [*keys, "part"])
    border = border.withColumn("copies", F.col("whole") + (F.col("before") + F.col("within") <= F.col("more")).cast("int"))
    names = [*marked.columns, "source_size", "target", "copies"]
    return settled.select(*names).unionByName(border.select(*names))


def mix_report(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    marked = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"))
    marked = materialize(marked.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    return take(marked, block_rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies")
    )


def mix(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents of the mix: each as often as it is taken. Columns stay as they are."""
    rid, size, copy, mark = (spare_name(docs, x) for x in ("rid", "size", "copy", "mark"))
    kept = materialize(docs.withColumns({size: word_count(F.col("text")), mark: F.xxhash64("doc_id", "text"), rid: F.monotonically_increasing_id()}), "mix")
    marked = kept.select(F.col(rid).alias("rid"), "doc_id", "source", F.col(size).alias("size"), F.col(mark).alias("mark"))
    copies = take(marked, block_rows).filter("copies > 0").select(F.col("rid").alias(rid), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy))
    return kept.join(copies, rid).select(*docs.columns)
