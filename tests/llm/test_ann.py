"""Operator 9 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from filigree.llm import ann


def exact(ids, x, query, k):
    out = {}
    for q in query:
        score = (x * x[ids == q][0]).sum(1)
        rows = np.lexsort((ids, -score))
        out[q] = [(int(ids[r]), float(score[r])) for r in rows if ids[r] != q][:k]
    return out


def test_recall_and_order(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = (np.array(c) for c in zip(*[(r["vec_id"], r["embedding"]) for r in rows.collect()]))
    got = {}
    for r in ann.neighbours(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(ids, x.astype(float), [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        truth = dict(want[q])
        hits += sum(f[1] in truth for f in found)
        assert all(abs(f[2] - truth[f[1]]) < 1e-12 for f in found if f[1] in truth)
    assert hits >= 0.9 * 20 * len(want)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.5, 0.5]), (20, [0.0, 1.0]), (40, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5), (0, 4, 20, 0.0), (20, 1, 8, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.neighbours(df.filter("false")).count() == 0


def test_hot_vector(spark):
    """A third of all rows share one vector; ties go to the smallest ids."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.cos("id"), F.sin("id"), F.sin(F.col("id") * 3))).alias("embedding"))
    first = ann.neighbours(df).filter("query_id = 60").orderBy("rank").collect()
    ids, x = (np.array(c) for c in zip(*[(r["vec_id"], r["embedding"]) for r in df.collect()]))
    want = exact(ids, x, [60], 20)[60]
    assert len(first) == 20 and abs(first[0]["score"] - want[0][1]) < 1e-9


def test_repeated_queries_and_widths(spark):
    """A query row that is there twice asks once; vectors of two widths are searched apart; few rows in the best leaves do not shorten a list."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.9, 0.0]), (2, [0.8, 0.0]), (3, [0.7, 0.0]), (20, [1.0, 1.0, 1.0]), (5, [0.5, 0.5, 0.0])]
    got = [tuple(r) for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").select("query_id", "rank", "vec_id").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 5)]
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.01, (1200, 4)) + [1, 0, 0, 0], rng.normal(0, 1, (7, 4)) + [0, 50, 0, 0]])
    df = spark.createDataFrame([(20 * 60 - 1 + k if k >= 1200 else k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert all(r["count"] == 20 for r in ann.neighbours(df).groupBy("query_id").count().collect())


def test_share_scanned(spark):
    """Clustered vectors: far from all leaves are visited."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(0, 0.05, (2000, 16))
    tree = ann.Tree(x)
    leaf = tree.assign(x)
    order = tree.visits(x[0], tree.leaves())
    assert sorted(order) == sorted(i for i, k in enumerate(tree.children) if not len(k)) and leaf[0] in order[: tree.leaves() // 10]
    near = tree.centres[order] @ x[0]
    assert (np.diff(near) <= 1e-9).all()  # leaves come in the order of their own products


def test_few_ids_over_many_rows(spark):
    """Twenty thousand rows that share two ids are all indexed and searched."""
    df = spark.range(20_000).select((20 + F.col("id") % 2).alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding"))
    got = ann.neighbours(df).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21)) and {(r["query_id"], r["vec_id"]) for r in got} == {(20, 21)}


def test_repeated_ids_with_far_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    df = spark.createDataFrame([(k % 500, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    ids, hits = np.arange(3000) % 500, 0
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    for q in range(0, 500, 20):
        one = min(map(tuple, x[ids == q]))
        best = np.sort(x[ids != q] @ np.array(one))[::-1][:20]
        assert len(got[q]) == 20
        hits += sum(any(abs(s - b) < 1e-9 for b in best) for s in got[q])
    assert hits >= 0.9 * 20 * 25


def test_many_widths(spark):
    """Twelve hundred widths of three vectors each: none is dropped."""
    df = spark.range(3600).select((F.col("id") * 20).alias("vec_id"), F.transform(F.sequence(F.lit(0), (F.col("id") / 3).cast("int")), lambda k: F.cos(F.col("id") + k)).alias("embedding"))
    got = ann.neighbours(df).groupBy("query_id").count().collect()
    assert len(got) == 3600 and {r["count"] for r in got} == {2}
