"""Ranking by counts of the asked terms and needles in texts: odd tables against SQL and plain scans, and what the plans leave out."""

import random

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)

from filigree.operators import positions
from filigree.operators import retrieval as R
from filigree.plans.registry import QUERIES, SQL

NAMES = ["r4_bm25", "r4_bm25_every_script", "r7_rrf_fusion", "t4_ordered_fusion", "e1_retrieval_metrics", "e2_micro_macro"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and empty texts, repeated ids, copies, a document that holds every item."""
    rnd = random.Random(2)
    words = ["alpha", "Beta", "gämma", "계약금액", "delta", "x1", "of", "zeta", "eta9", "q"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, text(rnd.randint(6, 9))) for k in range(12)] + [(20, None), (21, ""), (22, "Beta"), (23, "never seen words")]
    docs = [(k, text(rnd.randint(0, 60))) for k in range(90)] + [(k % 7, text(30)) for k in range(20)] + [(100, None), (101, ""), (102, None), (103, " | ".join(t for _, t in items if t))]
    docs += [(200 + k, docs[5][1]) for k in range(40)]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables_equal_sql(spark, odd, name, monkeypatch):
    """Also in small blocks of queries, documents, needles and bytes, and without an index of all words."""
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    monkeypatch.setattr(positions, "positional_index", lambda *a, **k: pytest.fail("all words are indexed"))
    assert oracle.compare(QUERIES[name](spark, odd), con, SQL[name]) == ""
    monkeypatch.setattr(R, "BLOCK_TERMS", 30)
    monkeypatch.setattr(R, "BLOCK_NEEDLES", 5)
    assert oracle.compare(QUERIES[name](spark, odd), con, SQL[name]) == ""


def test_metrics_compare_no_item_with_every_text(spark, odd):
    plan = QUERIES["e1_retrieval_metrics"](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_needles_equal_a_scan(spark):
    rnd = random.Random(5)
    docs = [(k, "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 300)))) for k in range(60)] + [(60, None), (61, ""), (62, "a" * 5000), (62, "a" * 5000)]
    needles = [(k, (t := docs[rnd.randrange(60)][1])[(i := rnd.randrange(max(1, len(t)))) : i + rnd.randint(0, 20)]) for k in range(80)] + [(80, "a" * 600), (81, "aaaaaaaab"), (82, None), (83, "a" * 600)]
    got = R.containing(spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t", spark.createDataFrame(needles, "q long, n string"), "q", "n")
    want = sorted((q, d) for q, n in needles for d, t in docs if n is not None and t is not None and n in t)
    assert sorted((r["query"], r["doc"]) for r in got.collect()) == want


def test_text_ids(spark):
    """Ids of any type; equal scores go by id."""
    docs = spark.createDataFrame([(f"d{k}", "one two three" if k % 2 else "one four") for k in range(30)], "id string, t string").repartition(4)
    asked = spark.createDataFrame([("a", "one two"), ("b", "four")], "q string, w string")
    got = R.bm25(docs, "id", "t", asked, "q", "w", 3).orderBy("query", "rank").select("query", "doc", F.col("rank")).collect()
    assert [tuple(r) for r in got] == [("a", "d1", 1), ("a", "d11", 2), ("a", "d13", 3), ("b", "d0", 1), ("b", "d10", 2), ("b", "d12", 3)]
