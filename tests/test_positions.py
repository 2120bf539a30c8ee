"""The kept positional index: identity, phrases against a plain scan, filters before ranking."""

import random

from pyspark.sql import functions as F

from filigree.operators import positions as P
from filigree.operators.retrieval import EVERY_SCRIPT, terms


def corpus(spark, n=120, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "계약금액", "주식", "delta", "x1"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "alpha " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), dict(rows)


def plain_hits(text, words):
    at = [w for w in (text or "").lower().split()]
    return sum(at[i : i + len(words)] == words for i in range(len(at) - len(words) + 1))


def test_phrases_equal_a_scan(spark, tmp_path):
    docs, text = corpus(spark)
    index = P.positional_index(docs, "doc_id", "text", EVERY_SCRIPT, str(tmp_path))
    asked = [(1, ["alpha", "beta"]), (2, ["계약금액", "주식", "계약금액"]), (3, ["alpha"]), (4, ["alpha", "alpha", "alpha"]), (5, ["never", "alpha"]), (6, []), (7, ["beta"] * 12)]
    phrases = spark.createDataFrame(asked, "query long, words array<string>")
    got = {(r["query"], r["doc"]): r["hits"] for r in P.phrase_hits(index, phrases).collect()}
    want = {(q, d): n for q, w in asked if w for d, x in text.items() if (n := plain_hits(x, w))}
    assert got == want and any(q == 4 and n > 2000 for (q, d), n in got.items())
    ranked = P.ranked_phrases(index, phrases, 3).collect()
    assert all(r["rank"] <= 3 for r in ranked) and {r["query"] for r in ranked} == {q for q, _ in want}


def test_filters_come_before_ranking(spark, tmp_path):
    """The best admitted documents are returned although better ones are not admitted; figures stay those of the corpus."""
    docs, _ = corpus(spark)
    index = P.positional_index(docs, "doc_id", "text", EVERY_SCRIPT, str(tmp_path))
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "주식")], "query long, term string")
    every = {(r["query"], r["doc"]): r["score"] for r in P.ranked_terms(index, asked, 1000).collect()}
    admitted = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("doc"))
    some = P.ranked_terms(index, asked, 4, admitted).collect()
    for q in (1, 2):
        mine = sorted(((-s, d) for (query, d), s in every.items() if query == q and d % 5 == 0))[:4]
        assert [(r["doc"], r["score"]) for r in sorted(some, key=lambda r: r["rank"]) if r["query"] == q] == [(d, -s) for s, d in mine]
    own = spark.createDataFrame([(1, 3), (2, 4)], "query long, doc long")
    assert {(r["query"], r["doc"]) for r in P.ranked_terms(index, asked, 4, own).collect()} <= {(1, 3), (2, 4)}
    phrases = spark.createDataFrame([(1, ["alpha"])], "query long, words array<string>")
    assert all(r["doc"] % 5 == 0 for r in P.ranked_phrases(index, phrases, 4, admitted).collect())


def test_identity(spark, tmp_path):
    """The same documents in another order keep their index; one changed text makes a new one; an unfinished one is written again."""
    docs, _ = corpus(spark, 20)
    a = P.positional_index(docs, "doc_id", "text", EVERY_SCRIPT, str(tmp_path))
    n = a.postings.count()
    assert P.positional_index(docs.orderBy(F.desc("doc_id")), "doc_id", "text", EVERY_SCRIPT, str(tmp_path)).path == a.path
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, "other words").otherwise(F.col("text")))
    assert P.positional_index(changed, "doc_id", "text", EVERY_SCRIPT, str(tmp_path)).path != a.path
    (tmp_path / "index" / a.path.rsplit("/", 1)[1] / "size" / "_SUCCESS").unlink()
    assert P.positional_index(docs, "doc_id", "text", EVERY_SCRIPT, str(tmp_path)).postings.count() == n


def test_plan_reads_folders_of_the_terms_only(spark, tmp_path):
    docs, _ = corpus(spark, 50)
    index = P.positional_index(docs, "doc_id", "text", EVERY_SCRIPT, str(tmp_path))
    asked = spark.createDataFrame([("alpha",)], "term string")
    plan = index.of(asked)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters" in plan
    assert {r["term"] for r in index.of(asked).select("term").distinct().collect()} == {"alpha"}


def test_empty(spark, tmp_path):
    docs, _ = corpus(spark, 1)
    index = P.positional_index(docs.filter("false"), "doc_id", "text", EVERY_SCRIPT, str(tmp_path))
    asked = docs.select(F.col("doc_id").alias("query"), F.explode(terms(F.col("text"))).alias("term"))
    assert P.ranked_terms(index, asked, 5).count() == 0
