"""Operator 11 against brute force and its SQL."""

import math
import random
import re
from collections import Counter

import oracle
from pyspark.sql import functions as F

from filigree.llm import search
from filigree.llm.queries import op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    cut = [(d, Counter(w), len(w)) for d, x in docs if (w := plain_terms(x))]
    n, length = len(cut), sum(c for _, _, c in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in cut:
            m = 75 + 25 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_terms_of():
    for text in ("", "aB9_ß-Ü x\x00y\x7fz", "ÀÉ a b \U0001f600", "x" * 100_000, "İI"):
        assert [t.decode() for t in search.terms_of(text)] == plain_terms(text)


def test_equals_sql(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        assert oracle.compare(op11_lexical_search(spark, folder), oracle.connection(folder), search.SQL) == ""


def test_equals_brute_force(spark, monkeypatch):
    """Odd texts, repeated rows, ties, missing ids, clashing columns, blocks of one document and of few item terms."""
    rnd = random.Random(7)
    words = ["a", "B", "ß", "Ü9", "x_y", "na-me", "é", "zz", "\U0001f600", "q"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(k, text(rnd.randint(1, 12))) for k in range(300)] + [(7, "a b"), (7, "a b"), (None, "a zz"), (400, None), (401, ""), (402, " .,;"), (403, "a " * 50_000)]
    items = [(k, text(rnd.randint(1, 9))) for k in range(25)] + [(90, None), (91, ""), (92, "never seen words"), (None, "a zz zz")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "doc", "score", "key", "item")}).repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("times", F.lit("clash"))
    want = brute(docs, items)
    for block in (1 << 18, 20):
        got = sorted(map(tuple, search.ranked_search(a, b, block_terms=block).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == want
    monkeypatch.setattr(search, "BLOCK_DOCS", 3)
    assert sorted(map(tuple, search.ranked_search(a, b).select("item_id", "rank", "doc_id", "score").collect()), key=str) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked_search(docs.filter("false"), items).count() == 0
    assert search.ranked_search(docs, items.filter("false")).count() == 0
    assert search.ranked_search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_many_equal_scores(spark):
    """Thousands of copies tie at the border; the smallest ids stay."""
    docs = spark.range(9000).select((9000 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("rare word")).otherwise(F.lit("other text")).alias("text"))
    items = spark.createDataFrame([(1, "rare")], "item_id long, text string")
    got = [r["doc_id"] for r in search.ranked_search(docs, items).orderBy("rank").collect()]
    assert got == [3 * k for k in range(1, 21)]
