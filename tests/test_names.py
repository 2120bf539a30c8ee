"""Names in texts against plain scans."""

import random

from pyspark.sql import functions as F

from filigree.operators import names as N

TAILS = ("은", "는", "의")


def plain_occurrences(text, names, tails):
    out = []
    for name_id, surface, priority in names:
        at = text.find(surface)
        while surface and at >= 0:
            if N.bounded(text, at, at + len(surface), surface, tails):
                out.append((at, at + len(surface), name_id, surface, priority))
            at = text.find(surface, at + 1)
    return sorted(out)


def plain_spans(found):
    """A place goes if a longer one covers it, or the same place has a name of a smaller priority number."""
    return sorted(m for m in found if not any(
        o[0] <= m[0] and m[1] <= o[1] and (o[1] - o[0] > m[1] - m[0] or ((o[0], o[1]) == (m[0], m[1]) and o[4] < m[4])) for o in found))


def test_spans_equal_a_scan(spark):
    rnd = random.Random(2)
    pieces = ["매출", "매출액", "액", "영업이익", "은", "의", "total", "total assets", "assets", " ", "s", "1", "x", ".", "순이익", "\U0001f600", "매출액의"]
    texts = [(k, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))) for k in range(400)] + [(900, None), (901, "매출" * 2000)]
    names = [(1, "매출", 0), (2, "매출액", 0), (3, "영업이익", 1), (4, "total assets", 0), (5, "assets", 0), (6, "total", 2), (7, "total", 1), (8, "이익", 0), (9, "순이익", 0), (10, "", 0), (11, "매출액", 1)]
    df = spark.createDataFrame(texts, "k long, text string").withColumns({c: F.lit("clash") for c in ("start", "surface")})
    catalogue = spark.createDataFrame(names, "name_id long, surface string, priority int")
    for tails in (TAILS, None):
        want = {k: plain_occurrences(x or "", names, tails) for k, x in texts}
        for limit in (N.BLOCK, 6):
            got = {}
            for r in N.occurrences(df, "k", "text", catalogue, tails, limit).collect():
                got.setdefault(r["k"], []).append(tuple(r)[1:])
            assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        spans = {}
        for r in N.name_spans(df, "k", "text", catalogue, tails).select("k", "start", "stop", "name_id", "surface", "priority").collect():
            spans.setdefault(r["k"], []).append(tuple(r)[1:])
        assert {k: sorted(v) for k, v in spans.items()} == {k: plain_spans(v) for k, v in want.items() if v}
    assert N.name_spans(df, "k", "text", catalogue.filter("false")).count() == 0


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_near_names_equal_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc전자") for _ in range(rnd.randint(1, 6)))
    words, names = {word() for _ in range(300)}, {word() for _ in range(120)}
    got = {tuple(r) for r in N.near_names(spark.createDataFrame([(w,) for w in words], "core string"), spark.createDataFrame([(n,) for n in names], "surface string")).collect()}
    assert got == {(w, n) for w in words for n in names if edits(w, n)}


def test_one_repair_or_none(spark):
    names = spark.createDataFrame([("삼성전자", "a", "삼성전자"), ("삼성전기", "b", "삼성전기"), ("현대자동차", "c", "현대자동차"), ("현대차동차", "c", "현대자동차")], "surface string, identity string, replacement string")
    texts = [(1, "삼성전쟈 실적"), (2, "삼성전자 삼성전가"), (3, "현데자동차 매출"), (4, "현대자동차 매출"), (5, "현대바동차"), (6, "현데자동차 현대자동"), (7, "abc"), (8, None)]
    df = spark.createDataFrame(texts, "k long, text string")
    words = F.coalesce(F.split("text", " "), F.array().cast("array<string>"))
    got = {r["k"]: (r["core"], r["replacement"]) for r in N.typo_repairs(df, "k", words, names).collect()}
    # 1: two identities are near; 2: one word is right, the other near both; 5: two surfaces of one identity, one replacement; 6: two words
    assert got == {3: ("현데자동차", "현대자동차"), 5: ("현대바동차", "현대자동차")}
    fixed = df.join(N.typo_repairs(df, "k", words, names), "k", "left").select("k", N.repaired(F.col("text"), F.col("core"), F.col("replacement")).alias("t"))
    assert {r["k"]: r["t"] for r in fixed.collect()} == dict(texts) | {3: "현대자동차 매출", 5: "현대자동차"}


def test_spaced_names(spark):
    names = spark.createDataFrame([("삼성전자",), ("삼성",), ("전자랜드",), ("AB CD",)], "surface string")
    texts = [(1, "삼 성 전 자 실적"), (2, "삼 성전자 전자랜드"), (3, "삼성전자 삼 성 전 자"), (4, "A B\tC D"), (5, "ABCD"), (6, "삼\n성전자"), (7, "삼성전 자랜드"), (8, None)]
    df = spark.createDataFrame(texts, "k long, text string")
    got = sorted(tuple(r) for r in N.spaced_names(df, "k", "text", names).collect())
    # 6: a line end is no blank; 7: the longest names overlap, the first stays
    assert got == [(1, 0, 7, "삼 성 전 자", "삼성전자"), (2, 0, 5, "삼 성전자", "삼성전자"), (4, 0, 7, "A B\tC D", "AB CD"), (7, 0, 5, "삼성전 자", "삼성전자")]
