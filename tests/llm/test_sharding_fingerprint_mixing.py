"""Operators 3, 4 and 5."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigree.llm import fingerprint, mixing, sharding


def shard_rows(spark, docs, shards=8):
    rows = sharding.shard_documents(docs, shards).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return rows, by


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, by = shard_rows(spark, docs)
    text = {d["doc_id"]: d["text"] for d in docs.collect()}
    assert len(rows) == len(text) and all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in part) - total / 8) <= most for part in by.values())


def test_shards_split_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows, by = shard_rows(spark, docs)
    total = sum(r["size"] for r in rows)
    assert len(by) == 8 and all(abs(sum(r["size"] for r in part) - total / 8) <= 60 for part in by.values())
    groups = {}
    for r in rows:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sorted(len(g) for g in groups.values())[-2] == 1  # no text but the hot one is split


def lanes(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r["d"] for r in fingerprint.with_fingerprint(rows, "text", "f").select("k", fingerprint.digest(F.col("f")).alias("d")).orderBy("k").collect()]


def test_fingerprint_is_a_multiset_hash(spark):
    a, b, c, d, e = lanes(spark, ["one two\nthree\nfour five six seven", "three\nfour five six seven\none two", "one two\nthree\nthree\nfour five six seven", "", None])
    assert a == b and a != c and d == e and set(d) == {"0"}
    row = spark.createDataFrame([("one two\nthree", "four five six seven")], "t string, p string")
    row = fingerprint.with_fingerprint(fingerprint.with_fingerprint(row, "t", "f"), "p", "one")
    row = fingerprint.with_combined(fingerprint.with_combined(row, "f", "one", "more"), "more", "one", "less", -1)
    got = row.select(fingerprint.digest(F.col("more")).alias("m"), fingerprint.digest(F.col("less")).alias("l"), fingerprint.digest(F.col("f")).alias("t")).first()
    assert got["m"] == a and got["l"] == got["t"]


def test_edited_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs).collect()}
    assert len(got) == len(rows)
    wins = 0
    for k, r in enumerate(rows):
        t, nxt = r["text"], rows[(k + 1) % len(rows)]["text"]
        cut = len(t) // 4
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        wins += g["near_edited"] > g["near_next"]
    assert wins >= 0.95 * len(rows)
    same = {}
    for r in rows:
        same.setdefault(r["text"], set()).add(got[r["doc_id"]]["fingerprint"])
    assert all(len(s) == 1 for s in same.values())


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, full = {}, set()  # share, cap, share the excess again, as the law says
    while True:
        rest = Fraction(sum(sizes.values())) - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        want = {s: Fraction(3 * sizes[s]) for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if want[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    return {s: float(t) for s, t in want.items()}


def test_targets(spark):
    rng = random.Random(7)
    names = [None, "", "a", "b", "z", "é", "語", "😀", "ab"]
    for _ in range(5):
        sizes = {s: rng.choice([0, 1, 2, 50, rng.randrange(10**12)]) for s in rng.sample(names, rng.randrange(1, 10))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, total long")
        got = mixing.targets(rows.select(mixing.source_key(F.col("source")).alias("src"), "total")).collect()
        want = plain_targets(sizes)
        assert len(got) == len(want)
        for r in got:
            assert np.isclose(r["target"], want[None if r["src"] == "1" else r["src"][1:]], rtol=1e-12)
            assert np.isclose((r["whole"] + r["prob"]) * r["source_size"], r["target"])


@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0, 1)), max_size=60), st.integers(0, 99))
@settings(deadline=None)
def test_flight_and_landing(units, seed):
    size, prob = np.array([u[0] for u in units], dtype=float), np.array([u[1] for u in units], dtype=float)
    p = mixing.flight(prob, size, seed)
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2 and np.isclose(p.sum(), prob.sum(), atol=1e-4) and np.isclose((p * size).sum(), (prob * size).sum(), atol=0.1)
    done = mixing.landing(prob, size, seed)
    assert set(np.round(done, 9)) <= {0.0, 1.0} and abs((done * size).sum() - (prob * size).sum()) <= max(size, default=0) + 0.1


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix_report(docs, 300).collect()
    text = {d["doc_id"]: d for d in docs.collect()}
    sizes, taken, goal = {}, {}, {}
    for r in rows:
        s = text[r["doc_id"]]["source"]
        assert r["size"] == len(text[r["doc_id"]]["text"].encode().split()) and r["taken"] <= 3 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        goal[s] = r["target"]
    want = plain_targets(sizes)
    assert all(np.isclose(goal[s], want[s], rtol=1e-12) for s in goal)
    assert all(abs(taken[s] - goal[s]) <= 0.1 * goal[s] for s in goal)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs, 300).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and abs(mixed.count() - len(rows)) < len(rows)


def test_mix_in_many_blocks(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('s', id % 2) source", "repeat('w ', int(id % 37)) text")
    rows = mixing.mix_report(docs, 256).collect()
    for s in (0, 1):
        part = [r for r in rows if r["doc_id"] % 2 == s]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 40


def plain_fingerprint(spark, text):
    """(n, whole sums, lane sums) by hand: the hashes come from Spark, the sums from Python."""
    parts = [p for line in re.split(r"[\n\x0b\x0c\r]+", text) for p in re.split(r"(?<=[.!?…。,;:])[ \t]+", line) if p.strip(" ")]
    rows = spark.createDataFrame([(p,) for p in parts], "p string").select(*[F.xxhash64(F.lit(s), "p") for s in range(fingerprint.SEEDS)]).collect() if parts else []
    hashes = [[h % 2**64 for h in r] for r in rows]
    lanes = [sum(h[s] >> j & fingerprint.ONES for h in hashes) % 2**60 for s in range(fingerprint.SEEDS) for j in range(fingerprint.SHIFTS)]
    return len(parts), [sum(h[s] % 2**56 for h in hashes) % 2**56 for s in range(fingerprint.SEEDS)], lanes


def test_fingerprint_by_hand(spark):
    text = "Eins, zwei. Drei\nvier; fünf!  Sechs\n\nEins, 7"
    got = fingerprint.with_fingerprint(spark.createDataFrame([(text,)], "t string"), "t", "f").first()["f"]
    n, whole, lanes = plain_fingerprint(spark, text)
    assert n == 8 and got["n"] == n and list(got["whole"]) == whole and list(got["sums"]) == lanes
    ones = [x >> 15 * k & 0x7FFF for x in lanes for k in range(4)]
    assert np.isclose(got["power"], np.mean([(2 * c - n) ** 2 for c in ones]))


def test_likeness_is_near_the_true_one(spark):
    """2 A.B / (|A|^2 + |B|^2) on multisets, from disjoint over partly equal with repeats to equal."""
    rows = []
    for k, (common, own, again) in enumerate([(0, 300, 1), (100, 100, 1), (300, 20, 1), (50, 10, 9), (400, 0, 1)]):
        a = [f"c{i}" for i in range(common)] * again + [f"a{i}" for i in range(own)]
        b = [f"c{i}" for i in range(common)] * again + [f"b{i}" for i in range(own)]
        both, size = common * again**2, common * again**2 + own
        rows.append((k, "\n".join(a), "\n".join(b), both / size))
    df = spark.createDataFrame(rows, "k int, a string, b string, want double")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select("want", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("x")).collect():
        assert abs(r["x"] - r["want"]) < 0.25 and (r["want"] < 1 or r["x"] == 1.0)


def test_successors_with_repeats_and_no_ids(spark):
    rows = [(1, "a b c d."), (1, "a b c d."), (2, None), (None, "x y z w"), (None, "x y z w"), (None, "other one")]
    got = fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1] and first[0]["edited_sha256"] == hashlib.sha256(b"a b c ").hexdigest()
    alone = fingerprint.edited_pairs(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0


def test_long_unrelated_texts_are_not_alike(spark):
    a, b = (F.expr(f"array_join(transform(sequence(1, 600000), i -> concat('{x}', i)), '\n')") for x in "ab")
    row = fingerprint.with_fingerprint(fingerprint.with_fingerprint(spark.range(1).select(a.alias("x"), b.alias("y")), "x", "a"), "y", "b")
    got = row.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("x"), F.col("a.n").alias("n")).first()
    assert got["n"] == 600_000 and got["x"] < 0.25


def test_one_cell_and_rows_without_ids(spark):
    """All rows of one source and size, most without an id: they are dealt in buckets, and the counts come out."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, null) doc_id", "if(id < 1000, 'a', 'b') source", "'w w w' text")
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 3000 and all(r["copies"] in (0, 1, 2, 3) for r in rows)
    for total in (3000, 6000):
        part = [r for r in rows if r["source_size"] == total]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 3
    shards = sharding.shard_documents(docs.selectExpr("cast(null as long) doc_id", "text"), 40).collect()
    sizes = {}
    for r in shards:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 3 * 19


def test_mix_does_not_depend_on_splits(spark, tmp_path):
    """The same documents are taken whatever the splits and the shuffle partitions, equal rows included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.filter("doc_id % 7 = 0")).union(docs.filter("doc_id = 11").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k"))
    docs.repartition(6).write.parquet(f"{tmp_path}/docs")
    seen = []
    former = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        for split, parts in (("128m", "4"), ("64k", "4"), ("128m", "13")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(tuple, mixing.mix_report(spark.read.parquet(f"{tmp_path}/docs")).select("doc_id", "size", "taken").collect())))
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)
    assert seen[0] == seen[1] == seen[2]
