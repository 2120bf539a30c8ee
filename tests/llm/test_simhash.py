"""Operator 1 against a brute-force version."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    known = sorted(set(fps))
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, f in zip(ids, fps):
        r = find(f)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(find(f)) for f in fps]


@given(st.text(alphabet="aB é\t\n\x0b\xa0Z9", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.simhash(text) & (2**64 - 1) == plain_fingerprint(text)


def test_large_posting_equals_small():
    rng = random.Random(1)
    base = 0x0123456789ABCDEF
    values = np.array(sorted({base & ~0xFFFF | rng.getrandbits(16) for _ in range(600)}), dtype=np.int64)
    want = plain_components(list(range(len(values))), [int(v) for v in values])
    for edges in (simhash.neighbour_star(values, (0, 1)), simhash.tallied_star(values)):
        got = {int(v): int(v) for v in values}
        got.update(dict(edges))
        groups = {}
        for k, v in enumerate(values):
            groups.setdefault(want[k], set()).add(got[int(v)])
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_postings_are_split(spark):
    """A block of four bytes that all share; two values are linked across the others, and postings above the limit lose no link."""
    rng = random.Random(5)
    values = sorted({0x0123456700000000 | rng.getrandbits(12) << 16 | rng.getrandbits(3) for _ in range(400)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = plain_components(list(range(len(values))), values)
    for long in (8, 10_000):
        from filigree.operators.components import connected_components

        label = {r["node"]: r["label"] for r in connected_components(simhash.link_fingerprints(fps, long)).collect()}
        groups = {}
        for k, v in enumerate(values):
            groups.setdefault(want[k], set()).add(label.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_by_bit_flips(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        for n in (1, 2, 3):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    rows = [(i, f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)] + [(900, 0, 900), (901, 3, 901), (902, 15, 902)]
    marked = spark.createDataFrame(rows, "doc_id long, fp long, rid long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(marked).collect()}
    want = plain_components([r[0] for r in rows], [r[1] & (2**64 - 1) for r in rows])
    assert [got[r[1]] for r in rows] == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], [f"{f:016x}" for f in fps], plain_components([r["doc_id"] for r in rows], fps)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def plain_kept(rows, least=0.8):
    """Smallest ids of the groups that five-word Jaccard similarity connects, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if group[i] != group[j] and n >= least * (len(a) + len(sets[j]) - n):
                group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for (doc_id, _), g in zip(rows, group):
        low[g] = min(low.get(g, doc_id), doc_id)
    return sorted(low.values())


def test_stage_finds_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 5, 8, 12):
            new = list(words)
            for at in rng.sample(range(200), edits):
                new[at] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in simhash.dedup_alike(docs).collect()) == want
    assert len({r["component_id"] for r in simhash.near_duplicates(docs).collect()}) > len(want)  # two of 64 bits do not reach them


def test_stage_long_postings_and_stars(spark):
    """Copies that are alike to their original only, in postings far above the limit."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(60):
        new = list(base)
        for at in rng.sample(range(300), 5):
            new[at] = f"n{rng.randrange(10**6)}"
        rows.append((k + 1, " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert len(want) < 5
    for long in (8, 256):
        assert sorted(r["doc_id"] for r in simhash.dedup_alike(docs, long=long).collect()) == want


def test_stage_near_threshold(spark):
    """Groups of 30 texts of pairwise similarity 0.786 with one pair at 0.802: that pair is found in every group."""
    rng = random.Random(9)
    rows, want = [], 0
    for g in range(20):
        core = [f"g{g}c{k}" for k in range(92)]
        for k in range(30):
            tail = [f"g{g}t{k}x{j}" for j in range(12)]
            if k in (3, 17):
                tail[0] = f"g{g}shared"
            rows.append((len(rows), " ".join(core + tail)))
    rng.shuffle(rows)
    want = plain_kept([r for r in rows if r[1].startswith("g0c")])
    assert len(want) == 29
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.dedup_alike(docs).count() == 20 * 29


def test_stage_fingerprint():
    """A bit of the wide fingerprint is set in over half of the members' mixed hashes, also beyond the 255 that are summed at once."""
    for n in (0, 1, 4, 600):
        members = np.random.default_rng(n).integers(1 << 64, size=n, dtype=np.uint64)
        want = [0] * 128
        for h in members.tolist():
            for k, seed in enumerate(np.random.default_rng(simhash.SEED).integers(1 << 64, size=2, dtype=np.uint64).tolist()):
                z = (h + seed) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                z ^= z >> 31
                for b in range(64):
                    want[64 * k + b] += z >> b & 1
        got = np.unpackbits(np.frombuffer(simhash.wide_simhash(members, 2), dtype=np.uint8), bitorder="little")
        assert got.tolist() == [2 * x > n for x in want]


def test_stage_partners_across_batches():
    """Who has a partner in a posting does not depend on where batches end; in a long posting everybody has one."""
    rng = random.Random(6)
    rows = []
    for key, n in enumerate([1, 2, 7, 40, 1, 3, 12]):
        base = [rng.getrandbits(62), rng.getrandbits(62)]
        for _ in range(n):
            near = rng.random() < 0.5
            rows.append((key, len(rows), *(x ^ 1 << rng.randrange(62) if near else rng.getrandbits(62) for x in base)))
    most = 20
    want = {r[1] for r in rows if key_size(rows, r[0]) > most}
    want |= {x[1] for x in rows for y in rows if x[1] != y[1] and x[0] == y[0] and (x[2] ^ y[2]).bit_count() + (x[3] ^ y[3]).bit_count() <= 41}
    for size in (1, 2, 5, 30, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + size])], ["key", "node", "s", "t"]) for at in range(0, len(rows), size)]
        got = [x for b in simhash.partnered(0.8, most)(iter(batches)) for x in b.column(0).to_pylist()]
        assert set(got) == want


def key_size(rows, key):
    return sum(r[0] == key for r in rows)


def test_stage_verifies_what_hamming_distance_leaves(spark, monkeypatch):
    """Candidates come from SimHash: all pass the Hamming border, and of a large group few pairs are looked at. Texts of eight and nine words are found too."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(120):
        new = list(base)
        for at in rng.sample(range(150), 3):
            new[at] = f"n{k}x{at}"
        rows.append((k + 1, " ".join(new)))
    for k in range(100):
        words = [f"s{k}x{j}" for j in range(9)]
        rows += [(1000 + 2 * k, " ".join(words[:8])), (1001 + 2 * k, " ".join(words))]
    seen, before = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, sets, s: (seen.extend(pairs.join(sets.withColumnsRenamed({"node": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "y"}), "b").collect()), before(pairs, sets, s))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.dedup_alike(docs).collect()) == plain_kept(rows)
    words = simhash.words_of(0.8)
    for r in seen:
        x, y = (np.array(r[c], dtype=np.int64).view(np.uint64) for c in "xy")
        one, other = (np.frombuffer(simhash.wide_simhash(v, words), dtype=np.uint8) for v in (x, y))
        tally, border = simhash.borders(np.array([len(x)]), np.array([len(y)]), 0.8, 64 * words)
        assert np.bitwise_count(one ^ other).sum() <= border[0] and (one == other).sum() >= tally[0]
    assert 0 < len(seen) < 121 * 120 / 4


def test_stage_partners_are_near(spark):
    """Of many unrelated texts that meet in a posting only those with a near partner go on, so their number does not grow with the square of the corpus."""
    rng = np.random.default_rng(12)
    fps = rng.integers(256, size=(3000, 8 * simhash.words_of(0.8)), dtype=np.uint8)
    fps[:, :8] = 7  # all meet in four blocks
    fps[1] = fps[0]
    fps[1, -simhash.SKETCH * 8 :: 2] ^= 3  # 24 of the sketch's bits differ
    nodes = spark.createDataFrame([(k, 100, x.tobytes()) for k, x in enumerate(fps)], "node long, size long, fp binary").repartition(3)
    assert {r["node"] for r in simhash.partnered_texts(nodes, 0.8, 4096).collect()} == {0, 1}
