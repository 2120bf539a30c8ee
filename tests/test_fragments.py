"""Chunks over fragments against the sequential rule, token by token."""

import random
import re

import pytest

from filigree.operators import fragments as R

TOKEN = re.compile(r"(?:\w+|[^\w\s])\s*")


def plain_chunks(units, before, target, most, overlap):
    """The rule as a walk over tokens that carry their evidence: (start, tokens with evidence)."""
    row = [(w, e, k == 0) for text, e in units for k, w in enumerate(TOKEN.findall(text or ""))]
    ends, at = [], 0
    for text, _ in units:
        at += len(TOKEN.findall(text or ""))
        ends.append(at)
    goal, limit, over = R.budget(before, target, most, overlap)
    out, start, done = [], 0, 0
    while done < len(row):
        inside = [e for e in ends if e > start + goal]
        stop = min(inside[0] if inside else len(row), start + limit, len(row))
        out.append((start, row[start:stop]))
        done, start = stop, stop - over
    return out


def rendered(part):
    text = ""
    for k, (w, _, fresh) in enumerate(part):
        text = text.rstrip() + "\n" + w if fresh and k else text + w
    return text.rstrip()


@pytest.mark.parametrize("target, most, overlap, segment, bucket, parts", [(45, 70, 8, 64, 32, 5), (450, 700, 80, 65_536, 1024, None), (5, 9, 3, 16, 8, 3), (20, 20, 0, 50, 16, 2)])
def test_equals_the_walk(spark, monkeypatch, target, most, overlap, segment, bucket, parts):
    monkeypatch.setattr(R, "SEGMENT", segment)
    monkeypatch.setattr(R, "BUCKET", bucket)
    rnd = random.Random(target)
    rows = []
    for f in range(6):
        for section in ("a", None):
            for k in range(rnd.randint(0, 40)):
                n = rnd.choice([0, 1, 3, 10, 30, 120])
                rows.append((f, section, k, " ".join(rnd.choice(["w", "x1", "é", ".", "계약"]) for _ in range(n)) + rnd.choice(["", " ", "\n"]), f"ev{f}-{k // 2}"))
    rows += [(99, "a", 0, None, "none"), (98, "a", 0, "t " * 3000, "big"), (98, "a", 1, "u", "last")]
    df = spark.createDataFrame(rows, "f long, section string, seq long, body string, ev string").repartition(7)
    from pyspark.sql import functions as F

    prefix = F.concat(F.lit("Section: "), F.coalesce("section", F.lit("root")))
    got = {}
    for r in R.chunk_fragments(df, ["f", "section"], ["seq"], "body", "ev", prefix, target + 3, most + 3, overlap, parts).collect():
        got.setdefault((r["f"], r["section"]), []).append(r)
    for key in {(r[0], r[1]) for r in rows}:
        units = [(r[3], r[4]) for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])]
        want = plain_chunks(units, 3, target + 3, most + 3, overlap)
        mine = sorted(got.get(key, []), key=lambda r: r["ordinal"])
        assert [(r["ordinal"], r["start"], r["n_tokens"]) for r in mine] == [(k, s, len(p)) for k, (s, p) in enumerate(want)]
        for r, (_, part) in zip(mine, want):
            assert r["evidence_ids"] == list(dict.fromkeys(e for _, e, _ in part)) and r["text"] == rendered(part)


def test_no_room_and_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "a b c", "e")], "f long, seq long, body string, ev string")
    assert R.chunk_fragments(df, ["f"], ["seq"], "body", "ev", F.lit("one two three"), 2, 3, 1).count() == 0
    assert R.chunk_fragments(df.filter("false"), ["f"], ["seq"], "body", "ev").count() == 0
