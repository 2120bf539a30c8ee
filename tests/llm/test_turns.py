"""Operator 13 against the enumeration of all repairs, its SQL, and a plain fold for large conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import oracle
from pyspark.sql import functions as F

from filigree.llm import turns, turns_sql
from filigree.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
NAME = {"u": "user", "a": "assistant"}


def after_damage(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x, r = {1: "", 2: re.sub("[.!?]", "", x)}.get(k, x), "user" if k == 4 else r
        out += [(t, r, x)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(), q[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        y = x.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not y else 2 if (r, x) in seen else 3 if y[-1] not in ".!?" else 0)
        seen.add((r, x))
    return out


def figures(rows, found):
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(found.count(k) for k in (1, 2, 3)), illegal)


def hashed(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def every_repair(rows, found, inserts=2):
    """The least (cost, audit) over all edits of every row and up to two insertions at every place."""
    best = None
    places = [x for n in range(inserts + 1) for x in product("ua", repeat=n)]
    per_row = [[("D", None)] if k in (1, 2) else [("D", None), ("K", None), ("R", "u"), ("R", "a")] for k in found]
    for edits in product(*per_row):
        for extra in product(places, repeat=len(rows) + 1):
            cost, audit, initials, lines = 0, "", "", []
            for at in range(len(rows) + 1):
                for i in extra[at]:
                    cost, audit, initials, lines = cost + 3, audit + "I", initials + i, [*lines, f"{NAME[i]}:"]
                if at < len(rows):
                    (edit, to), (_, r, x) = edits[at], rows[at]
                    audit += edit
                    cost += 4 if edit == "D" else (3 if edit == "R" else 0) + (3 if found[at] == 3 else 0)
                    if edit != "D":
                        r = NAME.get(to, r)
                        initials, lines = initials + (r[:1] or "?"), [*lines, f"{r}:{x}"]
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashed(lines))
    return best


def plain_fold(rows, found):
    """State to (cost, audit, lines), row by row."""
    def inserted(b):
        for _ in range(3):
            for st, (co, au, li) in list(b.items()):
                to = "a" if st == "u" else "u"
                v = (co + 3, au + "I", (*li, f"{NAME[to]}:"))
                if to not in b or v[:2] < b[to][:2]:
                    b[to] = v
        return b

    ways = inserted({"": (0, "", ())})
    for (_, r, x), k in zip(rows, found):
        new = {}
        for st, (co, au, li) in ways.items():
            to, p = "a" if st == "u" else "u", 3 if k == 3 else 0
            options = [(st, (co + 4, au + "D", li))]
            if k not in (1, 2):
                options.append((to, (co + p + 3, au + "R", (*li, f"{NAME[to]}:{x}"))))
                if r[:1] == to or (r[:1] == "s" and st == ""):
                    options.append((r[:1], (co + p, au + "K", (*li, f"{r}:{x}"))))
            for s, v in options:
                if s not in new or v[:2] < new[s][:2]:
                    new[s] = v
        ways = inserted(new)
    cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
    return cost, audit, hashed(lines)


def expected(rows, repair):
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for c, of in by.items():
        left = after_damage(of)
        found = faults(left)
        out[c] = (*figures(left, found), *repair(left, found))
    return out


def got(df, **kw):
    return {r[0]: tuple(r[1:]) for r in turns.repair(df, **kw).collect()}


def rows_at_random(seed, n, conversations, texts, last_turn):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "unknown"]
    return [(rnd.choice(conversations), rnd.choice([None, *range(last_turn)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


def test_equals_every_repair(spark):
    rows = rows_at_random(1, 330, [None, *range(160)], [None, "", "a.", "b!", "c", "d", "e?", "f. \n", "g  "], 50)
    rows = [r for c in {r[0] for r in rows} for r in [x for x in rows if x[0] == c][:3]]
    rows = [r for r in rows if len(after_damage([x for x in rows if x[0] == r[0]])) <= 4]
    assert len(rows) > 200
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows, every_repair)


def test_equals_sql(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        assert oracle.compare(op13_conversation_repair(spark, folder), oracle.connection(folder), turns_sql.SQL) == ""


def test_large_conversations(spark):
    """A conversation with most rows, in blocks folded over several levels; some begin, some end with insertions."""
    rows = rows_at_random(2, 2500, [1] * 8 + [None, 2, *range(3, 40)], [None, "", "c"] + [f"{k}{e}" for k in range(60) for e in ".!?x"], 900)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("c", "pos", "block", "fault", "copy", "size")})
    want = expected(rows, plain_fold)
    assert got(df, long=20, chunk=4) == want
    assert got(df) == want


def test_equal_rows_and_blanks(spark):
    rows = [(5, 1, "user", "same.")] * 300 + [(6, t, "user", " ") for t in range(40)] + [(7, None, "system", "x" * 200_000)] + [(8, t, "assistant", "a" + " " * 100_000 + "b") for t in (1, 3)]
    df, want = spark.createDataFrame(rows, SCHEMA), expected(rows, plain_fold)
    assert got(df, long=50, chunk=16) == want and got(df) == want


def test_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(3, gone, "user", "hi.")], SCHEMA)
    assert got(df) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(df.filter("false")) == {}
