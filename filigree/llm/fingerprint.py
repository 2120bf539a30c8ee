"""Homomorphic multiset fingerprints of documents (operator 4), in DataFrame functions only.

A text is a multiset of paragraphs: runs of text that end with a line or, within a line, with a
clause or sentence (a sign of ``. ! ? … 。 , ; :`` and white space behind it), so that a text of
one line has parts too. Every paragraph is hashed to a wide vector, and a fingerprint is the sum
of its paragraphs' vectors:

* ``sums``: ``4 x SEEDS x SHIFTS`` lanes of 0 or 1, four to a 60-bit number, added modulo 2^60;
* ``whole``: ``SEEDS`` hashes, added modulo 2^56;
* ``n``: 1, so the sum is the number of paragraphs.

So the order of paragraphs does not matter, equal multisets give equal fingerprints, and
inserting and deleting a paragraph is an addition and a subtraction (``with_combined``).

Likeness comes from the same sums. With c the count of ones in a lane, 2 c - n is a sum of one
random sign per paragraph, so the mean of its square over all lanes estimates |A|^2 = sum of
squared multiplicities, and that of the difference of two fingerprints |A - B|^2. The likeness is
1 - |A - B|^2 / (|A|^2 + |B|^2), that is 2 A.B / (|A|^2 + |B|^2): 1 for equal multisets, about 0
for disjoint ones; its spread is about 1 / sqrt(lanes) = 0.075. A lane is read to the nearest
number to its expected half of n, which holds to some 6e7 paragraphs.

``edited_pairs`` needs each document's successor by id. Light keys (id, text hashes) are ordered
by ranges; each document then hands the head that its predecessor needs to it, so whole texts
move once, and equal rows are one before they move.

Defined cases: null text is the empty text (all sums 0; two empty texts have likeness 1); null
ids come after all others; among equal ids the text's hashes decide; rows that repeat id and text
count as one document in the order and each get a row; a sole document is its own successor; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.ordering import with_previous
from filigree.session import spare_name

SEEDS, SHIFTS, LANE = 3, 15, 15
#: One bit in each of four lanes; a number of four lanes; a whole sum.
ONES, PACKED, WHOLE = sum(1 << (LANE * k) for k in range(4)), (1 << 4 * LANE) - 1, (1 << 56) - 1
LANE_MASK, HALF = (1 << LANE) - 1, 1 << (LANE - 1)

#: Where paragraphs part: line ends, and white space behind a sign that ends a clause or sentence.
BREAKS = r"[\x0A-\x0D]+|(?<=[.!?…。,;:])[\x20\x09]+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda p: F.trim(p) != "")


def total(hashes: Column, part, modulus: int) -> Column:
    """Sum of ``part(h)`` over the hashes, kept below a power of two so that it never leaves a long."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + part(h)).bitwiseAND(F.lit(modulus)))


def seeded(seed: int):
    return lambda p: F.xxhash64(F.lit(seed), p)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column added: struct(n, whole, sums, power).

    ``power`` is the estimated sum of squared multiplicities. Steps are columns of their own, so
    that each is computed once and no expression nests deeply.
    """
    parts, *hashes = (spare_name(df, x) for x in ("parts", *(f"hashes_{s}" for s in range(SEEDS))))
    out = df.withColumn(parts, paragraphs(F.col(text)))
    out = out.withColumns({h: F.transform(parts, seeded(s)) for s, h in enumerate(hashes)})

    def lane(shift: int):
        return lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(ONES))

    sums = F.struct(
        F.size(parts).cast("long").alias("n"),
        F.array(*[total(F.col(h), lambda x: x.bitwiseAND(F.lit(WHOLE)), WHOLE) for h in hashes]).alias("whole"),
        F.array(*[total(F.col(h), lane(j), PACKED) for h in hashes for j in range(SHIFTS)]).alias("sums"),
    )
    return with_power(out.withColumn(name, sums).drop(parts, *hashes), name)


def with_power(df: DataFrame, name: str) -> DataFrame:
    fp = F.col(name)
    return df.withColumn(name, F.struct(fp["n"].alias("n"), fp["whole"].alias("whole"), fp["sums"].alias("sums"), mean_square(fp["sums"], fp["n"]).alias("power")))


def mean_square(packed: Column, n: Column) -> Column:
    """Mean over all lanes of (2 c - n)^2, where ``packed`` holds the lane counts c and ``n`` is a number of paragraphs (or a difference)."""
    middle = F.floor(n / 2)
    odd = n - 2 * middle
    bias = F.pmod(F.lit(HALF) - middle, F.lit(1 << LANE)) * F.lit(ONES)  # brings every lane to HALF + its distance from the middle
    shifted = F.transform(packed, lambda x: F.pmod(x + bias, F.lit(PACKED + 1)))

    def square(x: Column, lane: int) -> Column:
        away = 2 * (F.shiftright(x, LANE * lane).bitwiseAND(F.lit(LANE_MASK)) - F.lit(HALF)) - odd
        return away.cast("double") * away

    squares = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + square(x, 0) + square(x, 1) + square(x, 2) + square(x, 3))
    return squares / F.lit(4.0 * SEEDS * SHIFTS)


def with_combined(df: DataFrame, a: str, b: str, name: str, sign: int = 1) -> DataFrame:
    """``df`` with the fingerprint of two columns' multisets together (``sign`` 1) or of the first without the second (-1).

    So ``b`` may be the fingerprint of one paragraph that is inserted or deleted.
    """

    def added(modulus: int):
        return lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(modulus + 1))

    x, y = F.col(a), F.col(b)
    both = F.struct((x["n"] + F.lit(sign) * y["n"]).alias("n"), F.zip_with(x["whole"], y["whole"], added(WHOLE)).alias("whole"), F.zip_with(x["sums"], y["sums"], added(PACKED)).alias("sums"))
    return with_power(df.withColumn(name, both), name)


def digest(fp: Column) -> Column:
    """The fingerprint as hex text: number, whole sums, lane sums."""

    def hexed(x: Column, digits: int) -> Column:
        return F.lpad(F.lower(F.hex(x)), digits, "0")

    return F.concat(hexed(fp["n"], 8), F.array_join(F.transform(fp["whole"], lambda x: hexed(x, 14)), ""), F.array_join(F.transform(fp["sums"], lambda x: hexed(x, 15)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two fingerprints' multisets, 0 to 1; exactly 1 for equal ones."""
    apart = mean_square(F.zip_with(a["sums"], b["sums"], lambda x, y: x - y), a["n"] - b["n"])
    share = F.lit(1.0) - apart / F.greatest(a["power"] + b["power"], F.lit(1e-9))
    same = (a["n"] == b["n"]) & (a["whole"] == b["whole"]) & (a["sums"] == b["sums"])
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    key = ["no_id", "id", "t1", "t2"]
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text")
    )
    order = marked.select(*key, F.char_length("text").alias("n")).distinct()
    before = with_previous(order, key, "before").select(*key, F.col("before.n").alias("n_before"), *[F.col(f"before.{k}").alias(f"{k}_before") for k in key])
    # equal rows become one in each task; the filter keeps their number in both uses, so that they share one exchange
    each = with_fingerprint(marked, "text", "fp").groupBy(*key).agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("fp").alias("fp")).filter("copies > 0")
    heads = each.join(before, key).select(
        *[F.col(f"{k}_before").alias(k) for k in key], F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_before") / 4).cast("int")).alias("head"), F.col("fp").alias("next_fp")
    )
    pairs = each.join(heads, key)
    kept = F.col("n") - F.floor(F.col("n") / 4).cast("int")
    pairs = pairs.withColumn("n", F.char_length("text")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("head")))
    pairs = with_fingerprint(pairs, "edited", "edited_fp")
    made = pairs.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "copies",
    )
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
