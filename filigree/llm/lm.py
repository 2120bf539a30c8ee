"""Language-model scoring with a hashed maximum-entropy model (operator 10).

Tokens are words of the ASCII-lower-cased text, then one end. Every training token is counted on
the executors (N, V and the counts c are exact, over all training rows).

Model. p(token | context) = p(class | context) p(member | class, context) p(token | member).
* A token's class is a hash of its last three bytes (``CLASSES`` of them). The class softmax has
  weights for hashed features of the context: the token before (n-gram), the token two before
  (skip) and the pair of their classes (n-gram of classes).
* Members of a class are its ``MEMBERS`` most frequent tokens, and one member for all others.
  Their softmax has a bias and weights for hashed features too: (token before, member) and
  (token two before, member); a context token has a bucket to itself if it is among the most frequent, else a
  hashed one, and all members of a class share the bucket's row, so a token costs two row reads.
* The tokens behind the last member share it by smoothed counts, one unknown token included.
So the probabilities of all tokens and one unknown token of each class add up to 1 in every context.

The numbers of buckets follow the number of distinct training tokens, up to the bounds ``HASHED``,
``BEFORE`` and ``SKIPPED``: 5 MB of weights at most.

Training by distributed gradient updates, of both softmaxes: in each round every task starts from
the broadcast weights, makes Adagrad steps on mini-batches of its part of the training rows, and
returns the change of each row of weights with the number of tokens that used it. Changes are
averaged on the executors, each row by its uses, and added.

Scoring is by numpy batches over several texts. Counts of tokens outside the ``TABLE`` most frequent (the
broadcast table, bounded by that parameter) are joined, so every token's exact count is used.

Defined cases: null text is empty, one end token; repeated rows count as often as they occur;
rows without an id are held out; with no training row N and V are 0 and base scores follow the
formula; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.llm.common import held_out, shuffle_partitions, texts_of
from filigree.session import materialize

CLASSES, MEMBERS, TABLE = 32, 32, 1 << 18
#: Bounds of the buckets of the class softmax (per feature) and of the member softmax (token before, token two before).
HASHED, BEFORE, SKIPPED = 1 << 13, 1 << 8, 1 << 7
ROUNDS, BATCH, RATE = 2, 1 << 13, 0.3
END = b"\n"  # no word holds white space
BLOCK_ROWS, TOKENS = 256, 1 << 15
SLOTS = MEMBERS + 1


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def tokens(text: str) -> list[bytes]:
    out = text.encode().lower().split()
    out.append(END)
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over the rows of a table (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update(tokens(text))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent tokens: their counts, classes and places among the members of their class."""

    def __init__(self, table: list[tuple[bytes, int]], total: int, distinct: int, all_of_class: np.ndarray):
        self.total, self.distinct = total, distinct
        self.number = {token: k for k, (token, _) in enumerate(table)}
        self.count = np.array([n for _, n in table] or [0], dtype=float)
        self.kind = np.array([class_of(token) for token, _ in table] or [0], dtype=np.int64)
        self.slot = np.full(len(self.kind), MEMBERS, dtype=np.int64)
        self.member_count = np.zeros((CLASSES, SLOTS))
        self.rest = all_of_class.copy()  # per class: tokens and kinds outside its members
        for c in range(CLASSES if table else 0):
            own = np.flatnonzero(self.kind == c)[:MEMBERS]  # the table is in order of frequency
            self.slot[own] = np.arange(len(own))
            self.member_count[c, : len(own)] = self.count[own]
            self.rest[:, c] -= self.count[own].sum(), len(own)
        self.member_count[:, MEMBERS] = self.rest[0] + 0.5 * (self.rest[1] + 1)
        bits = lambda most, share: min(most, 1 << max(4, int(distinct // share).bit_length()))
        self.hashed, self.before, self.skipped = bits(HASHED, 16), bits(BEFORE, 512), bits(SKIPPED, 1024)

    @staticmethod
    def of(state: dict) -> Vocabulary:
        """The vocabulary with the given attributes: plain data, as broadcast."""
        out = object.__new__(Vocabulary)
        vars(out).update(state)
        return out

    def encode(self, texts: list[list[bytes]]) -> Encoded:
        words = [w for t in texts for w in t]
        get = self.number.get
        known = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        kind, slot = self.kind[known], self.slot[known]
        outside = np.flatnonzero(known < 0)
        kind[outside] = np.fromiter((class_of(words[i]) for i in outside), dtype=np.int64, count=len(outside))
        slot[outside] = MEMBERS
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
        return Encoded(self, words, known, kind, slot, starts)


def bucket(who: np.ndarray, buckets: int, seed: int) -> np.ndarray:
    """Numbers below half of the buckets have their own, the others share the rest by hash."""
    half = buckets // 2
    shared = half + (((who.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % half
    return np.where(who < half, who, shared)


class Encoded:
    """Tokens of several texts: their numbers, classes, places among members, and the weight rows of their contexts."""

    def __init__(self, v: Vocabulary, words: list[bytes], known: np.ndarray, kind: np.ndarray, slot: np.ndarray, starts: np.ndarray):
        self.words, self.known, self.kind, self.slot, self.starts = words, known, kind, slot, starts
        who = np.where(known >= 0, known + 1, len(v.kind) + 1 + kind)  # 0: before the text
        one, two, kind_one, kind_two = (np.concatenate([[0] * back, x[:-back]])[: len(x)] for x, back in ((who, 1), (who, 2), (kind, 1), (kind, 2)))
        for back, x in ((0, one), (0, two), (0, kind_one), (0, kind_two), (1, two), (1, kind_two)):
            at = starts + back
            at = at[at < np.append(starts[1:], len(known))]  # the second token only where there is one
            x[at] = 0
        h = v.hashed
        self.class_rows = np.stack([bucket(one, h, 1), h + bucket(two, h, 2), 2 * h + kind_two * CLASSES + kind_one, np.full(len(known), class_width(v) - 1)], axis=1)
        b = v.before * CLASSES
        self.member_rows = np.stack([bucket(one, v.before, 3) * CLASSES + kind, b + bucket(two, v.skipped, 4) * CLASSES + kind, b + v.skipped * CLASSES + kind], axis=1)


def class_width(v: Vocabulary) -> int:
    """Rows of the class softmax: two hashed features, pairs of classes, one bias."""
    return 2 * v.hashed + CLASSES * CLASSES + 1


def first_weights(v: Vocabulary, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member weights before training: biases from counts, all else zero."""
    classes = np.zeros((class_width(v), CLASSES), dtype=np.float32)
    classes[-1] = np.log((of_class + 0.5) / (of_class.sum() + 0.5 * CLASSES))
    members = np.zeros(((v.before + v.skipped + 1) * CLASSES, SLOTS), dtype=np.float32)
    with np.errstate(divide="ignore"):
        bias = np.log(v.member_count / v.member_count.sum(axis=1, keepdims=True))
    members[-CLASSES:] = np.maximum(bias, -1e4)  # places that no token has
    return classes, members


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row of features the sum of its rows of weights, less its largest cell."""
    z = np.take(weights, rows[:, 0], axis=0)
    for column in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, column], axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z


def learn_batch(weights: np.ndarray, speed: np.ndarray, uses: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step of a softmax on a mini-batch, in place."""
    z = logits(weights, rows)
    np.exp(z, out=z)
    z *= (1 / (len(z) * z.sum(axis=1)))[:, None]
    z[np.arange(len(z)), target] -= np.float32(1 / len(z))
    for column in range(rows.shape[1]):
        key = rows[:, column].astype(np.uint16)  # fewer than 2^16 rows: sorted by digits
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        slope = z.sum(axis=0, keepdims=True) if len(first) == 1 else np.add.reduceat(np.take(z, order, axis=0), first, axis=0)
        at = sorted_[first].astype(np.int64)
        speed[at] += np.einsum("ij,ij->i", slope, slope)
        uses[at] += np.diff(np.append(first, len(key)))
        slope *= (-RATE / np.sqrt(speed[at] + np.float32(1e-10)))[:, None]
        weights[at] += slope


SUMMED = "what string, at long, uses binary, cells binary"


def sum_batch(what: str, at: int, uses: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([what]), pa.array([at]), pa.array([uses.tobytes()]), pa.array([cells.tobytes()])], names=["what", "at", "uses", "cells"])


def text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with the tokens of their texts, of about ``TOKENS`` tokens (one text at least)."""
    for batch in batches:
        held: list[list[bytes]] = []
        start = size = 0
        for n, text in enumerate(texts_of(batch.column(column))):
            held.append(tokens(text))
            size += len(held[-1])
            if size >= TOKENS:
                yield batch.slice(start, n + 1 - start), held
                held, start, size = [], n + 1, 0
        if held:
            yield batch.slice(start), held


def training_round(docs: DataFrame, vocabulary, classes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member weights after one round over ``docs`` (text)."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = Vocabulary.of(vocabulary.value), shared.value
        now = [w.copy() for w in start]
        speed, uses = ([np.zeros(len(w), dtype=np.float32) for w in start] for _ in range(2))
        for _, texts in text_batches(batches, 0):
            e = v.encode(texts)
            for at in range(0, len(e.kind), BATCH):
                part = slice(at, at + BATCH)
                learn_batch(now[0], speed[0], uses[0], e.class_rows[part], e.kind[part])
                learn_batch(now[1], speed[1], uses[1], e.member_rows[part], e.slot[part])
        for what, w, first, used in zip("cm", now, start, uses):
            change = (w - first).astype(np.float16)
            for row in range(0, len(w), BLOCK_ROWS):
                if used[row : row + BLOCK_ROWS].any():
                    yield sum_batch(what, row, used[row : row + BLOCK_ROWS], change[row : row + BLOCK_ROWS])

    made = docs.select("text").mapInArrow(run, SUMMED).repartition(shuffle_partitions(docs), "what", "at").mapInArrow(average_blocks, SUMMED)
    out = [classes.copy(), members.copy()]
    for row in made.toLocalIterator():  # the model's own size, once
        w = out["cm".index(row["what"])]
        cells = np.frombuffer(row["cells"], dtype=np.float32).reshape(-1, w.shape[1])
        w[row["at"] : row["at"] + len(cells)] += cells
    return out[0], out[1]


def average_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Average the changes of a partition's blocks as they stream by, each row by its uses: one sum per block is held."""
    total: dict[tuple[str, int], list] = {}
    for batch in batches:
        for what, at, uses, cells in zip(*(c.to_pylist() for c in batch.columns)):
            used = np.frombuffer(uses, dtype=np.float32).astype(float)
            change = np.frombuffer(cells, dtype=np.float16).astype(float).reshape(len(used), -1) * used[:, None]
            have = total.setdefault((what, at), [np.zeros_like(used), np.zeros_like(change)])
            have[0] += used
            have[1] += change
    for (what, at), (used, change) in total.items():
        yield sum_batch(what, at, used.astype(np.float32), (change / np.maximum(used, 1)[:, None]).astype(np.float32))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent tokens, all of a count or none, ``most`` at most; most frequent first.

    The border count comes from a histogram of counts (exact below 2^16, in 64ths of octaves
    above), so no more than the table itself reaches the driver.
    """
    n = F.col("n")
    cell = F.when(n < (1 << 16), n).otherwise((1 << 16) + F.floor((F.log2(n.cast("double")) - 16) * 64)).cast("long")
    have, border = 0, None
    for r in sorted(counts.groupBy(cell.alias("cell")).count().collect(), key=lambda r: -r["cell"]):  # fewer than 2^17 rows
        have += r["count"]
        if have > most:
            break
        border = r["cell"]
    if border is None:
        return []
    rows = counts.filter(cell >= border).select("token", "n").toArrow()
    return sorted(zip(rows["token"].to_pylist(), rows["n"].to_pylist()), key=lambda r: (-r[1], r[0]))


def train(docs: DataFrame, counts: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Vocabulary, class weights and member weights from training rows (doc_id, text) and their counts."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    table = most_frequent(counts, TABLE)
    kind = F.crc32(F.when(F.length("token") > 3, F.expr("substring(token, -3)")).otherwise(F.col("token"))) % CLASSES
    of_class = np.zeros((2, CLASSES))
    for r in counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows
        of_class[:, r["kind"]] = r["n"], r["v"]
    v = Vocabulary(table, total["n"] or 0, total["v"], of_class)
    classes, members = first_weights(v, of_class[0])
    if total["v"]:
        shared = docs.sparkSession.sparkContext.broadcast(vars(v))
        for r in range(ROUNDS):
            classes, members = training_round(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == r), shared, classes, members)
    return v, classes, members


def log_probabilities(e: Encoded, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Natural logs of p(class | context) p(member | class, context) of every token."""
    out = np.empty(len(e.kind))
    for at in range(0, len(out), BATCH):
        part = slice(at, at + BATCH)
        out[part] = 0.0
        for weights, rows, target in ((classes, e.class_rows[part], e.kind[part]), (members, e.member_rows[part], e.slot[part])):
            z = logits(weights, rows)
            out[part] += z[np.arange(len(z)), target]
            np.exp(z, out=z)
            out[part] -= np.log(z.sum(axis=1, dtype=float))
    return out


TALLY = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())]))
SCORED = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("rare", TALLY)]


def score_rows(docs: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, members: np.ndarray) -> DataFrame:
    """rid, doc_id, held_out, the parts of the scores that the broadcast table decides, and the other tokens (``rare``)."""
    shared = docs.sparkSession.sparkContext.broadcast((vars(vocabulary), classes, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, classes, members = shared.value
        v = Vocabulary.of(state)
        base_log = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
        count_log, rest_log = np.log10(v.count + 0.5), np.log10(v.rest[0] + 0.5 * (v.rest[1] + 1))
        for rows, texts in text_batches(batches, 3):
            e = v.encode(texts)
            there, other = e.known >= 0, e.slot == MEMBERS
            known_log = np.where(there, count_log[e.known], 0.0)
            # tokens behind "any other of the class": the table's now, the rest by a join
            score = log_probabilities(e, classes, members) / np.log(10) + np.where(other, known_log - rest_log[e.kind], 0.0)
            size = np.diff(np.append(e.starts, len(e.kind)))
            sums = [np.add.reduceat(x, e.starts) for x in (there.astype(np.int64), known_log, score)]
            rare = []
            for at, n in zip(e.starts, size):
                missing = Counter(e.words[at + i] for i in np.flatnonzero(~there[at : at + n]))
                rare.append([{"token": t, "n": k} for t, k in missing.items()])
            made = [size, sums[0], sums[1] - size * base_log, sums[2], rare]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *(pa.array(c, t) for c, t in zip(made, kinds))], names=["rid", "doc_id", "held_out", *(n for n, _ in SCORED)])

    rows = docs.select("rid", "doc_id", "held_out", "text")
    made = reduce(lambda s, f: s.add(*f), SCORED, T.StructType(rows.schema.fields[:3]))
    return rows.mapInArrow(run, made)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    learn = marked.filter(~F.col("held_out"))
    counts = materialize(token_counts(learn), "token-counts")
    vocabulary, classes, members = train(learn, counts)
    found = materialize(score_rows(marked.withColumn("rid", F.monotonically_increasing_id()), vocabulary, classes, members), "scores")
    # exact counts of the tokens outside the broadcast table: log10(c + 0.5), c = 0 if never seen
    rare = found.select("rid", F.explode("rare").alias("t")).select("rid", "t.token", F.col("t.n").alias("times"))
    rare = rare.join(counts, "token", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"),
    )
    logs, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return found.drop("rare").join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + seen).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
