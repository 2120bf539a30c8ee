"""Best-fit packing of token sequences by linear grouping (operator 2).

Sizes are whole token counts from 1 to the capacity, so the corpus reduces to a histogram of
``capacity`` numbers; the plan is made on that histogram, whatever the corpus size:

1. Linear grouping: large sizes, in descending order, fall into groups of equal cardinality,
   each rounded up to its largest member.
2. Few-size configurations: the linear programme over the configurations of those rounded
   sizes is solved by column generation (a knapsack over the capacity prices new ones).
3. Substitution: each configuration is used as often as the programme says, rounded down, those
   of the largest sizes first, with actual sizes in place of rounded ones; its last place takes
   the largest actual size that fits.
4. Best fit: what is left of the large sizes, then the small sizes, go in descending order
   where the least room remains.

The scheme runs for a few borders between small and large (``SHARES``), which leave room for one to
three large sizes in a configuration; the best plan counts. A plan is a list of runs (equal
sequences and their count), at most a few thousand. Documents meet it by their rank within their size, counted in salted buckets, by a broadcast of the runs
(bounded by the capacity, not by the corpus). Full pieces are one run, so half of all rows in
one size do no harm.

Ids are those of the public byte-level BPE file. The tiktoken build of the same vocabulary
encodes texts whose characters lie below U+0530, where both builds agree on character classes;
any other text, any text that spells a special token, any with ``RUN`` white-space characters in a
row (the fast build's pattern search overflows its stack on about a million) and any on which the
fast build fails goes through ``tokenizers``.

Defined cases: null or empty text is the end id alone (one piece of length 1); repeated rows
are packed as often as they occur; null ids are kept; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import shuffle_partitions, texts_of
from filigree.session import materialize

CAPACITY, END_ID = 1024, 2
#: Groups of large sizes; borders between small and large, as parts of the capacity.
GROUPS, SHARES = 64, (2, 3, 4)
SPECIAL, SAFE_BELOW = "<|endoftext|>", "԰"
RUN, BUCKET_ROWS = 100_000, 100_000
BLANKS = re.compile(r"\s+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- tokens -------------------------------------------------------------------------------


class Encoder:
    """Ids of the byte-level BPE vocabulary whose files lie in ``folder`` (default: the public package)."""

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        def path(name: str) -> str:
            return f"{folder}/{name}" if folder else public_tokenizers.path(name)

        self.slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
        with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text and (text.isascii() or max(text) < SAFE_BELOW) and longest_run(text) < RUN:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:  # a panic of the library is no Exception
                if type(error).__name__ != "PanicException":
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def longest_run(text: str) -> int:
    """The longest run of white space, if it may have ``RUN`` characters; one pass, as each run is met once."""
    if len(text) < RUN:
        return 0
    return max((m.end() - m.start() for m in BLANKS.finditer(text)), default=0)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first takes what is over."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.array([*encoder.ids(text), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# ---- plan ---------------------------------------------------------------------------------


def linear_groups(counts: np.ndarray, small: int, capacity: int, groups: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of groups of about equal cardinality over sizes in (small, capacity), largest first."""
    sizes = [s for s in range(capacity - 1, small, -1) if counts[s]]
    target = max(1, -(-sum(int(counts[s]) for s in sizes) // groups))
    out: list[tuple[int, int]] = []
    have, top = 0, None
    for s in sizes:
        top = s if top is None else top
        have += int(counts[s])
        if have >= target:
            out.append((s, top))
            have, top = 0, None
    if top is not None:
        out.append((sizes[-1], top))
    return out


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Column generation for the configuration programme: (how many of each size, how often)."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    size = np.array(sizes)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = inverse @ demand
        price = np.maximum(inverse.sum(axis=0), 0.0)
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):  # unbounded knapsack over the room
            best[room], take[room] = best[room - 1], -1
            fit = size <= room
            if fit.any():
                value = np.where(fit, price + best[np.maximum(room - size, 0)], -1.0)
                top = int(value.argmax())
                if value[top] > best[room] + 1e-12:
                    best[room], take[room] = value[top], top
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if take[room] < 0:
                room -= 1
            else:
                column[take[room]] += 1
                room -= size[take[room]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), float(amount[j])) for j in range(k) if amount[j] > 0]


class Runs:
    """Sequences under construction, equal ones together, found by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]

    def add(self, sizes: tuple[int, ...], count: int) -> None:
        self.by_room[self.capacity - sum(sizes)].append((sizes, count))

    def best_fit(self, size: int, count: int) -> None:
        """Place ``count`` items of one size, each where the least room remains."""
        room = size
        while count:
            while room <= self.capacity and not self.by_room[room]:
                room += 1
            if room > self.capacity:
                each = self.capacity // size
                if count // each:
                    self.add((size,) * each, count // each)
                if count % each:
                    self.add((size,) * (count % each), 1)
                return
            sizes, there = self.by_room[room].pop()
            placed = min(there, count)
            if placed < there:
                self.by_room[room].append((sizes, there - placed))
            self.add((*sizes, size), placed)
            count -= placed
            room = size

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [run for runs in self.by_room for run in runs]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, shares: tuple[int, ...] = SHARES) -> list[tuple[tuple[int, ...], int]]:
    """Runs (sizes of one sequence, how many such sequences) that hold every item of the histogram once.

    What counts as small is a parameter of the scheme: each border is tried, the fewest sequences win.
    """
    plans = [plan_at(counts, capacity, groups, capacity // s) for s in shares]
    return min(plans, key=lambda runs: sum(n for _, n in runs))


def plan_at(counts: np.ndarray, capacity: int, groups: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan for one border between small and large sizes."""
    left = np.asarray(counts, dtype=np.int64).copy()
    runs = Runs(capacity)
    if left[capacity]:
        runs.add((capacity,), int(left[capacity]))
        left[capacity] = 0
    spans = linear_groups(left, small, capacity, groups)
    if spans:
        demand = np.array([float(left[low : high + 1].sum()) for low, high in spans])
        found = configurations([high for _, high in spans], demand, capacity)
        # configurations with the largest sizes first, as their partners are the fewest
        for places, often in sorted(([g for g in range(len(spans)) for _ in range(amounts[g])], often) for amounts, often in found):
            todo = int(often + 1e-6)
            while todo > 0:
                sizes: list[int] = []
                room = capacity
                for nth, g in enumerate(places):
                    low, high = (small + 1, min(room, capacity - 1)) if nth == len(places) - 1 else (spans[g][0], min(spans[g][1], room))
                    used = np.bincount(np.array(sizes, dtype=int), minlength=capacity + 1)
                    there = np.flatnonzero(left[low : high + 1] - used[low : high + 1] > 0)
                    if len(there):
                        sizes.append(low + int(there[-1]))
                        room -= sizes[-1]
                if not sizes:
                    break
                kinds, each = np.unique(sizes, return_counts=True)
                often_now = int(min(todo, (left[kinds] // each).min()))
                left[kinds] -= each * often_now
                runs.add(tuple(sizes), often_now)
                todo -= often_now
    for size in range(capacity, 0, -1):
        if left[size]:
            runs.best_fit(size, int(left[size]))
    return runs.all()


def slots(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the items of a size go, by rank."""
    out, ranks, sequence = [], {}, 0
    for sizes, count in runs:
        offset = 0
        for size in sizes:
            rank = ranks.get(size, 0)
            out.append((size, rank, rank + count, sequence, offset))
            ranks[size] = rank + count
            offset += size
        sequence += count
    return out


# ---- operator -----------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, …), a written table, with sequence_id and offset added."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per size: capacity at most
        counts[row["length"]] = row["count"]
    # equal pieces differ in their row number, so no bucket holds all copies of one
    runs = max(shuffle_partitions(pieces), int(counts.sum()) // BUCKET_ROWS + 1)
    salted = pieces.withColumn("row", F.monotonically_increasing_id())
    salted = salted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(runs)))
    totals = salted.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row"))
    ranked = salted.withColumn("within", within).join(totals, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    table = spark.createDataFrame(slots(plan(counts, capacity)) or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"]))
    return placed.select(
        *[ranked[c] for c in pieces.columns], (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), table["offset"]
    )


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(tokenize(docs, capacity, folder), "pieces"), capacity)
