"""SimHash near-duplicate detection over a byte-position inverted index (operator 1).

Fingerprint. Words are runs of non-white-space of the ASCII-lower-cased text; a shingle is
three neighbouring words joined by a space, repeats included (with one or two words the whole
sequence; with none the fingerprint is zero). A bit is 1 if it is set in more than half of
the shingles' XXH64 values.

Linking. Two 64-bit fingerprints that differ in at most two bits share at least six of their eight
positional bytes, so the count filter keeps pairs with a tally of six or more. The inverted index
does not list single bytes, whose postings grow with the corpus: a posting key is a block of four
positional bytes, two of the four pairs of bytes. As two missing bytes spoil two pairs at most,
every pair of fingerprints with six shared bytes meets under one of the six blocks. In a posting
of up to ``LONG`` values the shared positional bytes of its pairs are tallied, those below six
dropped and the others verified by Hamming distance. A longer posting is split: its values are
posted again under their block and two more of the other four bytes. There every pair has its six
bytes already and differs in two bytes only, so a posting holds 65,536 distinct values at most and
is verified by looking up each value's 136 neighbours. Links leave a posting as a star (value,
smallest linked value), never as pairs.

Stage. ``dedup_alike`` has a contract of its own: two texts are near copies if their sets of five-word
shingles have a Jaccard similarity of 0.8 or more. Their 64-bit fingerprints differ in some ten bits, so the
stage takes a wider SimHash of the set (2,432 bits), under the same steps: an inverted index over its positional bytes,
a count filter on the tally of shared positional bytes, Hamming distance; the exact similarity of the whole sets follows.
A bit of a pair at 0.8 differs with 0.161 at most (0.151 but for small sets), a byte is shared with 0.245.
The index is read in two steps. Over all texts a posting key is a block of two positional bytes (140 blocks; a pair
meets with 0.9998), and a posting tells only which texts have a partner by the Hamming distance of 192 other bits, five standard
deviations above what is expected; two texts that have nothing in common are that near with 6e-9, so their number does not grow with
the square of the corpus. Over these, a posting is one positional byte and holds the whole fingerprints: pairs below the least tally
or above the Hamming border of their sizes are dropped. Each text's nearest of another component is verified first; then every pair of two
components, each in the first posting that it shares. Long postings are dealt in blocks that bring every pair together.
What may be missed is a pair at the border: 0.0002 by either index, 0.0001 by the filters, less above 0.8.

Defined cases: null or wordless text: fingerprint 0, linked like any other; a null id is kept
and never names a component while another member has an id; repeated rows each get a row; an
empty table gives an empty result; extra columns are ignored (``dedup`` and ``dedup_alike`` keep them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.operators.components import connected_components
from filigree.session import discard, materialize, spare_name

SHINGLE, SEED, MAX_BITS, CHUNK = 3, 42, 2, 1 << 16

#: The stage: words of a shingle, least similarity, and the chance with which an index may miss a pair at that similarity.
WIDTH, SIMILARITY, MISS = 5, 0.8, 2e-4

#: The least tally of shared positional bytes (two bits spoil two bytes at most), and the longest posting that is tallied as a whole.
SHARED, LONG = 6, 256

#: Counted rows of two numbers up to which the stage broadcasts a list (1 MB).
BROADCAST = 1 << 16

#: The stage: sets of so few shingles get more blocks; words of the fingerprint that are the sketch; positions of a round of
#: nearest texts, and rounds; texts and pairs handled at once. Postings of the stage are read as a whole up to so many times ``long``.
SMALL, SKETCH, NEAREST, ROUNDS, TEXTS, PAIRS = 5, 3, 4, 3, 512, 1 << 15
POSTING = 32

#: Blocks of four positional bytes: two of the four pairs (0, 1), (2, 3), (4, 5), (6, 7).
BLOCKS = [(*a, *b) for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]

#: What may differ within one long posting: the two bytes that its key of six leaves out.
FREE_BYTES = list(combinations(range(8), 2))


def simhash(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) >= SHINGLE else [b" ".join(words)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    value = np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0]
    return int(value)


@F.pandas_udf(T.LongType())
def simhash_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(x) for x in texts], dtype="int64")


def _near_masks() -> np.ndarray:
    one = [1 << i for i in range(16)]
    return np.array([*one, *(x | y for x, y in combinations(one, 2))], dtype=np.int64)


def lowest(near: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of links the smallest row that it is connected with."""
    root = np.arange(len(near))
    while True:
        low = np.where(near, root[None, :], len(near)).min(axis=1)
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def star(v: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    return [(int(v[k]), int(v[root[k]])) for k in np.flatnonzero(root != np.arange(len(v)))]


def tallied_star(values: np.ndarray) -> list[tuple[int, int]]:
    """A posting by count filtering: tally shared positional bytes per pair, keep six or more, verify the distance."""
    v = np.sort(values)
    digits = v.view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(v), len(v)), dtype=np.int8)
    for position in range(8):
        tally += digits[:, None, position] == digits[None, :, position]
    near = tally >= SHARED
    near &= np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64)) <= MAX_BITS
    return star(v, lowest(near))


def neighbour_star(values: np.ndarray, free: tuple[int, int]) -> list[tuple[int, int]]:
    """A split posting: ``values`` are equal outside the two ``free`` bytes, so their distance is that of 16 bits."""
    v = np.sort(values)
    i, j = free
    u = v.view(np.uint64)
    key = (((u >> np.uint64(8 * i)) & np.uint64(255)) | (((u >> np.uint64(8 * j)) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
    at = np.full(1 << 16, -1, dtype=np.int64)
    at[key] = np.arange(len(v))
    root = np.arange(len(v))
    while True:
        low = root.copy()
        for mask in _near_masks():
            other = at[key ^ mask]
            there = other >= 0
            low[there] = np.minimum(low[there], root[other[there]])
        low = low[low]
        if (low == root).all():
            return star(v, root)
        root = low


EDGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


@F.pandas_udf(EDGES)
def tallied_star_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([tallied_star(np.asarray(x, dtype=np.int64)) for x in values])


@F.pandas_udf(EDGES)
def neighbour_star_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for free, values in batches:
        yield pd.Series([neighbour_star(np.asarray(x, dtype=np.int64), FREE_BYTES[c]) for c, x in zip(free, values)])


def byte_mask(positions: tuple[int, ...]) -> int:
    """The mask of some positional bytes as a signed 64-bit number."""
    m = sum(255 << 8 * i for i in positions)
    return m - 2**64 if m >= 2**63 else m


def index_entries(fps: Column, keys: list[tuple[int, tuple[int, ...]]]) -> Column:
    """One struct(block, key) per key: its number and the fingerprint's bytes at its positions."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias("block"), fps.bitwiseAND(F.lit(byte_mask(at))).alias("key")) for n, at in keys]))


def link_fingerprints(fingerprints: DataFrame, long: int = LONG) -> DataFrame:
    """Distinct ``fp`` values to star edges (a, b) that connect exactly what two bits or less connect."""
    index = fingerprints.select("fp", index_entries(F.col("fp"), list(enumerate(BLOCKS))).alias("k")).select("fp", "k.block", "k.key")
    # counted first (a partial sum in each task), so that no list longer than ``long`` is ever gathered
    sizes = materialize(index.groupBy("block", "key").agg(F.count("*").alias("size")).filter("size > 1"), "postings")
    short = index.join(sizes.filter(F.col("size") <= long), ["block", "key"]).groupBy("block", "key").agg(F.collect_list("fp").alias("fps"))
    edges = short.select(F.explode(tallied_star_udf("fps")).alias("e"))
    split = index.join(sizes.filter(F.col("size") > long), ["block", "key"])
    free = F.lit(None).cast("array<struct<block:int,key:bigint>>")
    for n, block in enumerate(BLOCKS):
        others = [i for i in range(8) if i not in block]
        six = [(FREE_BYTES.index(left), tuple(i for i in range(8) if i not in left)) for left in combinations(others, 2)]
        free = F.when(F.col("block") == n, F.array(*[F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(byte_mask(at))).alias("key")) for k, at in six])).otherwise(free)
    again = split.select("fp", F.explode(free).alias("k")).select("fp", F.col("k.block").alias("free"), F.col("k.key").alias("key")).distinct()
    wide = again.groupBy("free", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    more = wide.select(F.explode(neighbour_star_udf("free", "fps")).alias("e"))
    return edges.unionByName(more).select("e.a", "e.b").distinct()


def components(marked: DataFrame) -> DataFrame:
    """(fp, component_id, keep_rid) of a table (rid, doc_id, fp); keep_rid is the row that stays of a component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    nodes = materialize(marked.groupBy("fp").agg(first.alias("low")), "fingerprints")
    roots = connected_components(link_fingerprints(nodes.select("fp"))).withColumnRenamed("node", "fp")
    of = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("root"))
    lows = of.groupBy("root").agg(F.min("low").alias("low"))
    return of.select("fp", "root").join(lows, "root").select(
        "fp", F.col("low.doc_id").alias("component_id"), F.col("low.rid").alias("keep_rid")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = docs.select("doc_id", simhash_udf("text").alias("fp"))
    marked = materialize(marked.withColumn("rid", F.monotonically_increasing_id()), "simhash")
    found = marked.join(components(marked), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with one of each component kept: that of the smallest id. Columns stay as they are."""
    mark, rid = spare_name(docs, "fp"), spare_name(docs, "rid")
    kept = docs.withColumns({mark: simhash_udf("text"), rid: F.monotonically_increasing_id()})
    kept = materialize(kept, "dedup")
    marked = kept.select(F.col(rid).alias("rid"), "doc_id", F.col(mark).alias("fp"))
    keep = components(marked).select(F.col("keep_rid").alias(rid)).distinct()
    return kept.join(keep, rid, "left_semi").select(*docs.columns)


# ---- the pipeline's stage -----------------------------------------------------------------


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles of ``width`` words of a text as sorted XXH64 values (shorter texts: the whole sequence)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles)))


def differing(similarity: float, small: bool = False) -> float:
    """With what chance a bit of two sets of this similarity differs at most (``small``: sets of four and five shingles).

    What is added to the arc of the cosine was enumerated over all sets of up to 124 shingles at 0.8.
    """
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) + (0.036 if small else 0.0097)


def blocks(similarity: float) -> int:
    """Blocks of two positional bytes under one of which a pair of this similarity meets but for ``MISS``; a multiple of four for whole words."""
    return 4 + int(np.log(MISS) / np.log1p(-((1 - differing(similarity)) ** 16))) // 4 * 4


def positions(similarity: float) -> int:
    """The same for single positional bytes, small sets included."""
    return 1 + int(np.log(MISS) / np.log1p(-((1 - differing(similarity, True)) ** 8)))


def words_of(similarity: float) -> int:
    """64-bit words of the fingerprint: the blocks, then the sketch."""
    return blocks(similarity) // 4 + SKETCH


def wide_simhash(shingles: np.ndarray, words: int) -> bytes:
    """The wide fingerprint of a set: a bit is 1 if set in over half the members' hashes, each mixed anew (splitmix64) for each word."""
    seeds = np.random.default_rng(SEED).integers(1 << 64, size=words, dtype=np.uint64)
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(shingles), 255):  # so many sum up within a byte
        h = shingles[at : at + 255, None] + seeds
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def marks_udf(width: int, words: int):
    """struct(node, size, fp) of a text: the hash of its set of shingles, their number and the set's wide fingerprint."""

    @F.pandas_udf("node long, size long, fp binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            nodes, sizes, fps = [], [], []
            for text in texts:
                shingles = shingle_set(text, width)
                nodes.append(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0).astype(np.int64))
                sizes.append(len(shingles))
                fps.append(wide_simhash(shingles, words))
            yield pd.DataFrame({"node": np.array(nodes, dtype=np.int64), "size": np.array(sizes, dtype=np.int64), "fp": fps})

    return udf


def shingle_set_udf(width: int):
    @F.pandas_udf("array<long>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, width).view(np.int64) for x in texts])

    return udf


def alike_udf(similarity: float):
    """Whether two sets of shingles have at least this Jaccard similarity."""

    @F.pandas_udf("boolean")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
        return pd.Series([n >= similarity * (len(x) + len(y) - n) - 1e-9 for n, x, y in zip(both, a, b)], dtype=bool)

    return udf


def fingerprints(column) -> np.ndarray:
    """Rows of positional bytes of a column of binary values."""
    values = list(column)
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)


def sketch_of(fps: np.ndarray) -> np.ndarray:
    """The sketch of fingerprints as rows of ``SKETCH`` numbers, as ``sketch_columns`` reads it."""
    return np.ascontiguousarray(fps[:, -8 * SKETCH :]).view(">i8").astype(np.int64)


def sketch_columns(words: int) -> dict[str, Column]:
    """The sketch of a fingerprint ``fp`` of so many words, as columns."""
    return {f"s{k}": F.conv(F.hex(F.substring("fp", 8 * (words - SKETCH + k) + 1, 8)), 16, -10).cast("long") for k in range(SKETCH)}


def sketch_borders(p: float, words: int = SKETCH) -> tuple[int, int]:
    """The largest Hamming distance of the first word and of all words of a sketch, where a bit differs with ``p``: five standard deviations."""
    return tuple(int(n * p + 5 * np.sqrt(n * p * (1 - p))) for n in (64, 64 * words))


def block_postings(similarity: float):
    """Batches (size, fp) to (key, sketch): a row per block of two positional bytes. The sketch stands for the text."""
    n = blocks(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                fps = fingerprints(part.column("fp").to_pylist())
                small = part.column("size").to_numpy(zero_copy_only=False) <= SMALL
                digits = fps[:, : 2 * n].astype(np.int64)
                sketch = sketch_of(fps)
                # small sets, of which more bits may differ, also post the pairs of bytes between the blocks
                for first, rows in ((0, np.arange(len(fps))), (1, np.flatnonzero(small))):
                    left, right = digits[rows, first : 2 * n - first : 2], digits[rows, first + 1 : 2 * n : 2]
                    keys = (2 * np.arange(left.shape[1]) + first << 16) + (left << 8) + right
                    of = np.repeat(rows, left.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(sketch[of, k]) for k in range(SKETCH)]], ["key", *(f"s{k}" for k in range(SKETCH))])

    return run


def partnered(similarity: float, long: int, named: bool = True):
    """Batches (key, node, sketch), sorted by key, to the nodes that have a partner in their posting: one within the Hamming border of the sketch.

    In a posting of more than ``long`` every node counts as having one. If not ``named``, batches are (key, sketch) and the sketch is returned.
    """
    sketched = 2 if named else 1

    def found(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(rows))
        left = np.repeat(ends, ends - starts) - np.arange(len(rows))  # rows to the posting's end, itself included
        has = np.repeat(ends - starts > long, ends - starts)
        at, gap = np.flatnonzero(~has & (left > 1)), 1
        sketch = rows[:, sketched:].view(np.uint64)
        some, most = sketch_borders(differing(similarity), sketch.shape[1])
        head = np.ascontiguousarray(sketch[:, 0])
        while len(at):
            near = at[np.bitwise_count(head[at] ^ head[at + gap]) <= some]
            near = near[~(has[near] & has[near + gap])]
            near = near[np.bitwise_count(sketch[near] ^ sketch[near + gap]).sum(axis=1) <= most]
            has[near] = has[near + gap] = True
            gap += 1
            at = at[left[at] > gap]
        return rows[has]

    def give(rows: np.ndarray) -> pa.RecordBatch:
        names = ["node"] if named else [f"s{k}" for k in range(rows.shape[1] - 1)]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1 + k]) for k in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = rows if kept is None else np.concatenate([kept, rows])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            last = starts[-1]  # this posting may go on in the next batch
            if last:
                yield give(found(rows[:last], starts[:-1]))
            kept = rows[last:]
            if len(kept) > long:
                yield give(kept)
                kept = kept[-long - 1 :]
        if kept is not None:
            yield give(found(kept, np.zeros(1, dtype=np.int64)))

    return run


def partnered_texts(nodes: DataFrame, similarity: float, long: int) -> DataFrame:
    """Those of ``nodes`` (node, size, fp) that meet a partner in a block of two positional bytes, as a written table.

    Texts of one sketch count as one; that only adds texts.
    """
    names = sketch_columns(words_of(similarity))
    index = nodes.filter("size > 0").select("size", "fp").mapInArrow(block_postings(similarity), f"key long, {', '.join(f'{c} long' for c in names)}")
    postings = index.repartition("key").sortWithinPartitions("key")
    some = materialize(postings.mapInArrow(partnered(similarity, long, False), ", ".join(f"{c} long" for c in names)).distinct(), "partnered")
    texts = materialize(nodes.filter("size > 0").withColumns(names).join(bounded(some), list(names), "left_semi").select(nodes.columns), "partnered-texts")
    discard(some)
    return texts


def byte_keys(at: list[int]) -> Column:
    """The posting keys of a fingerprint: position and byte, for each position of ``at``."""
    return F.array(*[F.lit(256 * k).cast("long") + F.conv(F.hex(F.substring("fp", k + 1, 1)), 16, 10).cast("long") for k in at])


def borders(one: np.ndarray, other: np.ndarray, similarity: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(least tally of positional bytes, largest Hamming distance) of sets of these sizes that are alike; a distance of -1 if none can be."""
    common = np.ceil(similarity / (1 + similarity) * (one + other) - 1e-9)
    p = np.arccos(np.minimum(1, common / np.sqrt(one * other))) / np.pi + 0.31 / np.maximum(one, other)
    shared = (1 - p) ** 8
    tally = bits / 8 * shared - 4 * np.sqrt(bits / 8 * shared * (1 - shared))
    distance = np.where(np.minimum(one, other) >= common, bits * p + 4 * np.sqrt(bits * p * (1 - p)), -1)
    return tally, distance


def close_pairs(fps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, similarity: float, former: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance), i < j, of a posting's pairs of different labels that share none of the ``former`` bytes and pass the tally and the Hamming distance."""
    words, found = fps.view(np.uint64), []
    sketch = words[:, -SKETCH:]
    head = np.ascontiguousarray(sketch[:, 0])
    some, most = sketch_borders(differing(similarity, True))
    step = max(1, PAIRS // len(fps))
    for at in range(0, len(fps), step):
        # the columns before ``at`` have met these rows already
        i, j = np.nonzero(np.bitwise_count(head[at : at + step, None] ^ head[None, at:]) <= some)
        i, j = i[i < j] + at, j[i < j] + at
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most
        near &= labels[i] != labels[j]
        i, j = i[near], j[near]
        distance = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        tally, border = borders(sizes[i].astype(float), sizes[j].astype(float), similarity, 8 * fps.shape[1])
        keep = distance <= border
        same = fps[i[keep]] == fps[j[keep]]
        keep[keep] = (same.sum(axis=1) >= tally[keep]) & ~same[:, former].any(axis=1)
        found.append((i[keep], j[keep], distance[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def posting_pairs(similarity: float, nearest: bool, first: int):
    """Pairs (a, b) to verify of one block (key, i, j) of a posting: each text's nearest of another label, or every pair of two labels.

    In the latter case a pair counts in the first posting, from position ``first`` on, that both texts share.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        nodes, fps, position = rows["node"].to_numpy(), fingerprints(rows["fp"]), int(rows["key"].iloc[0]) >> 8
        former = slice(0, 0) if nearest else slice(first, position)
        i, j, distance = close_pairs(fps, rows["size"].to_numpy(), rows["label"].to_numpy(), similarity, former)
        if nearest:
            ends = np.concatenate([i, j])
            order = np.lexsort((np.concatenate([j, i]), np.concatenate([distance, distance]), ends))
            of = order[np.unique(ends[order], return_index=True)[1]] % max(1, len(i))
            i, j = i[np.unique(of)], j[np.unique(of)]
        return pd.DataFrame({"a": nodes[i], "b": nodes[j]})

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are alike."""
    one, other = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").filter(alike_udf(similarity)("set_a", "set_b")).select("a", "b")


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast if they are counted to be ``BROADCAST`` at most, else as they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


class Links:
    """The sets looked up, and the labels of what the verified pairs connect."""

    def __init__(self, sets_of, similarity: float):
        self.sets_of, self.similarity = sets_of, similarity
        self.labels = self.known = None

    def labelled(self, nodes: DataFrame) -> DataFrame:
        if self.labels is None:
            return nodes.withColumn("label", F.col("node"))
        return nodes.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def sets(self, pairs: DataFrame) -> DataFrame:
        """The sets of the pairs' nodes; those not met before are made from their texts and written, each once."""
        involved = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "involved")
        new = involved if self.known is None else materialize(involved.join(self.known.select("node"), "node", "left_anti"), "involved")
        if new.limit(1).count():
            made = materialize(self.sets_of(new), "shingle-sets")
            if self.known is None:
                self.known = made
                return made
            self.known = self.known.unionByName(made)
        return self.known.join(bounded(involved), "node", "left_semi")

    def verify(self, pairs: DataFrame) -> None:
        """Those of the pairs whose sets are alike join the labels."""
        pairs = materialize(pairs.distinct(), "pairs")
        if pairs.limit(1).count():
            edges = materialize(verified(pairs, self.sets(pairs), self.similarity), "alike")
            if edges.limit(1).count():
                self.absorb(edges)
        discard(pairs)

    def absorb(self, edges: DataFrame) -> None:
        """Labels with new edges: only the components that these join are labelled anew."""
        if self.labels is None:
            self.labels = connected_components(edges)
            return
        of = lambda c: self.labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
        between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        moved = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
        every = self.labels.unionByName(moved.select(F.col("label").alias("node"), "label").join(self.labels.select("node"), "node", "left_anti"))
        self.labels = materialize(every.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def dealt(texts: DataFrame, labelled: DataFrame, at: list[int], long: int) -> DataFrame:
    """The postings of single positional bytes, with a block (key, i, j): one of a posting up to ``long``, else one of each two parts."""
    sizes = texts.select(F.explode(byte_keys(at)).alias("key")).groupBy("key").count()
    wide = {r["key"]: -(-2 * r["count"] // long) for r in sizes.filter(F.col("count") > long).collect()}  # 256 a position at most
    index = labelled.withColumn("key", F.explode(byte_keys(at)))
    parts = F.lit(1)
    if wide:
        parts = F.coalesce(F.create_map(*[F.lit(x).cast("long") for kv in wide.items() for x in kv])[F.col("key")], F.lit(1))
    own = index.withColumn("parts", parts.cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    every = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return every.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "own", "other")


def link_sets(nodes: DataFrame, sets_of, similarity: float, long: int = LONG) -> DataFrame:
    """(node, label) of the nodes that verified similarity connects; ``nodes`` (node, size, fp), ``sets_of(nodes)`` gives (node, set)."""
    texts = partnered_texts(nodes, similarity, POSTING * long)
    links, every = Links(sets_of, similarity), positions(similarity)
    rounds = [(every + NEAREST * k, NEAREST, True) for k in range(ROUNDS)]
    for first, count, nearest in [*rounds, (0, every, False)]:
        at = dealt(texts, links.labelled(texts), list(range(first, first + count)), POSTING * long)
        links.verify(at.groupBy("key", "i", "j").applyInPandas(posting_pairs(similarity, nearest, first), "a long, b long"))
    discard(texts)
    if links.labels is None:
        return nodes.select("node", F.col("node").alias("label")).filter("false")
    return links.labels


def dedup_alike(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, long: int = LONG) -> DataFrame:
    """The documents with one of each near-duplicate group kept: that of the smallest id. Columns stay as they are.

    Groups are connected by a Jaccard similarity of at least ``similarity`` between the sets of
    ``width``-word shingles, verified exactly.
    """
    mark, rid = spare_name(docs, "mark"), spare_name(docs, "rid")
    kept = docs.withColumns({mark: marks_udf(width, words_of(similarity))("text"), rid: F.monotonically_increasing_id()})
    kept = materialize(kept, "dedup")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(rid).alias("rid"))).alias("low")
    light = kept.select("doc_id", F.col(rid).alias(rid), *[F.col(f"{mark}.{c}").alias(c) for c in ("node", "size", "fp")])
    nodes = materialize(light.groupBy("node").agg(low, F.first("size").alias("size"), F.first("fp").alias("fp")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.select("node", F.col("low.rid").alias(rid)).join(bounded(wanted), "node")
        return kept.select(rid, "text").join(bounded(rows), rid).select("node", shingle_set_udf(width)("text").alias("set"))

    labels = link_sets(nodes.select("node", "size", "fp"), sets_of, similarity, long)
    of = nodes.join(labels, "node", "left").select("low", F.coalesce("label", "node").alias("root"))
    keep = of.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.rid").alias(rid))
    return kept.join(keep, rid, "left_semi").select(*docs.columns)


__all__ = ["components", "dedup", "dedup_alike", "link_fingerprints", "link_sets", "near_duplicates", "neighbour_star", "shingle_set", "simhash", "tallied_star", "wide_simhash"]
