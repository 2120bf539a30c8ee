"""Ranked lexical search as a blocked sparse matrix product (operator 11).

Terms are maximal runs of ASCII letters, digits and non-ASCII characters of the whole text, A-Z
lower-cased. The result is the product of two sparse matrices: item by term (how often the
item has the term) and term by document (a 64-bit integer impact). Both are cut in blocks. A block of documents
is a slice of a task's rows, turned into term-major rows in numpy; for each item the rows of its terms
are merged into one accumulator (Gustavson), and only the best ``k`` documents of the block so far
are kept. Best lists of tasks meet in two steps, so that no window holds a list of every task.

Passes. (1) Every text is cut once; of its terms those that the items may ask for are written beside
its number of terms. A bitmap of hashed item terms (``BITMAP`` bits, whatever the items) drops the
others early; it only spares space, as a join by the term itself decides. (2) N and L come from all rows of that
table and df from its terms. (3) Per block of items, whose terms are bounded by ``BLOCK_TERMS``, the
table is read and multiplied.

Numbers. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))) in doubles; a document's m is 75 +
(25 * n * N) div L; its impact is weight * ((1000000000 * tf) div (1000 * tf + 12 * m)).

Defined cases. Null texts and items have no terms; a document without terms is no document for N. Every
row is a document or an item of its own, so repeated rows each have results; equal scores go by ascending
doc_id (null last), then by row. Items without hits return no rows, and so do empty tables. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import texts_of
from filigree.session import materialize

#: Results an item, bits of the item terms' bitmap, (item, term) entries of an item block, and documents of a document block.
K, BITMAP, BLOCK_TERMS, BLOCK_DOCS = 20, 1 << 23, 1 << 18, 4096

#: Tasks whose best lists meet in one window before the last.
FAN = 64


def _letters() -> bytes:
    """A byte table: A-Z to lower case, other bytes that no term has to a blank."""
    keep = lambda b: b >= 128 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if keep(b) else 32 for b in range(256))


LETTERS = _letters()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(LETTERS).split()


def cells(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), dtype=np.uint64) & np.uint64(BITMAP - 1)


def bitmap_of(item_terms: DataFrame) -> np.ndarray:
    """The bitmap of an item-term table: bytes of it are or-ed on the executors, ``BITMAP`` bits come back at most."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells(x.as_py().encode() for x in batch.column(0))
            yield pa.RecordBatch.from_pydict({"byte": pa.array(at >> np.uint64(3), pa.int64()), "bit": pa.array(np.left_shift(1, (at & np.uint64(7)).astype(np.int64)), pa.int64())})

    bits = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in item_terms.select("term").distinct().mapInArrow(marks, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["byte"]] = r["bits"]
    return bits


def item_matrix(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): ``item`` numbers the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(texts_of(batch.column(2))):
                found = Counter(terms_of(text))
                one = batch.slice(k, 1)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0).take(pa.array([0] * n, pa.int32())), one.column(1).take(pa.array([0] * n, pa.int32())), pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["item", "item_id", "term", "times"],
                )

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(count, f"item long, item_id {kind}, term string, times long"), "item-terms")


def term_table(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc, doc_id, n, terms, tfs): one row per document; ``terms`` are those that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # BITMAP bits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        seen: dict[bytes, bool] = {}  # words met before, forgotten when there are too many
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in texts_of(batch.column(2)):
                words = terms_of(text)
                found = Counter(words)
                if len(seen) > 1 << 18:
                    seen.clear()
                new = [t for t in found if t not in seen]
                if new:
                    at = cells(new)
                    seen.update(zip(new, ((asked[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).tolist()))
                kept = {t: f for t, f in found.items() if seen.get(t)}
                ns.append(len(words))
                terms.append([t.decode() for t in kept])
                tfs.append(list(kept.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc", "doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(cut, f"doc long, doc_id {kind}, n long, terms array<string>, tfs array<long>"), "document-terms")


def weights(table: DataFrame, item_terms: DataFrame, n_docs: int) -> DataFrame:
    """(term, weight) of the terms that items and documents share."""
    df = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return df.join(item_terms.select("term").distinct(), "term", "left_semi").select("term", w.alias("weight"))


def item_block(rows: list) -> dict:
    """The item-by-term matrix of a block of items in sparse rows, with the terms' weights; it goes to every task."""
    names = sorted({r["term"] for r in rows})
    term = {t: k for k, t in enumerate(names)}
    weight = np.zeros(len(names), dtype=np.int64)
    per: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        t = term[r["term"]]
        weight[t] = r["weight"]
        per.setdefault(r["item"], []).append((t, r["times"]))
    items = sorted(per)
    return {"term": term, "weight": weight, "items": items, "rows": [np.array(per[i], dtype=np.int64) for i in items]}


def impacts(block: dict, ns: np.ndarray, terms: list, tfs: list, n_docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The term-by-document matrix of a block of documents in term-major sparse rows: start of each term's row, documents, impacts."""
    at = block["term"]
    t, d, f = [], [], []
    for k, (words, counts) in enumerate(zip(terms, tfs)):
        for word, tf in zip(words, counts):
            if (x := at.get(word)) is not None:
                t.append(x)
                d.append(k)
                f.append(tf)
    t, d, f = (np.array(x, dtype=np.int64) for x in (t, d, f))
    order = np.argsort(t, kind="stable")
    t, d, f = t[order], d[order], f[order]
    m = 75 + (25 * ns * n_docs) // max(length, 1)
    value = block["weight"][t] * ((1_000_000_000 * f) // (1000 * f + 12 * m[d]))
    return np.searchsorted(t, np.arange(len(block["weight"]) + 1)), d, value


def merged(row: np.ndarray, starts: np.ndarray, docs: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
    """Gustavson's step: the rows of an item's terms, each times its number, added up in ``total``."""
    for term, times in row:
        part = slice(starts[term], starts[term + 1])
        total[docs[part]] += times * values[part]  # a document is once in a term's row


def best_of(score: np.ndarray, doc_id: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score, then smallest id, then row."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((doc[near], doc_id[near], -score[near]))[:k]]


def block_lists(table: DataFrame, rows: list, n_docs: int, length: int, k: int) -> DataFrame:
    """(task, item, doc, no_id, key, score): every task's best ``k`` documents of each item of one block.

    ``key`` is the id as a number; ids that are no integers are ranked per block without it and so are handed on by ``doc`` alone.
    """
    shared = table.sparkSession.sparkContext.broadcast(item_block(rows))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        kept: dict[int, np.ndarray] = {}  # of each item: rows (score, no id, id, doc)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(at, BLOCK_DOCS)
                doc, ids, ns = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
                key = np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                starts, docs, values = impacts(block, ns, batch.column(3).to_pylist(), batch.column(4).to_pylist(), n_docs, length)
                total = np.zeros(batch.num_rows, dtype=np.int64)
                for i, row in enumerate(block["rows"]):
                    total[:] = 0
                    merged(row, starts, docs, values, total)
                    hit = np.flatnonzero(total)
                    if len(hit):
                        hit = hit[best_of(total[hit], key[hit], doc[hit], k)]
                        found = np.stack([total[hit], key[hit], doc[hit]])
                        if i in kept:
                            found = np.concatenate([kept[i], found], axis=1)
                            found = found[:, best_of(*found, k)]
                        kept[i] = found
        for i, found in kept.items():
            n = found.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([block["items"][i]] * n, pa.int64()), *[pa.array(x, pa.int64()) for x in found]], ["item", "score", "key", "doc"])

    ordered = table.select("doc", F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs")
    return ordered.mapInArrow(multiply, "item long, score long, key long, doc long").withColumn("task", F.spark_partition_id())


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0. doc_id is an integer."""
    asked = item_matrix(items)
    table = term_table(docs, bitmap_of(asked))
    size = table.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    known = materialize(asked.join(weights(table, asked, size["n"]), "term"), "item-weights")
    blocks = max(1, -(-known.count() // block_terms))
    order = [F.desc("score"), F.asc("key"), F.asc("doc")]
    lists = None
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "term", "times", "weight").collect()  # about ``block_terms`` entries
        found = block_lists(table, rows, size["n"], size["l"], k)
        near = Window.partitionBy("item", (F.col("task") / FAN).cast("int")).orderBy(*order)
        found = found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k).drop("r", "task")
        lists = found if lists is None else lists.unionByName(found)
    best = lists.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    named = asked.select("item", "item_id").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    no_id = F.col("key") == (1 << 63) - 1
    return best.join(named, "item").select("item_id", "rank", F.when(~no_id, F.col("key")).cast(kind).alias("doc_id"), "score")


#: The whole operator in SQL, over the same tables.
SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS doc
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
size AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
tf AS (SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(w) AS term FROM docs) GROUP BY doc, term),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item, item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
scored AS (
  SELECT item, item_id, doc, d.doc_id, CAST(sum(times * CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * d.n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN docs d USING (doc), size GROUP BY item, item_id, doc, d.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20"""
