"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 6).

Every letter or mark is lower-cased by itself, every run of other characters becomes one blank,
and a text has a blank at both ends. Its n-grams of one to three characters, blanks included, are
hashed into ``2**BITS`` buckets. Counts per (language, bucket) are summed over all learning rows on
the executors; the log-probability matrix, bounded by languages x buckets, is broadcast.

A batch is one sparse matrix of texts by buckets: the n-grams of all its texts are made
together and brought to one entry (text, bucket, count) each; its product with the
log-probabilities is a gathering of rows and a sum by text. Batches are cut to ``STRETCH``
characters, longer texts into stretches whose sums are added, so memory stays bounded.

Defined cases: ``und`` with score 0 for a null text or one without a letter, and for every text
when there is nothing to learn from; equal posteriors go to the smaller language name; rows
without an id are not learned from; repeated rows are counted as often as they occur; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.llm.common import held_out, texts_of

BITS, ALPHA, UNKNOWN = 16, 0.5, "und"
STRETCH = 1 << 18
BLANK = 0x20


@cache
def code_table() -> np.ndarray:
    """Per code point its lower case if it is a letter or a mark, else a blank."""
    out = np.full(0x110000, BLANK, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, number of their text) of texts one after the other, each with single blanks between its runs of letters and at its ends."""
    size = np.array([len(t) + 2 for t in texts])
    code = table[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    owner = np.repeat(np.arange(len(texts)), size)
    keep = code != BLANK
    keep[1:] |= (code[:-1] != BLANK) | (owner[1:] != owner[:-1])
    keep[:1] = True
    return code[keep], owner[keep]


def ngrams(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams that lie within one text."""
    c = code.astype(np.uint64)
    one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (c[:-1] + c[1:] * np.uint64(0x1F123BB5) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (c[:-2] + c[1:-1] * np.uint64(0x1F123BB5) + c[2:] * np.uint64(0x5BD1E9955BD1) + np.uint64(13)) * np.uint64(0x165667B19E3779F9)
    in_two, in_three = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    bucket = np.concatenate([one, two[in_two], three[in_three]]) >> np.uint64(64 - BITS)
    return bucket.astype(np.int64), np.concatenate([owner, owner[:-1][in_two], owner[:-2][in_three]])


def entries(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse matrix of a batch: (text, bucket, count) sorted by text and bucket."""
    bucket, owner = ngrams(*characters(texts, table))
    key = np.sort((owner << BITS) | bucket)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] >> BITS, key[first] & ((1 << BITS) - 1), np.diff(np.append(first, len(key)))


def batches_of(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, stretches of their texts) of about ``STRETCH`` characters; a long text comes in several."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), STRETCH):
            part = text[at : at + STRETCH]
            if parts and size + len(part) > STRETCH:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, parts


def counts_by_language(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) summed over the rows of a table (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = code_table(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, parts in batches_of(list(texts_of(batch.column(1)))):
                names = sorted({langs[r] for r in rows})
                at = np.array([names.index(langs[r]) for r in rows])
                text, bucket, count = entries(parts, table)
                for k, name in enumerate(names):
                    mine = at[text] == k
                    total.setdefault(name, np.zeros(1 << BITS, dtype=np.int64))
                    total[name] += np.bincount(bucket[mine], weights=count[mine], minlength=1 << BITS).astype(np.int64)
        for lang, row in total.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(row[some])], names=["lang", "bucket", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, log probability per bucket and language) from rows (lang, text)."""
    rows = docs.filter("lang is not null and text is not null")
    prior = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(prior)
    at = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((1 << BITS, len(langs)))
    if langs:
        table = counts_by_language(rows).toPandas()  # languages x buckets at most
        counts[table["bucket"].to_numpy(), table["lang"].map(at).to_numpy()] = table["n"].to_numpy()
    logs = np.log(counts + ALPHA) - np.log(counts.sum(axis=0) + ALPHA * (1 << BITS))
    weight = np.array([prior[x] for x in langs], dtype=float)
    return langs, np.log(weight / weight.sum()) if langs else weight, logs.astype(np.float32)


def log_sums(texts: list[str], logs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts x languages: the product of the sparse count matrix with the log-probabilities."""
    out = np.zeros((len(texts), logs.shape[1]))
    for rows, parts in batches_of(texts):
        text, bucket, count = entries(parts, table)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        made = np.add.reduceat(logs[bucket] * count[:, None], first, axis=0, dtype=float)
        np.add.at(out, np.array(rows)[text[first]], made)
    return out


def predict_all(texts: list[str], langs: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[list[str], list[float]]:
    """(language, score) per text."""
    table = code_table()
    lettered = [any(c.isalpha() for c in t) for t in texts]
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total = log_sums(texts, logs, table) + prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], [float(x) if ok else 0.0 for x, ok in zip(score, lettered)]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and held_out as given, lang_pred and score from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logs = shared.value
        for batch in batches:
            found = predict_all(list(texts_of(batch.column(2))), langs, prior, logs)
            made = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "held_out", "text")
    kind = T.StructType([*rows.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those not held out."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    return identify(marked, train(marked.filter(~F.col("held_out"))))
