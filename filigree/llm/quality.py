"""Quality classification by positive-unlabelled learning (operator 8).

Every document becomes a few shape statistics of its whole text (repetition, signs, digits,
lines, word lengths). Trusted positives are rows labelled good; all documents are the unlabelled
web text; labels of bad rows are never used. The class prior is estimated from how a first
positive-against-unlabelled classifier ranks both: the smallest ratio of unlabelled to positive
mass above any threshold that keeps most positives. A linear model then minimises the non-negative unbiased risk
pi R_p+ + max(0, R_u- - pi R_p-): Newton steps on the logistic loss, whose sums (one vector and
one matrix of the feature count) are gathered from all rows on the executors.

Defined cases: null, empty or wordless text has zero statistics and gets a score like any other;
with no trusted positive the score is 0; repeated label rows count once as their largest label;
rows without an id are scored but not trusted; an empty table gives an empty result;
``keep_good`` keeps all other columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.llm.common import held_out
from filigree.session import discard, materialize, spare_name

SIGNS = re.compile(r"[^\w\s]{2,}")
CLASSES = {"letter": r"[A-Za-z\x80-\xff]", "upper": r"[A-Z]", "digit": r"[0-9]", "space": r"[ \t]", "line": r"\n", "shout": r"!", "sign": r"[$%&*#@^~=+|<>{}\[\]_/\\]"}
BYTE_CLASS = np.array([[bool(re.match(p, chr(b))) for p in CLASSES.values()] for b in range(256)], dtype=float)
WIDTH = 8 + len(CLASSES)
FLOOR, ROUNDS, RIDGE = 0.75, 14, 0.02
#: The share of the commonest word is drawn to this one as by so many words, so that it means as much in short texts as in long ones.
PRIOR_SHARE, PRIOR_WORDS = 0.04, 20
#: A text of so many words counts half.
FEW = 8


def statistics(text: str | None) -> np.ndarray:
    """The feature vector of one text."""
    text = text or ""
    words = text.split()
    out = np.zeros(WIDTH)
    if not words:
        return out
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    shares = np.bincount(raw, minlength=256) @ BYTE_CLASS / len(raw)
    n = len(words)
    seen = Counter(words)
    lines = 1 + text.count("\n")
    again = sum(map(eq, words, words[1:])) / n
    out[:8] = [
        np.log1p(n) / 8,
        len(seen) / n ** 0.9,
        np.sqrt(again),
        np.sqrt((max(seen.values()) + PRIOR_SHARE * PRIOR_WORDS) / (n + PRIOR_WORDS)),
        np.sqrt(seen.get("|", 0) / n),
        np.sqrt(len(SIGNS.findall(text)) / n),
        (len(raw) - shares[3] * len(raw)) / n / 10,
        np.log1p(n / lines) / 8,
    ]
    out[8:] = np.sqrt(shares)
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def statistics_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([statistics(x).astype(np.float32) for x in texts])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), WIDTH)


def sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over all rows (x, trusted) of the vector that ``make(x, trusted)`` gives per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += make(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["cell", "value"])

    out = np.zeros(width)
    cells = rows.select("x", "trusted").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    for row in cells.collect():  # width rows
        out[row["cell"]] = row["value"]
    return out


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, drawn to the mean where a text is short and they say little, and a constant."""
    words = np.expm1(8 * x[:, :1])
    return np.concatenate([np.clip((x - mean) / scale, -8, 8) * words / (words + FEW), np.ones((len(x), 1))], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from histograms over the same ascending score cells."""
    p, u = np.cumsum(positive[::-1]) / positive.sum(), np.cumsum(unlabelled[::-1]) / unlabelled.sum()
    enough = p >= FLOOR
    slack = 0.25 / np.sqrt(positive.sum())  # few positives: rather a high prior, which keeps documents
    return float(np.clip(((u + slack) / np.maximum(p, 1e-12))[enough].min(), 0.05, 0.99))


def fit(rows: DataFrame) -> dict | None:
    """The model from a table (x, trusted) of all documents; None without a trusted row."""
    k = WIDTH
    base = sums(rows, lambda x, t: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), t.sum()]]), 2 * k + 2)
    n, trusted = base[-2:]
    if not trusted:
        return None
    mean = base[:k] / n
    scale = np.sqrt(np.maximum(base[k : 2 * k] / n - mean**2, 1e-6))
    d = k + 1
    ridge = RIDGE + 0.5 / trusted

    def newton(prior: float | None) -> np.ndarray:
        """``prior`` None: plain positive-against-unlabelled regression, both sides weighing one."""
        w = np.zeros(d)
        for _ in range(ROUNDS):

            def make(x: np.ndarray, t: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                x = design(x, mean, scale)
                z = x @ w
                s = sigmoid(z)
                bend = s * (1 - s)
                pos = t > 0
                return np.concatenate(
                    [x.T @ s, ((x.T * bend) @ x).ravel(), x[pos].sum(0), x[pos].T @ s[pos], ((x[pos].T * bend[pos]) @ x[pos]).ravel(), [softplus(z).sum(), softplus(z[pos]).sum()]]
                )

            g = sums(rows, make, d + d * d + d + d + d * d + 2)
            cut = np.cumsum([d, d * d, d, d, d * d])
            gu, hu, xp, gp, hp, risk = np.split(g, cut)
            gu, hu, xp, gp, hp = gu / n, hu.reshape(d, d) / n, xp / trusted, gp / trusted, hp.reshape(d, d) / trusted
            if prior is None:  # R_p+ + R_u-
                slope, bend = gu + (gp - xp), hu + hp
            else:
                negative = risk[0] / n - prior * risk[1] / trusted
                # pi R_p+ has slope pi (gp - xp); R_u- - pi R_p- has slope gu - pi gp
                slope = gu - prior * xp if negative >= 0 else -(gu - prior * gp)
                bend = hu
            slope = slope + ridge * w
            step = np.linalg.solve(bend + (ridge + 1e-6) * np.eye(d), slope)
            size = np.abs(step).max()
            w = w - step * min(1.0, 3.0 / max(size, 1e-12))
            if size < 1e-4:
                break
        return w

    first = newton(None)
    cells = 400

    def ranked(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        at = np.minimum((sigmoid(design(x, mean, scale) @ first) * cells).astype(int), cells - 1)
        return np.concatenate([np.bincount(at[t > 0], minlength=cells), np.bincount(at, minlength=cells)])

    found = sums(rows, ranked, 2 * cells)
    prior = estimate_prior(found[:cells], found[cells:])
    return {"mean": mean, "scale": scale, "prior": prior, "weights": newton(prior)}


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids (column _good_id) of the trusted positives: labelled good, with an id, not held out."""
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return good.filter(F.col("q") > 0).filter(~held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("_good_id"))


def learn(measured: DataFrame, labels: DataFrame) -> dict | None:
    """The model from a table (doc_id, x): statistics of every document. No text moves for it."""
    good = good_ids(labels)
    rows = measured.join(good, measured["doc_id"] == good["_good_id"], "left").select("x", F.col("_good_id").isNotNull().alias("trusted"))
    rows = materialize(rows, "quality-rows")
    model = fit(rows)
    discard(rows)
    return model


def score_column(x: str, model: dict | None) -> Column:
    """Score of a column of statistics, in plain expressions."""
    if model is None:
        return F.lit(0.0)
    z = F.lit(0.0)
    for k in range(WIDTH):
        part = (F.element_at(x, k + 1).cast("double") - float(model["mean"][k])) / float(model["scale"][k])
        z = z + F.greatest(F.least(part, F.lit(8.0)), F.lit(-8.0)) * float(model["weights"][k])
    words = F.expm1(8 * F.element_at(x, 1).cast("double"))
    z = z * words / (words + FEW) + float(model["weights"][-1])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = materialize(docs.select("doc_id", statistics_udf("text").alias("x")), "quality")
    model = learn(rows, labels)
    out = rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score_column("x", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score one half or more; all of them where nothing is trusted. Columns stay as they are.

    The statistics are measured once and written beside the documents.
    """
    x = spare_name(docs, "x")
    marked = materialize(docs.withColumn(x, statistics_udf("text")), "quality")
    model = learn(marked.select("doc_id", F.col(x).alias("x")), labels)
    if model is None:
        return docs
    return marked.filter(score_column(x, model) >= 0.5).select(*docs.columns)
