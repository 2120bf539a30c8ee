"""Toxicity scoring of restored text: noisy-channel deobfuscation, then a labelled word model (operator 7).

Restoring. A character 4-gram model of clean words is counted over all documents. A word that
shows signs of disguise (look-alike signs or letters of another script among letters, separators
between letters, a letter three times in a row) becomes a lattice: each sign may be one
of the letters it looks like or nothing, a repeated letter may be dropped. Letters spaced out
one by one, three or more, by white space or signs (``GAP``) of any width, become one lattice in which
a word border may stand at every gap, and is likelier where the gap is wider than the run's narrowest.
Compatibility forms (full-width, mathematical, circled letters) are read as the plain letters. Viterbi search over the last three letters finds the
restoration of the highest channel and language probability, of any length. Words
without such signs have one path only and are taken as they are. Of neighbouring words
that a spaced run is restored to the joined form is a word too, as a border may be false.

Scoring. From labelled rows, a bounded sample of which is documented as ``SAMPLE``, the document
frequency of every restored word and of its first four and five letters is counted per label on
the executors. Those clearly commoner in toxic rows (by a lower bound
of their log odds) become candidates; an L1-penalised logistic regression
on the sample gives few of them a weight. A document scores by the weights found in it.

Defined cases: null, empty or wordless text gets the score of no evidence; with no labelled
rows, or one label only, the score is 0 (or 1 if all are toxic); repeated label rows count once
as their largest label; null labels and rows without an id are not learned from; an empty table
gives an empty result; words are restored whatever their length (time grows in proportion);
``drop_toxic`` keeps all other columns, whatever they are called.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import bounded_sample, held_out, texts_of
from filigree.session import spare_name

SAMPLE, LEAST_DOCS, LEAST_ODDS = 16_000, 4, 1.5

# The letters that a sign may stand for, and letters of other scripts that look like Latin ones.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SCRIPTS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "χ": "x", "ı": "i",
}
SEPARATORS = ".-_*~'^`/,"
EDGES = ".,;:!?\"'()[]{}<>«»„“”…&%#*$"
#: Characters without width, which split words unseen.
UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

#: Channel costs (negative log probabilities) of a look-alike, of a letter of another script, of a dropped sign and of a dropped repeat.
COST_SIGN, COST_SCRIPT, COST_DROP, COST_REPEAT = 1.5, 0.5, 3.0, 0.5
#: Channel costs of a word border in a spaced run: at a usual gap and at a wide one; of none at a wide one.
COST_BORDER, COST_WIDE, COST_JOIN = 1.0, 0.1, 3.0

ALPHABET = " abcdefghijklmnopqrstuvwxyz?"  # border, letters, any other letter
SIZE, ORDER = len(ALPHABET), 4
SIGNS = re.escape("".join(LOOKALIKES))
#: Signs between letters, before a letter, or behind one; a letter three times in a row; letters of two scripts.
SUSPECT = re.compile(rf"[^\W\d_][{SIGNS}{re.escape(SEPARATORS)}]+[^\W\d_]|(?<![^\W_])[{SIGNS}]+[^\W\d_]|[^\W\d_][{SIGNS}]+$|[a-z][{''.join(SCRIPTS)}]|[{''.join(SCRIPTS)}][a-z]")
FOREIGN = re.compile(f"[{''.join(SCRIPTS)}]")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: What may stand between letters that are spaced out: any white space and these signs, of any width.
GAP = r"\s.\-_*~/:;=\u00b7\u2022"
SPACED = re.compile(rf"(?<![^\W_])[{SIGNS}]?(?:(?<![^\W\d_])[^\W_]|(?<!\w)[@$])(?:[{GAP}]++(?:[^\W_]|[@$!|+])(?![^\W_])){{2,}}")
#: What every spaced run holds: a sign or letter alone between gaps.
ALONE = re.compile(rf"[{GAP}](?:[^\W_]|[@$!|+])[{GAP}]")
ONE = re.compile(rf"([{GAP}]*)([^{GAP}])")
PLAIN = re.compile(r"\d+(?:[.,:/\-]\d+)*")


def _symbol(code: int) -> int:
    """Index in ALPHABET of a code point below 0x250; accents are folded away."""
    ch = unicodedata.normalize("NFD", chr(code).lower())[:1]
    if "a" <= ch <= "z":
        return 1 + ord(ch) - ord("a")
    return SIZE - 1 if chr(code).isalpha() else 0


SYMBOLS = np.array([_symbol(c) for c in range(0x250)], dtype=np.int64)


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(code < 0x250, SYMBOLS[np.minimum(code, 0x24F)], SIZE - 1)


def symbol(letter: str) -> int:
    return int(SYMBOLS[ord(letter)]) if ord(letter) < 0x250 else SIZE - 1


def language_counts(docs: DataFrame) -> np.ndarray:
    """Character 4-gram counts over all documents, as an array of SIZE in each of four directions."""
    stretch = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**ORDER, dtype=np.int64)
        held: list[str] = []
        size = 0

        def add() -> None:
            s = symbols(f"   {'   '.join(held)} ")  # every text begins behind three borders
            total[:] += np.bincount(((s[:-3] * SIZE + s[1:-2]) * SIZE + s[2:-1]) * SIZE + s[3:], minlength=SIZE**ORDER)

        for batch in batches:
            for text in texts_of(batch.column(0)):
                for at in range(0, len(text), stretch):
                    held.append(text[at : at + stretch])
                    size += len(held[-1])
                    if size >= stretch:
                        add()
                        held, size = [], 0
        if held:
            add()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = np.zeros(SIZE**ORDER)
    found = rows.toArrow()  # one row per 4-gram: SIZE^4 at most
    total[found["gram"].to_numpy()] = found["n"].to_numpy()
    return total.reshape((SIZE,) * ORDER)


def language_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a letter after three: each order backed off to the one below, smoothed."""
    three = counts.sum(axis=0)
    two = three.sum(axis=0)
    p2 = (two + 0.5) / (two.sum(axis=1, keepdims=True) + 0.5 * SIZE)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    p4 = (counts + 5 * p3[None]) / (counts.sum(axis=3, keepdims=True) + 5)
    return -np.log(p4).astype(np.float32)


def readings(ch: str, before: str, after: str) -> list[tuple[str, float]]:
    """What one character may stand for between its neighbours: (letter or nothing, channel cost)."""
    if ch.isalpha():
        reads = [(ch, 0.0)]
        if ch in SCRIPTS:
            reads = [(SCRIPTS[ch], 0.0), (ch, COST_SCRIPT)]
        if before[-1:] == ch and (before == ch * 2 or after == ch):
            reads.append(("", COST_REPEAT))
        return reads
    return [*((x, COST_SIGN) for x in LOOKALIKES.get(ch, "")), ("", COST_REPEAT if ch in SEPARATORS else COST_DROP)]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per character its readings."""
    return [readings(ch, word[max(0, i - 2) : i], word[i + 1 : i + 2]) for i, ch in enumerate(word)]


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """Per letter of a spaced run its readings, and between letters a border or none."""
    out: list[list[tuple[str, float]]] = []
    found = ONE.findall(run)
    usual = min((len(gap) for gap, _ in found[1:]), default=1)
    for k, (gap, ch) in enumerate(found):
        if k:
            wide = len(gap) > usual  # wider than the narrowest of the run
            out.append([(" ", COST_WIDE if wide else COST_BORDER), ("", COST_JOIN if wide else 0.0)])
        before, after = "".join(c for _, c in found[max(0, k - 2) : k]), found[k + 1][1] if k + 1 < len(found) else ""
        reads = readings(ch, before, after)
        out.append(reads if len(reads) > 1 or reads[0][0] else [(ch, 0.0)])
    return out


def decode(steps: list[list[tuple[str, float]]], costs: np.ndarray) -> str:
    """The most probable text through a lattice (Viterbi over the last three letters)."""
    states: dict[tuple[int, int, int], tuple[float, int]] = {(0, 0, 0): (0.0, -1)}
    links: list[tuple[int, str]] = []  # (link before, letter): the paths, shared
    for reads in steps:
        after: dict[tuple[int, int, int], tuple[float, int, str]] = {}
        for (a, b, c), (cost, link) in states.items():
            for letter, channel in reads:
                if letter == " ":
                    key, value = (b, c, 0), (cost + channel + float(costs[a, b, c, 0]), link, letter)
                elif letter:
                    s = symbol(letter)
                    key, value = (b, c, s), (cost + channel + float(costs[a, b, c, s]), link, letter)
                else:
                    key, value = (a, b, c), (cost + channel, link, letter)
                if key not in after or value < after[key]:
                    after[key] = value
        states = {}
        for key, (cost, link, letter) in after.items():
            if letter:
                links.append((link, letter))
                link = len(links) - 1
            states[key] = (cost, link)
    _, link = min((cost + float(costs[a, b, c, 0]), link) for (a, b, c), (cost, link) in states.items())
    made = []
    while link >= 0:
        link, letter = links[link]
        made.append(letter)
    return "".join(reversed(made))


def restore(word: str, costs: np.ndarray) -> str:
    """The most probable plain word behind a disguised one."""
    return decode(lattice(word), costs)


def restore_spaced(run: str, costs: np.ndarray) -> list[str]:
    """The words behind letters that are spaced out."""
    return decode(spaced_lattice(run), costs).split()


class Words:
    """The different words of a text, restored; restorations are remembered, a bounded number of them."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.known = costs, {}

    def restored(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = restore(word, self.costs)
        return self.known[word]

    def of(self, text: str) -> set[str]:
        text = text.lower()
        if not text.isascii():
            # full-width, mathematical and circled letters become plain ones
            text = unicodedata.normalize("NFKC", text).translate(UNSEEN).lower()
        raw = set(text.split())
        words = {w.strip(EDGES) for w in raw}
        for w in raw:
            if not (w.isascii() and w.isalpha()):
                core = w.strip(".,;:?\"')]}")
                if core.isalpha() and (core.isascii() or not FOREIGN.search(core)):
                    continue
                if SUSPECT.search(core) and not PLAIN.fullmatch(core):
                    words.add(self.restored(core))
                    if core[-1:] in "!(" or core[:1] == "(":  # signs of a sentence as often as of a letter
                        words.add(self.restored(core.strip("!(")))
        if TRIPLE.search(text):
            words.update(self.restored(w) for w in list(words) if TRIPLE.search(w))
        for m in SPACED.finditer(text) if ALONE.search(text) else ():
            if not any(c.isalpha() for c in m[0]):
                continue
            found = restore_spaced(m[0], self.costs)
            words.update(found)
            words.update(a + b for a, b in zip(found, found[1:]))
        words.discard("")
        return words


def feature_names(word: str) -> tuple[str, ...]:
    return (word, f"{word[:4]}~", f"{word[:5]}~") if len(word) > 4 else (word,)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, value: int, sample: int) -> DataFrame:
    """(text, label) of at most ``sample`` labelled rows that are not held out, those of the smallest hash of id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, value))
    rows = bounded_sample(rows.groupBy("doc_id").agg(F.max(label).alias("label")), "doc_id", sample)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: language costs, feature weights, intercept."""
    costs = language_costs(language_counts(docs))
    rows = learning_rows(docs, labels, "toxic", 5, 0, sample)
    size = {int(r["label"] > 0): r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return {"costs": costs, "weights": {}, "intercept": 40.0 if toxic else -40.0}
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(shared.value), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[x] for x in names], pa.int64()) for s in seen)], names=["feature", "clean", "toxic"])
            for s in seen:
                s.clear()
            return batch

        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                seen[int(label > 0)].update({f for w in words.of(text) for f in feature_names(w)})
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield flush()
        yield flush()

    table = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    sure = odds - 1.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    table = table.withColumn("sure", sure).filter((F.col("toxic") >= LEAST_DOCS) & (F.col("sure") > LEAST_ODDS))
    # each is in LEAST_DOCS of the sampled rows at least, so the sample bounds their number
    chosen = sorted(r["feature"] for r in table.select("feature").collect())
    at = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(chosen)})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(shared.value), at.value
        for batch in batches:
            found = [sorted({number[f] for w in words.of(text) for f in feature_names(w) if f in number}) for text in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())], names=["found", "label"])

    sampled = rows.mapInArrow(match, "found array<int>, label int").collect()  # ``sample`` rows at most
    found, toxic_row = [r["found"] for r in sampled], np.array([float(r["label"] > 0) for r in sampled])
    weights, _ = sparse_logistic(found, toxic_row, len(chosen))
    kept = weights > 0  # fitted again without the penalty, which would hold their weights down
    weights, intercept = sparse_logistic([[c for c in r if kept[c]] for r in found], toxic_row, len(chosen), penalty=0.0)
    return {"costs": costs, "weights": {f: float(w) for f, w in zip(chosen, weights) if w}, "intercept": intercept}


def sparse_logistic(rows: list[list[int]], y: np.ndarray, width: int, penalty: float = 2.0, ridge: float = 0.05, rounds: int = 800) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression on sets of features (accelerated proximal gradient).

    The penalty is in documents: a feature stays at zero unless it explains more than that
    many. So the words of a toxic document and its copies add nothing beside the words
    that many toxic documents share.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    often = np.bincount(col, minlength=width)
    most = max((len(r) for r in rows), default=1)
    rate = 4.0 / (np.maximum(often, 1) * max(1.0, np.sqrt(most)))
    ahead, ahead_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = ahead_b + np.bincount(at, weights=ahead[col], minlength=len(rows))
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.bincount(col, weights=miss[at], minlength=width) + ridge * ahead
        step = ahead - rate * slope
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0.0)
        new_b = ahead_b - miss.sum() / len(y)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((ahead - new) * (new - w)).sum() > 0:  # restart the acceleration
            after = t = 1.0
        ahead, ahead_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def evidence(text: str, words: Words, weights: dict[str, float]) -> float:
    """Sum of the weights of the features that occur in a text."""
    if not weights:
        return 0.0
    return sum(weights[f] for f in {f for w in words.of(text) for f in feature_names(w) if f in weights})


def evidence_udf(docs: DataFrame, model: dict):
    shared = docs.sparkSession.sparkContext.broadcast((model["costs"], model["weights"]))

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs, weights = shared.value
        words = Words(costs)
        for texts in batches:
            yield pd.Series([evidence(x or "", words, weights) for x in texts], dtype="float64")

    return udf


def scored(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of its text added."""
    z = evidence_udf(docs, model)("text") + F.lit(model["intercept"])
    return docs.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out")), train(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half. Columns stay as they are."""
    score = spare_name(docs, "score")
    return scored(docs, train(docs, labels), score).filter(F.col(score) < 0.5).select(*docs.columns)
