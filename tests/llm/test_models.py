"""Operators 6, 7, 8 and 10: held-out accuracy and brute-force versions."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filigree.llm import langid, lm, quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held(doc_id, m, r):
    return zlib.crc32(str(doc_id).encode()) % m == r


def test_language(tables):
    docs, _ = tables
    lang = {d["doc_id"]: d["lang"] for d in docs.collect()}
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(out) >= 0.97 * len(out)
    assert langid.predict_all(["12 34", "a"], ["en"], np.zeros(1), np.zeros((1 << langid.BITS, 1)))[0] == ["und", "en"]


def test_toxicity(tables):
    docs, labels = tables
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"], 5, 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    clean = [r["predicted"] for r in rows if toxic.get(r["doc_id"]) == 0]
    bad = [r["predicted"] for r in rows if toxic.get(r["doc_id"]) == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(bad) >= 0.6 * len(bad)


def test_restoring(spark):
    words = "stupid moron loser the of and idiot trash pathetic clown reading together worthless people little better street".split()
    docs = spark.createDataFrame([(" ".join(words * 20),)], "text string")
    seen = toxicity.Words(toxicity.language_costs(toxicity.language_counts(docs)))
    assert {"stupid"} <= seen.of("you 5tup1d one") and {"moron"} <= seen.of("m.o.r.o.n!") and {"loser"} <= seen.of("looooser")
    assert "idiot" in seen.of("an i d i o t here") and "clown" in seen.of("c l o w n") and "trash" in seen.of("tr@sh,")
    assert seen.of("plain words, only.") == {"plain", "words", "only"} and seen.of("") == set()


def test_sparse_logistic():
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.3
    rows = [sorted({*([0] if t and rng.random() < 0.9 else []), int(rng.integers(1, 30))}) for t in y]
    w, b = toxicity.sparse_logistic(rows, y.astype(float), 30)
    assert w[0] > 2 and np.abs(w[1:]).max() < w[0] and b < 0


def test_quality(tables):
    docs, labels = tables
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    out = [(r["predicted"], good[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in good]
    assert sum(p == q for p, q in out) >= 0.95 * len(out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_prior():
    positive, unlabelled = np.zeros(10), np.zeros(10)
    positive[5:], unlabelled[5:], unlabelled[:5] = 20, 120, 80
    assert abs(quality.estimate_prior(positive, unlabelled) - 0.625) < 0.01  # the slack of 100 positives


def plain_base(docs):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [*t.encode().split(), "END"]

    learn = Counter()
    for d in docs:
        if d["doc_id"] is not None and not held(d["doc_id"], 5, 1):
            learn.update(words(d["text"]))
    n, v = sum(learn.values()), len(learn)
    return n, {d["doc_id"]: (len(w := words(d["text"])), sum(learn[x] > 0 for x in w), sum(math.log10((learn[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d in docs}


@pytest.mark.parametrize("table", [None, 500])
def test_language_model(tables, monkeypatch, table):
    docs, _ = tables
    if table:  # most tokens outside the broadcast table
        monkeypatch.setattr(lm, "TABLE", table)
    rows = lm.score_documents(docs).collect()
    n, want = plain_base(docs.collect())
    assert len(rows) == len(want)
    for r in rows:
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and r["held_out"] == held(r["doc_id"], 5, 1)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_sum_to_one(spark):
    """Over all tokens and one unknown token of each class, in several contexts, by the formula written out."""
    docs = spark.createDataFrame([(k, "a b c a b d e f g " + " ".join(f"w{i}" for i in range(9 * k, 12 * k))) for k in range(30)], "doc_id long, text string")
    counts = lm.token_counts(docs).cache()
    v, classes, members = lm.train(docs, counts)
    n = {bytes(r["token"]): r["n"] for r in counts.collect()}
    assert n[b"a"] == 60 and (v.slot == lm.MEMBERS).sum() >= 0
    for before in ([], [b"a"], [b"a", b"b"], [b"unseen", b"w3"]):
        total, rest = 0.0, np.zeros(lm.CLASSES)
        for token in n:
            e = v.encode([[*before, token]])
            p = np.exp(lm.log_probabilities(e, classes, members)[-1])
            c = int(e.kind[-1])
            if e.slot[-1] == lm.MEMBERS:
                p *= (n[token] + 0.5) / (v.rest[0, c] + 0.5 * (v.rest[1, c] + 1))
            total += p
        for c in range(lm.CLASSES):  # the unknown token of class c: the first made-up word of that class
            word = next(w for w in (b"?%d" % i for i in range(10_000)) if lm.class_of(w) == c)
            e = v.encode([[*before, word]])
            total += np.exp(lm.log_probabilities(e, classes, members)[-1]) * 0.5 / (v.rest[0, c] + 0.5 * (v.rest[1, c] + 1))
        assert abs(total - 1) < 1e-4


def test_texts_of_a_batch_do_not_touch(tables):
    docs, _ = tables
    v, classes, members = lm.train(docs, lm.token_counts(docs).cache())
    texts = [lm.tokens(t) for t in ("one two three", "", "the", "of the and of")]
    together = lm.log_probabilities(v.encode(texts), classes, members)
    alone = np.concatenate([lm.log_probabilities(v.encode([t]), classes, members) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def plain_grams(text):
    clean = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    clean = f" {clean} " if clean else " "
    return Counter(clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1))


def test_language_by_hand(spark):
    """Naive Bayes written out on n-grams (no two of these few share a bucket)."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("der die das", "de"), ("the cat, the dog", "en"), ("la casa 12 es", "es"), ("und das", "de"), ("dog", "en"), ("es la", None), ("12 !", "es"), ("The DOG das", "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2]]
    langs = sorted({r[2] for r in learn})
    counts = {x: sum((plain_grams(r[1]) for r in learn if r[2] == x), Counter()) for x in langs}
    prior = {x: sum(r[2] == x for r in learn) / len(learn) for x in langs}
    for r in langid.language_id(docs).collect():
        text = rows[r["doc_id"]][1]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        log = {x: math.log(prior[x]) + sum(n * math.log((counts[x][g] + langid.ALPHA) / (sum(counts[x].values()) + langid.ALPHA * 2**langid.BITS)) for g, n in plain_grams(text).items()) for x in langs}
        best = max(sorted(log), key=log.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(math.exp(v - log[best]) for v in log.values())) < 1e-4


def test_positive_unlabelled_risk_by_hand(spark):
    """The weights make the risk pi R_p+ + max(0, R_u- - pi R_p-) least: no step along an axis lowers it."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.6, 0.2, (300, quality.WIDTH)), rng.normal(-0.6, 0.2, (100, quality.WIDTH))
    x = np.concatenate([good, bad])
    x[:, 0] = 0.8  # the logarithm of the number of words
    trusted = np.arange(len(x)) < 120
    rows = spark.createDataFrame([([float(v) for v in r], bool(t)) for r, t in zip(x, trusted)], "x array<float>, trusted boolean")
    m = quality.fit(rows)
    z = quality.design(x.astype(np.float32).astype(float), m["mean"], m["scale"])

    def risk(w):
        s, soft = z @ w, lambda v: np.logaddexp(0, v).mean()
        ridge = quality.RIDGE + 0.5 / trusted.sum()
        return m["prior"] * soft(-s[trusted]) + max(0.0, soft(s) - m["prior"] * soft(s[trusted])) + ridge / 2 * (w @ w)

    least = risk(m["weights"])
    for k in range(len(m["weights"])):
        for step in (0.05, -0.05):
            w = m["weights"].copy()
            w[k] += step
            assert risk(w) > least - 1e-6
    score = 1 / (1 + np.exp(-(z @ m["weights"])))
    assert (score[:300] >= 0.5).mean() > 0.9 and (score[300:] < 0.5).mean() > 0.9


DISGUISES = {
    "idiot": ["i d i o t.", '"i d i o t"', "1d10t", "i.d.i.o.t", "id​iot", "іdіоt", "an idi" + "o" * 80 + "t here"],
    "stupid": ["$ t u p i d", "$tup1d", "stupi0d", "you s-t-u-p-i-d!"],
    "kill": ["ki11", "k1ll"],
}


def test_disguises_of_every_kind(tables):
    docs, _ = tables
    words = "stupid idiot kill still with you are the and of that until".split()
    docs = docs.select("text").limit(200).unionByName(docs.sparkSession.createDataFrame([(" ".join(words * 30),)], "text string"))
    seen = toxicity.Words(toxicity.language_costs(toxicity.language_counts(docs)))
    for word, forms in DISGUISES.items():
        for form in forms:
            assert word in seen.of(f"so {form}"), form
    assert {"you", "are", "stupid"} <= seen.of("y o u a r e s t u p i d")
    assert not {"ass", "as"} & seen.of("4 5 5 and 4.5.5")
    for gap in ("    ", "\t", "\n", "\u00a0", "\r\n  ", " : ", ";", "=", " ~ ", "/", "\u00b7", "   -   "):
        assert "idiot" in seen.of(f"so {gap.join('idiot')} here"), repr(gap)
    for form in ("\uff49\uff44\uff49\uff4f\uff54", "\u0131d\u0131ot", "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot"), "".join(chr(0x24D0 + ord(c) - 97) for c in "idiot"), "\uff29 \uff24 \uff29 \uff2f \uff34"):
        assert "idiot" in seen.of(f"so {form} here"), form
    assert {"you", "are", "stupid"} <= seen.of("y  o  u     a  r  e     s  t  u  p  i  d")
    assert seen.of("x" + " " * 300_000 + "y" + "\n" * 300_000) == {"x", "y"}  # time in proportion


def test_viterbi_against_all_paths(tables):
    docs, _ = tables
    costs = toxicity.language_costs(toxicity.language_counts(docs.limit(100)))
    rng = np.random.default_rng(3)
    for _ in range(60):
        word = "".join(rng.choice(list("aeiot01!$.3")) for _ in range(6))
        steps = toxicity.lattice(word) if rng.random() < 0.6 else toxicity.spaced_lattice(" ".join(word))
        best: dict[str, float] = {}
        for path in itertools.product(*steps):
            made, cost = "", 0.0
            for letter, channel in path:
                cost += channel
                if letter:
                    a, b, c = (toxicity.symbol(x) if x != " " else 0 for x in f"   {made}"[-3:])
                    cost += float(costs[a, b, c, 0 if letter == " " else toxicity.symbol(letter)])
                    made += letter
            a, b, c = (toxicity.symbol(x) if x != " " else 0 for x in f"   {made}"[-3:])
            best[made] = min(best.get(made, np.inf), cost + float(costs[a, b, c, 0]))
        assert abs(best[toxicity.decode(steps, costs)] - min(best.values())) < 1e-9, word
