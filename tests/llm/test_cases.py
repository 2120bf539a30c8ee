"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import fingerprint, langid, lm, mixing, packing, quality, sharding, simhash, toxicity

CLASH = ["rid", "fp", "size", "held_out", "score", "label", "taken", "length", "shard", "slot", "bucket", "copies", "next", "token", "n", "x", "trusted", "edited"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c d e", "en", "s1", 9), (2, None, None, None, None), (3, "", "en", "s2", 0), (None, "no id here", "en", "s1", 10), (4, "a b c d e", "en", "s1", 9),
            (4, "a b c d e", "en", "s1", 9), (5, "word " * 60_000, "de", None, 1), (6, " \n\t ", None, "s2", 3), (7, "x" * 200_000, "fr", "s3", 1), (8, "1 2 3 !", "fr", "s3", 1), (9, "Ünïcode \U0001f600 ok", "de", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1), (5, 0, 1), (7, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


REPORTS = {
    "simhash": lambda d, l: simhash.near_duplicates(d), "packing": lambda d, l: packing.best_fit_pack(d).filter("piece = 0"), "sharding": lambda d, l: sharding.shard_documents(d),
    "fingerprint": lambda d, l: fingerprint.edited_pairs(d), "mixing": lambda d, l: mixing.mix_report(d), "langid": lambda d, l: langid.language_id(d),
    "toxicity": toxicity.toxicity, "quality": quality.quality, "lm": lambda d, l: lm.score_documents(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_every_row_has_a_result(odd, labels, name):
    rows = REPORTS[name](odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    by = {r["doc_id"]: r for r in rows}
    if name == "simhash":
        assert by[2]["fingerprint"] == "0" * 16 and by[6]["component_id"] == 2 and by[4]["component_id"] == 1
    if name == "langid":
        assert {by[k]["lang_pred"] for k in (2, 3, 6, 8)} == {"und"}
    if name == "fingerprint":
        assert by[1]["fingerprint"] == by[4]["fingerprint"] and by[2]["n_chars"] == 0


@pytest.mark.parametrize("name", REPORTS)
def test_empty_table(odd, labels, name):
    assert REPORTS[name](odd.filter("false"), labels).count() == 0
    if name in ("toxicity", "quality"):
        assert REPORTS[name](odd, labels.filter("false")).count() == odd.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, labels, name, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, odd.filter("false"), str(tmp_path)).count() == 0
    out = stage(spark, odd, str(tmp_path))
    out.collect()
    if name != "packing":
        assert out.columns == odd.columns


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r for r in docs.collect()}
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf).persist()
        kept = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == list(next(iter(text.values())).asDict()) and all(r == text[r["doc_id"]] for r in docs.collect())
        if name in ("quality", "toxicity", "simhash"):
            assert len(set(kept)) == len(kept) <= before
        if name == "quality":
            good = [k for k, r in known.items() if r["quality"] == 1]
            assert sum(k in set(kept) for k in good) >= 0.9 * len(good)
        if name == "simhash":
            again = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert len(again) == len(kept)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(text)
