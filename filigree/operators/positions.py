"""A positional index that is written once and kept under its identity; ranked terms and phrases over it, filters before ranking.

An index is a table (term, doc, tf, dl, positions) in folders by the hash of the term, so a search reads
the folders of its terms; inside a folder, slices by document spread the postings of a frequent term over files.
Its identity is the terms' pattern with the number and the hash sum of its rows, so an index is reused as long as
the documents are the same and rebuilt when one changes. Corpus figures (n, the mean length) lie beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.retrieval import B, EVERY_SCRIPT, K1, rank, terms
from filigree.session import tables_root

#: Folders of an index, and slices of a folder's documents.
FOLDERS, SLICES = 16, 8

POSTINGS = "term string, doc {kind}, tf int, dl int, positions array<int>, folder int"


def identity(docs: DataFrame, key: str, text: str, pattern: str) -> str:
    """A name for what the index of these documents holds: it changes with any key or text and not with their order."""
    # sums of two halves, as decimals, so that no order of addition overflows
    row = F.xxhash64(F.col(key), F.col(text), F.lit(pattern))
    got = docs.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("a"), F.sum(F.shiftright(row, 33)).alias("b")).first()
    return f"{got['n']}-{(got['a'] or 0):x}-{(got['b'] or 0) % (1 << 62):x}"


class Index:
    """A kept index: its ``postings``, and one row ``size`` (n, avgdl)."""

    def __init__(self, spark, path: str, kind: str):
        self.spark, self.path = spark, path
        self.postings = spark.read.schema(POSTINGS.format(kind=kind)).parquet(f"{path}/postings")
        self.size = spark.read.schema("n long, avgdl double").parquet(f"{path}/size").first()

    def of(self, asked: DataFrame) -> DataFrame:
        """The postings of the terms of ``asked`` (term): their folders, then their terms."""
        wanted = asked.select("term").distinct().withColumn("folder", folder_of(F.col("term")))
        return self.postings.join(wanted, ["folder", "term"]).drop("folder")


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/size/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def positional_index(docs: DataFrame, key: str, text: str, pattern: str = EVERY_SCRIPT, folder: str | None = None) -> Index:
    """The index of ``docs`` by ``key`` (unique) and ``text``: the kept one of the same identity, else a new one.

    ``folder``: where indexes are kept; by default beside the intermediate tables. The figures are written last, so
    an index without them was never finished and is written again.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    path = f"{folder or tables_root(spark)}/index/{identity(docs, key, text, pattern)}"
    if not exists(spark, path):
        words = docs.select(F.col(key).alias("doc"), terms(F.col(text), pattern).alias("w"))
        one = words.select("doc", F.size("w").alias("dl"), F.posexplode("w").alias("at", "term"))
        one = one.withColumns({"folder": folder_of(F.col("term")), "slice": F.pmod(F.xxhash64("doc"), F.lit(SLICES))})
        # one exchange serves the grouping and the folders
        dealt = one.repartition(FOLDERS * SLICES, "folder", "slice")
        grouped = dealt.groupBy("folder", "slice", "term", "doc").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"), F.sort_array(F.collect_list("at")).alias("positions"))
        grouped.select("term", "doc", "tf", "dl", "positions", "folder").sortWithinPartitions("folder", "term", "doc").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
        words.agg(F.count("*").alias("n"), F.avg(F.greatest(F.size("w"), F.lit(0))).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/size")
    return Index(spark, path, kind)


def okapi(index: Index, tf: Column, df: Column, dl: Column) -> Column:
    n, avgdl = F.lit(index.size["n"]), F.lit(index.size["avgdl"])
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def ranked_terms(index: Index, asked: DataFrame, k: int, admitted: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): Okapi BM25 of ``asked`` (query, term), the best ``k`` per query, ties to the smaller document.

    ``admitted`` (doc), if given, holds the documents that pass the filters (issuer, date, version): the others
    go before anything is ranked, while the corpus figures stay those of all documents. ``admitted`` may name a query
    too (query, doc), if filters differ.
    """
    asked = asked.select("query", "term").distinct()
    hits = index.of(asked).drop("positions")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    if admitted is not None and "query" not in admitted.columns:
        hits = hits.join(admitted.select("doc").distinct(), "doc", "left_semi")
    scored = hits.join(df, "term").select("term", "doc", okapi(index, F.col("tf"), F.col("df"), F.col("dl")).alias("part")).join(asked, "term")
    if admitted is not None and "query" in admitted.columns:
        scored = scored.join(admitted.select("query", "doc").distinct(), ["query", "doc"], "left_semi")
    return rank(scored.groupBy("query", "doc").agg(F.round(F.sum("part"), 6).alias("score")), ["query"], [F.desc("score"), F.asc("doc")], k)


def phrase_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(query, doc, hits, dl): documents that hold all terms of a phrase (query, words) one after the other, and how often.

    The rarest term of each phrase names the candidates; only these look up the lists of the other terms,
    by (term, doc), and the lists, shifted to the phrase's start, are intersected.
    """
    asked = phrases.filter("size(words) > 0").select("query", F.posexplode("words").alias("nth", "term"))
    df = index.of(asked).groupBy("term").agg(F.count("*").alias("df"))
    lead = asked.join(df, "term", "left").groupBy("query").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "nth")).alias("term"), F.count("*").alias("width"))
    some = index.of(lead).join(lead, "term").select("query", "doc", "width")
    wanted = some.join(asked, "query")
    lists = wanted.join(index.of(asked), ["term", "doc"]).select("query", "doc", "width", "dl", "nth", F.transform("positions", lambda p: p - F.col("nth")).alias("starts"))
    met = lists.groupBy("query", "doc").agg(F.max("width").alias("width"), F.max("dl").alias("dl"), F.collect_list("starts").alias("lists")).filter("size(lists) = width")
    starts = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(1))), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return met.select("query", "doc", F.size(starts).alias("hits"), "dl").filter("hits > 0")


def ranked_phrases(index: Index, phrases: DataFrame, k: int, admitted: DataFrame | None = None) -> DataFrame:
    """(query, doc, hits, score, rank) of phrases (query, words): a phrase counts as one term; filters as in ``ranked_terms``."""
    hits = phrase_hits(index, phrases)
    df = hits.groupBy("query").agg(F.count("*").alias("df"))
    scored = hits.join(df, "query").select("query", "doc", "hits", F.round(okapi(index, F.col("hits"), F.col("df"), F.col("dl")), 6).alias("score"))
    if admitted is not None:
        scored = scored.join(admitted.distinct(), [c for c in ("query", "doc") if c in admitted.columns], "left_semi")
    return rank(scored, ["query"], [F.desc("score"), F.asc("doc")], k)
