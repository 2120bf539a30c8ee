"""Chunks over the fragments of groups: the documents of a source and language in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import fragments as R
from filigree.plans.registry import query
from filigree.session import load_table, materialize

_PIECE = r"(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])\s*"
_CHAIN = rf"""WITH RECURSIVE u AS (SELECT source, lang, doc_id, CAST(len(regexp_extract_all(text, '{_PIECE}')) AS BIGINT) AS n, CAST(len(regexp_extract_all('Section: ' || coalesce(source, '<none>') || ' > ' || lang, '{_PIECE}')) AS BIGINT) AS pre FROM documents),
  p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, lang ORDER BY doc_id) AS BIGINT) AS stop FROM u WHERE n > 0),
  g AS (SELECT source, lang, max(stop) AS total, max(pre) AS pre, list(stop ORDER BY stop) AS ends FROM p GROUP BY 1, 2),
  chain AS (
    SELECT source, lang, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS start, least(coalesce(list_filter(ends, lambda e: e > 450 - pre)[1], total), 700 - pre, total) AS stop FROM g
    UNION ALL
    SELECT c.source, c.lang, c.ordinal + 1, c.stop - 80, least(coalesce(list_filter(ends, lambda e: e > c.stop - 80 + 450 - pre)[1], total), c.stop - 80 + 700 - pre, total)
    FROM chain c JOIN g ON g.source IS NOT DISTINCT FROM c.source AND g.lang IS NOT DISTINCT FROM c.lang WHERE c.stop < g.total)"""


def chunks(s: SparkSession, d: str) -> DataFrame:
    """A source is a filing, a language a section and a document a fragment, whose id is its evidence."""
    docs = load_table(s, d, "documents")
    prefix = F.concat(F.lit("Section: "), F.coalesce("source", F.lit("<none>")), F.lit(" > "), F.col("lang"))
    return R.chunk_fragments(docs, ["source", "lang"], ["doc_id"], "text", "doc_id", prefix)


query("c2_fragment_chunks", f"{_CHAIN} SELECT source, lang, ordinal, start, stop - start AS n_tokens FROM chain")(
    lambda s, d: chunks(s, d).select("source", "lang", "ordinal", "start", "n_tokens")
)
query("c2_chunk_evidence", f"""{_CHAIN} SELECT c.source, c.lang, ordinal, CAST(count(*) AS INT) AS n_evidence, min(doc_id) AS first_evidence, max(doc_id) AS last_evidence
  FROM chain c JOIN p ON p.source IS NOT DISTINCT FROM c.source AND p.lang IS NOT DISTINCT FROM c.lang AND p.stop > c.start AND p.stop - p.n < c.stop GROUP BY 1, 2, 3""")(
    lambda s, d: chunks(s, d).select("source", "lang", "ordinal", F.size("evidence_ids").alias("n_evidence"), F.array_min("evidence_ids").alias("first_evidence"), F.array_max("evidence_ids").alias("last_evidence"))
)
query("w9_running_places", rf"SELECT source, doc_id, stop - n AS begin, stop FROM (SELECT source, doc_id, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS stop FROM (SELECT source, doc_id, CAST(len(regexp_extract_all(text, '{_PIECE}')) AS BIGINT) AS n FROM documents))")(
    lambda s, d: R.running_places(materialize(load_table(s, d, "documents").select("source", "doc_id", F.size(F.regexp_extract_all(F.col("text"), F.lit(R.PIECE), 0)).cast("long").alias("n")), "sizes"), ["source"], ["doc_id"], "n").select("source", "doc_id", "begin", "stop")
)
