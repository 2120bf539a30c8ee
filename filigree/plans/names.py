"""Names in texts: spans with shadow removal, names with blanks inside, and names one edit away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import names as N
from filigree.plans.registry import query
from filigree.session import load_table


def catalogue(s: SparkSession, d: str) -> DataFrame:
    """The first word of every benchmark item, and its first two words as a longer name."""
    words = load_table(s, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("w"))
    both = words.filter("size(w) >= 2").select("item_id", F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.col("w")[0].alias("surface")), F.struct(F.lit(0).alias("priority"), F.concat(F.col("w")[0], F.lit(" "), F.col("w")[1]).alias("surface")))).alias("x"))
    return both.groupBy("x.surface").agg(F.min("item_id").alias("name_id"), F.min("x.priority").alias("priority"))


query("g_name_spans", """WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), c AS (SELECT surface, min(item_id) AS name_id, min(a) AS a, min(b) AS b FROM (SELECT item_id, w[1] AS surface, w[1] AS a, NULL AS b FROM w WHERE len(w) >= 2 UNION ALL SELECT item_id, w[1] || ' ' || w[2], w[1], w[2] FROM w WHERE len(w) >= 2) GROUP BY 1),
  u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM documents)),
  p AS (SELECT doc_id, piece, lead(piece) OVER w AS blank, lead(piece, 2) OVER w AS piece2, CAST(sum(length(piece)) OVER w AS BIGINT) - length(piece) AS start FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  f AS (SELECT doc_id, start AS start, start + length(surface) AS stop, name_id, surface FROM p JOIN c ON piece = a AND (b IS NULL OR (blank = ' ' AND piece2 = b)))
  SELECT doc_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, name_id, surface FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND x.stop <= y.stop AND y.stop - y.start > x.stop - x.start)""")(
    lambda s, d: N.name_spans(load_table(s, d, "documents"), "doc_id", "text", catalogue(s, d)).select("doc_id", "start", "stop", "name_id", "surface")
)

# ---- customers' segments, misspelt -----------------------------------------------------------

_KIND = "(c_custkey % 5)"
_AT = "(c_custkey % length(c_mktsegment) + 1)"
_TEXTS = f"""t AS (SELECT c_custkey, c_mktsegment AS m, 'segment ' || CASE {_KIND} WHEN 0 THEN left(c_mktsegment, {_AT} - 1) || substr(c_mktsegment, {_AT} + 1) WHEN 1 THEN left(c_mktsegment, {_AT}) || substr(c_mktsegment, {_AT})
  WHEN 2 THEN left(c_mktsegment, {_AT} - 1) || 'X' || substr(c_mktsegment, {_AT} + 1) WHEN 3 THEN c_mktsegment ELSE left(c_mktsegment, 3) || 'XX' || substr(c_mktsegment, 4) END || ' of ' || CASE WHEN c_custkey % 7 = 0 THEN 'MACHINEY' ELSE c_name END AS text FROM customer)"""


def misspelt(s: SparkSession, d: str) -> DataFrame:
    """(c_custkey, text): the segment with a letter lost, doubled or changed, as it is, or with two letters too many; some texts hold a second misspelt name."""
    at, m = f"cast({_AT} as int)", "c_mktsegment"
    word = F.expr(f"""case {_KIND} when 0 then concat(substring({m}, 1, {at} - 1), substring({m}, {at} + 1)) when 1 then concat(substring({m}, 1, {at}), substring({m}, {at}))
      when 2 then concat(substring({m}, 1, {at} - 1), 'X', substring({m}, {at} + 1)) when 3 then {m} else concat(substring({m}, 1, 3), 'XX', substring({m}, 4)) end""")
    other = F.when(F.col("c_custkey") % 7 == 0, "MACHINEY").otherwise(F.col("c_name"))
    return load_table(s, d, "customer").select("c_custkey", F.concat(F.lit("segment "), word, F.lit(" of "), other).alias("text"))


def segments(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "customer").select(F.col("c_mktsegment").alias("surface")).distinct().select("surface", F.col("surface").alias("identity"), F.initcap("surface").alias("replacement"))


query("g_typo_repair", f"""WITH {_TEXTS}, n AS (SELECT DISTINCT c_mktsegment AS surface FROM customer), w AS (SELECT DISTINCT c_custkey, unnest(regexp_extract_all(text, '[A-Za-z0-9#]+')) AS core FROM t),
  near AS (SELECT c_custkey, core, surface FROM w JOIN n ON levenshtein(core, surface) = 1 WHERE length(core) >= 4 AND core NOT IN (SELECT surface FROM n)),
  one AS (SELECT c_custkey, min(core) AS core, min(surface) AS surface FROM near GROUP BY 1 HAVING count(DISTINCT surface) = 1 AND count(DISTINCT (core, surface)) = 1)
  SELECT t.c_custkey, CASE WHEN core IS NULL THEN text ELSE left(text, instr(text, core) - 1) || left(surface, 1) || lower(substr(surface, 2)) || substr(text, instr(text, core) + length(core)) END AS repaired, core FROM t LEFT JOIN one USING (c_custkey)""")(
    lambda s, d: (lambda t: t.join(N.typo_repairs(t, "c_custkey", F.regexp_extract_all("text", F.lit("[A-Za-z0-9#]+"), 0), segments(s, d)), "c_custkey", "left").select("c_custkey", N.repaired(F.col("text"), F.col("core"), F.col("replacement")).alias("repaired"), "core"))(misspelt(s, d))
)
query("g_near_names", """WITH n AS (SELECT DISTINCT p_name || CAST(p_size AS VARCHAR) AS surface FROM part), w AS (SELECT DISTINCT p_name || CAST(p_size % 10 AS VARCHAR) || 'x' AS core FROM part UNION SELECT DISTINCT substr(p_name, 2) || CAST(p_size AS VARCHAR) FROM part)
  SELECT core, surface FROM w JOIN n ON levenshtein(core, surface) = 1""")(
    lambda s, d: (lambda p: N.near_names(
        p.select(F.concat("p_name", (F.col("p_size") % 10).cast("string"), F.lit("x")).alias("core")).union(p.select(F.concat(F.expr("substring(p_name, 2)"), F.col("p_size").cast("string")))),
        p.select(F.concat("p_name", F.col("p_size").cast("string")).alias("surface")),
    ))(load_table(s, d, "part"))
)
_SPACED = "CASE c_custkey % 3 WHEN 0 THEN array_to_string(string_split(c_mktsegment, ''), ' ') WHEN 1 THEN left(c_mktsegment, 4) || '  ' || substr(c_mktsegment, 5) ELSE c_mktsegment END"
query("g_spaced_names", f"""WITH t AS (SELECT c_custkey, c_mktsegment AS surface, {_SPACED} AS o, c_name || ' in ' AS head, CASE WHEN c_custkey % 4 = 0 THEN ' or ' || c_mktsegment ELSE '' END AS tail FROM customer)
  SELECT c_custkey, CAST(length(head) AS INT) AS start, CAST(length(head) + length(o) AS INT) AS stop, o AS observed, surface FROM t WHERE o <> surface AND tail = ''""")(
    lambda s, d: N.spaced_names(
        load_table(s, d, "customer").select("c_custkey", F.concat(
            "c_name", F.lit(" in "), F.when(F.col("c_custkey") % 3 == 0, F.array_join(F.split("c_mktsegment", ""), " ")).when(F.col("c_custkey") % 3 == 1, F.concat(F.expr("substring(c_mktsegment, 1, 4)"), F.lit("  "), F.expr("substring(c_mktsegment, 5)"))).otherwise(F.col("c_mktsegment")),
            F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" or "), "c_mktsegment")).otherwise("")).alias("text")),
        "c_custkey", "text", segments(s, d),
    )
)
