"""Serving and assessment queries: orders as filings and facts, line items as cells, suppliers as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import assessment as A
from filigree.operators import serving as S
from filigree.operators import versions as V
from filigree.plans.filings import CHAIN_SQL, chain
from filigree.plans.registry import query
from filigree.session import load_table

FRAMES_SQL = CHAIN_SQL + """, version AS (SELECT *, CASE WHEN status = 'P' THEN 'unresolved' WHEN version_no = 1 THEN 'root' ELSE 'resolved' END AS lineage_status FROM chain),
  source AS (SELECT s_suppkey AS source_id, CASE WHEN s_acctbal < 0 THEN 'partial' ELSE 'success' END AS parse_status, CASE WHEN s_nationkey < 4 THEN 'pdf' ELSE 'html' END AS detected_format,
    CASE WHEN s_acctbal > 8000 THEN '{}' WHEN s_acctbal BETWEEN 3000 AND 4500 THEN '{"image_reference_count": 2}' WHEN s_acctbal > 7000 THEN '{"image_reference_count": "?"}' ELSE '{"image_reference_count": 0}' END AS coverage_json FROM supplier),
  safe AS (SELECT *, coalesce(TRY_CAST(json_extract_string(coverage_json, '$.image_reference_count') AS INT), 0) AS images FROM source WHERE parse_status = 'success' AND detected_format <> 'pdf'
    AND coalesce(TRY_CAST(json_extract_string(coverage_json, '$.image_reference_count') AS INT), 0) = 0),
  cell AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey AS filing_id, l_orderkey AS table_id, CAST(l_linenumber AS INT) AS row_index, min(l_suppkey) AS source_id,
    min(CAST(l_extendedprice AS DECIMAL(18,2))) AS value, min(l_returnflag) AS flag, min(l_linestatus) AS line, min(CAST(l_shipdate AS DATE)) AS ship FROM lineitem GROUP BY 1, 2, 3, 4),
  fact AS (SELECT o_orderkey AS fact_id, o_orderkey AS filing_id, o_custkey AS issuer, CASE WHEN o_orderstatus = 'F' THEN 'validated' ELSE 'candidate' END AS validation_status,
    o_orderpriority AS account_id, CAST(o_totalprice AS DECIMAL(18,2)) AS value, CAST(o_orderdate AS DATE) AS at FROM orders),
  evidence AS (SELECT filing_id AS fact_id, evidence_id FROM cell WHERE flag <> 'A' UNION ALL SELECT filing_id + 1, evidence_id FROM cell WHERE flag = 'R' AND value > 40000)"""


class Frames:
    """The same frames as DataFrames."""

    def __init__(self, s: SparkSession, d: str):
        self.version = chain(s, d).withColumn("lineage_status", F.when(F.col("status") == "P", "unresolved").when(F.col("version_no") == 1, "root").otherwise("resolved"))
        balance = F.col("s_acctbal")
        coverage = F.when(balance > 8000, "{}").when(balance.between(3000, 4500), '{"image_reference_count": 2}').when(balance > 7000, '{"image_reference_count": "?"}').otherwise('{"image_reference_count": 0}')
        self.source = load_table(s, d, "supplier").select(
            F.col("s_suppkey").alias("source_id"), F.when(balance < 0, "partial").otherwise("success").alias("parse_status"), F.when(F.col("s_nationkey") < 4, "pdf").otherwise("html").alias("detected_format"), coverage.alias("coverage_json")
        )
        key = [(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("filing_id"), F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("row_index")]
        self.cell = load_table(s, d, "lineitem").groupBy(*key).agg(
            F.min("l_suppkey").alias("source_id"), F.min(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"), F.min(F.col("l_shipdate").cast("date")).alias("ship")
        )
        self.fact = load_table(s, d, "orders").select(
            F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("issuer"), F.when(F.col("o_orderstatus") == "F", "validated").otherwise("candidate").alias("validation_status"),
            F.col("o_orderpriority").alias("account_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), F.col("o_orderdate").cast("date").alias("at"),
        )
        own = self.cell.filter("flag <> 'A'").select(F.col("filing_id").alias("fact_id"), "evidence_id")
        self.evidence = own.unionAll(self.cell.filter("flag = 'R' and value > 40000").select((F.col("filing_id") + 1).alias("fact_id"), "evidence_id"))


def with_frames(f):
    return lambda s, d: f(Frames(s, d))


# ---- filters ------------------------------------------------------------------------------

query("f5_answer_safe", f"WITH {FRAMES_SQL} SELECT source_id FROM safe")(with_frames(lambda x: x.source.filter(S.answer_safe()).select("source_id")))
query("f12_validated_actual", f"""WITH {FRAMES_SQL} SELECT fact_id FROM fact WHERE validation_status = 'validated' AND account_id NOT LIKE '%NOT SPECIFIED%' AND NOT regexp_matches(lower(account_id || ' estimate'), 'zzz')
  AND NOT contains(lower(CASE WHEN account_id = '5-LOW' THEN 'Forecast' WHEN account_id = '1-URGENT' THEN '매출 전망' ELSE '' END), 'forecast') AND account_id <> '1-URGENT'""")(
    with_frames(lambda x: x.fact.filter("account_id not like '%NOT SPECIFIED%'").withColumn("kind", F.when(F.col("account_id") == "5-LOW", "Forecast").when(F.col("account_id") == "1-URGENT", "매출 전망")).filter(S.validated_actual("validation_status", "account_id", "kind")).select("fact_id"))
)
query("f13_grain_match", f"""WITH {FRAMES_SQL} SELECT evidence_id FROM cell WHERE flag = 'R' AND line = 'F' AND ((row_index <= 3 AND ship BETWEEN DATE '1994-01-01' AND DATE '1995-12-31') OR (row_index > 3 AND ship = DATE '1994-01-01' AND row_index = 4))""")(
    with_frames(
        lambda x: x.cell.withColumns(
            {"scope": F.col("line"), "period_type": F.when(F.col("row_index") <= 3, "instant").otherwise("duration"), "instant_date": F.col("ship"), "period_start": F.col("ship"),
             "period_end": F.when(F.col("row_index") == 4, F.lit("1995-12-31").cast("date")), "evidence_ids": F.array("evidence_id")}
        ).filter(S.grain_matches(["flag"], F.lit("R"), F.lit("F"), F.lit("1994-01-01").cast("date"), F.lit("1995-12-31").cast("date"))).select("evidence_id")
    )
)


@query("f14_period_owned", f"""WITH {FRAMES_SQL}, r AS (SELECT e.evidence_id, bool_and(f.at BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AS i FROM evidence e JOIN fact f USING (fact_id) GROUP BY 1)
  SELECT c.evidence_id, coalesce(i, c.ship BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AS owned FROM cell c LEFT JOIN r USING (evidence_id)""")
@with_frames
def period_owned(x: Frames) -> DataFrame:
    facts = x.evidence.join(x.fact, "fact_id").select("evidence_id", F.col("at").alias("period_start"), F.col("at").alias("period_end"))
    return S.period_owned(x.cell.select("evidence_id", F.col("ship").alias("own_date")), facts, F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date")).select("evidence_id", "owned")


query("f16_label_candidates", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND (contains(p_type, 'ECON') OR contains(p_type, 'MED'))")(
    lambda s, d: S.label_candidates(load_table(s, d, "part").select("p_partkey", F.col("p_brand").alias("fragment_type"), F.col("p_type").alias("text")), ["Brand#11", "Brand#12", "Brand#13"], ["ECON", "MED"]).select("p_partkey")
)
query("f18_displayed", f"WITH {FRAMES_SQL} SELECT fact_id, CAST(value * 1000 AS DECIMAL(38,4)) AS value_normalised FROM fact")(
    with_frames(lambda x: S.displayed(x.fact.withColumn("scale", F.lit(1000))).select("fact_id", "value_normalised"))
)

# ---- joins --------------------------------------------------------------------------------

query("j2_facts_with_evidence", f"""WITH {FRAMES_SQL} SELECT f.fact_id, min(f.value) AS value, min(v.lineage_status) AS lineage_status, string_agg(DISTINCT CAST(e.evidence_id AS VARCHAR), ',' ORDER BY CAST(e.evidence_id AS VARCHAR)) AS evidence_ids
  FROM fact f JOIN version v USING (filing_id) JOIN evidence e USING (fact_id) JOIN cell c USING (evidence_id) JOIN safe s ON s.source_id = c.source_id
  WHERE f.validation_status = 'validated' AND v.lineage_status IN ('root', 'resolved') AND v.effective_from <= DATE '1996-06-30' AND (v.effective_to IS NULL OR DATE '1996-06-30' < v.effective_to) GROUP BY 1""")(
    with_frames(
        lambda x: S.facts_with_evidence(x.fact, x.evidence, x.cell, x.source, x.version, F.col("lineage_status").isin(S.SAFE_LINEAGE) & V.in_force(F.lit("1996-06-30").cast("date"))).select(
            "fact_id", "value", "lineage_status", F.array_join(F.array_sort(F.transform("evidence_ids", lambda e: e.cast("string"))), ",").alias("evidence_ids")
        )
    )
)
query("j3_a5_overlay_facts", f"""WITH {FRAMES_SQL} SELECT f.fact_id, min(v.issuer) AS issuer, max(v.filed_at) AS filed_at, '[' || string_agg(DISTINCT CAST(e.evidence_id AS VARCHAR), ',' ORDER BY lpad(CAST(e.evidence_id AS VARCHAR), 20, '0')) || ']' AS evidence_json
  FROM fact f JOIN version v USING (filing_id) JOIN evidence e USING (fact_id) JOIN cell c USING (evidence_id) JOIN safe s ON s.source_id = c.source_id WHERE v.lineage_status IN ('root', 'resolved') AND v.is_current GROUP BY 1""".replace("string_agg(DISTINCT CAST(e.evidence_id AS VARCHAR), ',' ORDER BY lpad(CAST(e.evidence_id AS VARCHAR), 20, '0'))", "array_to_string(list_sort(list(DISTINCT e.evidence_id)), ',')"))(
    with_frames(lambda x: S.overlay_facts(x.fact.drop("issuer"), x.version, x.version, x.evidence, x.cell, x.source))
)
query("j4_evidence_flags", f"""WITH {FRAMES_SQL} SELECT f.fact_id, count(e.evidence_id) AS evidence, bool_and(c.evidence_id IS NOT NULL) AS all_cells, bool_and(coalesce(c.filing_id = f.filing_id, FALSE)) AS all_own, bool_and(s.source_id IS NOT NULL) AS all_safe,
  bool_and(coalesce(v.lineage_status IN ('root', 'resolved'), FALSE)) AS safe_lineage FROM fact f LEFT JOIN evidence e USING (fact_id) LEFT JOIN cell c USING (evidence_id) LEFT JOIN safe s ON s.source_id = c.source_id LEFT JOIN version v ON v.filing_id = f.filing_id GROUP BY 1""")(
    with_frames(lambda x: S.evidence_flags(x.fact, x.evidence, x.cell, x.source, x.version))
)
query("j5_with_root", f"WITH {FRAMES_SQL} SELECT v.filing_id, r.filing_id AS original_filing_id FROM version v LEFT JOIN version r ON r.issuer = v.issuer AND r.version_no = 1 AND r.status = 'F' WHERE v.is_current")(
    with_frames(lambda x: S.with_root(x.version.withColumn("version_no", F.when((F.col("version_no") != 1) | (F.col("status") == "F"), F.col("version_no"))), "issuer").select("filing_id", "original_filing_id"))
)
query("j7_rows_of_cells", f"WITH {FRAMES_SQL} SELECT c.evidence_id, d.evidence_id AS fragment_id FROM cell c JOIN cell d ON d.filing_id = c.filing_id AND d.row_index = c.row_index WHERE d.flag <> 'N' AND d.line = 'F'")(
    with_frames(
        lambda x: S.rows_of_cells(
            x.cell.select("evidence_id", "filing_id", "table_id", "row_index"),
            x.cell.select("filing_id", "table_id", F.col("evidence_id").alias("fragment_id"), F.when(F.col("line") == "F", "table_row").otherwise("note").alias("fragment_type"),
                          F.when(F.col("flag") == "N", '{"row": "none"}').otherwise(F.concat(F.lit('{"row": '), "row_index", F.lit("}"))).alias("locator_json")),
        ).select("evidence_id", "fragment_id")
    )
)
query("j16_q10_mismatches", f"WITH {FRAMES_SQL} SELECT f.fact_id, e.evidence_id, f.filing_id AS fact_filing, c.filing_id AS cell_filing FROM fact f JOIN evidence e USING (fact_id) JOIN cell c USING (evidence_id) WHERE f.filing_id <> c.filing_id")(
    with_frames(lambda x: S.filing_mismatches(x.fact, x.evidence, x.cell))
)
query("q10_without_evidence", f"WITH {FRAMES_SQL} SELECT fact_id FROM fact WHERE validation_status = 'validated' AND fact_id NOT IN (SELECT fact_id FROM evidence)")(with_frames(lambda x: S.validated_without_evidence(x.fact, x.evidence).select("fact_id")))


@query("j17_reconcile", f"""WITH {FRAMES_SQL}, g AS (SELECT filing_id AS key, CASE WHEN line = 'O' AND row_index = 1 THEN filing_id + 1 ELSE filing_id END AS filing_id, value, row_index, flag FROM cell WHERE row_index = 1 OR (row_index = 2 AND flag = 'R')),
  o AS (SELECT key, count(*) AS golds, min({{'f': filing_id, 'v': value}}) AS g FROM g GROUP BY 1), s AS (SELECT filing_id AS key, count(*) AS seeds FROM cell WHERE row_index IN (1, 7) GROUP BY 1),
  m AS (SELECT c.key, c.value, seeds, golds, g FROM (SELECT filing_id AS key, value FROM cell WHERE row_index IN (1, 7)) c JOIN s USING (key) LEFT JOIN o USING (key))
  SELECT key, value, concat_ws(',', CASE WHEN golds > 1 THEN 'duplicate_gold' END, CASE WHEN seeds <> 1 THEN 'duplicate_seed' END, CASE WHEN g.f <> key THEN 'filing_mismatch' END, CASE WHEN golds IS NULL THEN 'missing_gold' END, CASE WHEN g.v <> value THEN 'value_mismatch' END) AS reasons FROM m""")
@with_frames
def reconcile(x: Frames) -> DataFrame:
    ids = F.array(F.col("filing_id")).alias("evidence_ids")
    seed = x.cell.filter("row_index in (1, 7)").select(F.col("filing_id").alias("key"), "filing_id", "value", F.lit(1).alias("scale"), ids)
    moved = F.when((F.col("line") == "O") & (F.col("row_index") == 1), F.col("filing_id") + 1).otherwise(F.col("filing_id"))
    gold = x.cell.filter("row_index = 1 or (row_index = 2 and flag = 'R')").select(F.col("filing_id").alias("key"), moved.alias("filing_id"), "value", F.lit(1).alias("scale"), ids)
    return S.reconcile(seed, gold).select("key", "value", F.array_join("reason_codes", ",").alias("reasons"))


query("r13_hydrated", f"""WITH {FRAMES_SQL}, a AS (SELECT evidence_id, filing_id, source_id, flag AS text FROM cell UNION ALL SELECT filing_id * 10, filing_id, 1 + filing_id % 10, kind FROM version)
  SELECT a.evidence_id, w.place, a.text, s.detected_format, v.version_no FROM (SELECT evidence_id, row_index AS place FROM cell WHERE ship >= DATE '1996-01-01' UNION ALL SELECT filing_id * 10, 0 FROM version WHERE status = 'P') w
  JOIN a USING (evidence_id) JOIN source s ON s.source_id = a.source_id JOIN version v ON v.filing_id = a.filing_id AND v.is_current""")(
    with_frames(
        lambda x: S.hydrated(
            x.cell.filter("ship >= date'1996-01-01'").select("evidence_id", F.col("row_index").alias("place")).unionByName(x.version.filter("status = 'P'").select((F.col("filing_id") * 10).alias("evidence_id"), F.lit(0).alias("place"))),
            [x.cell.withColumn("text", F.col("flag")), x.version.select((F.col("filing_id") * 10).alias("evidence_id"), "filing_id", (F.col("filing_id") % 10 + 1).alias("source_id"), F.col("kind").alias("text"))],
            x.source, x.version, F.col("is_current"),
        ).select("evidence_id", "place", "text", "detected_format", "version_no")
    )
)

# ---- order, lookups, periods --------------------------------------------------------------

for _most in (10, 100_000):
    query(f"t7_guarded_{_most}", f"SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') <= {_most}")(
        lambda s, d, most=_most: S.guarded(load_table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"), ["c_custkey"], most)
    )
query("t10_catalogue_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place FROM orders")(
    lambda s, d: load_table(s, d, "orders").select("o_orderkey", S.catalogue_place(F.col("o_orderpriority"), ["2-HIGH", "1-URGENT"]).cast("int").alias("place"))
)
query("x22_unique_value", """WITH c AS (SELECT l_partkey, CAST(l_quantity AS INT) AS q, l_linestatus = 'F' AS cons FROM lineitem), b AS (SELECT l_partkey, bool_or(cons) AS has FROM c GROUP BY 1)
  SELECT l_partkey, CASE WHEN count(DISTINCT q) = 1 THEN min(q) END AS q, bool_or(cons) AS is_consolidated, CASE WHEN count(DISTINCT q) > 1 THEN 'value_conflict' END AS reason FROM c JOIN b USING (l_partkey) WHERE cons = has GROUP BY 1""")(
    lambda s, d: S.unique_statement_value(load_table(s, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("q"), (F.col("l_linestatus") == "F").alias("cons")), ["l_partkey"], "cons", "q")
)
_YEARLY = "y AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INT) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(value) OVER w AS b, lag(fy) OVER w AS f, row_number() OVER (PARTITION BY company ORDER BY fy DESC) AS r FROM y WINDOW w AS (PARTITION BY company ORDER BY fy))"


def yearly(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fy")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value"))


_rounded = lambda df: df.withColumn("result", F.round(F.col("result").cast("double"), 4))
for _op, _sql in {
    "growth_rate": "SELECT company, f AS from_period, fy AS to_period, round(CAST(value - b AS DOUBLE) / CAST(b AS DOUBLE) * 100, 4) AS result FROM p WHERE b <> 0",
    "difference": "SELECT company, round(CAST(value - b AS DOUBLE), 4) AS result FROM p WHERE r = 1 AND b IS NOT NULL",
    "ratio": "SELECT company, round(CAST(value AS DOUBLE) / CAST(b AS DOUBLE), 4) AS result FROM p WHERE r = 1 AND b <> 0",
    "sum": "SELECT company, round(CAST(sum(value) AS DOUBLE), 4) AS result FROM y GROUP BY 1",
}.items():
    query(f"x16_derived_{_op}", f"WITH {_YEARLY} {_sql}")(lambda s, d, op=_op: _rounded(S.derived(yearly(s, d), ["company"], "fy", "value", op)))
query("x8_reviewed", """WITH g AS (SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS v, count(*) FILTER (WHERE o_orderpriority = w) AS p, bool_or(w IS NOT NULL) AS d FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '5-LOW' END AS w FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) USING (o_custkey) GROUP BY 1)
  SELECT k, CASE WHEN d AND v = 1 AND p = 1 THEN 'admitted' ELSE 'unresolved' END AS status, CASE WHEN NOT d THEN 'undecided' WHEN v <> 1 THEN 'review_value_conflict' WHEN p <> 1 THEN 'review_preferred_label_not_unique' END AS reason_code FROM g""")(
    lambda s, d: S.reviewed(
        load_table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("v")),
        load_table(s, d, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("5-LOW").alias("label")), ["k"], "label", "v",
    )
)
query("a22_label_inventory", "SELECT l_shipmode AS text, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_partkey FROM lineitem WHERE l_linenumber = 1) JOIN part ON l_partkey = p_partkey WHERE p_size > 10 AND (contains(replace(p_type, ' ', ''), 'PROMO') OR contains(replace(p_type, ' ', ''), 'SMALL')) GROUP BY 1")(
    lambda s, d: S.label_inventory(
        load_table(s, d, "lineitem").select(F.col("l_partkey").alias("table_id"), F.col("l_returnflag").alias("text"), (F.col("l_linenumber") - 1).alias("column_index")),
        load_table(s, d, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_type").alias("caption"), F.when(F.col("p_size") > 10, "success").otherwise("partial").alias("parse_status")), ["PROMO", "SMALL"],
    )
)

# ---- assessment ---------------------------------------------------------------------------


@query("e4_scores", f"""WITH {FRAMES_SQL}, w AS (SELECT filing_id, list(evidence_id) FILTER (WHERE flag <> 'N') AS wanted, list(evidence_id) FILTER (WHERE line = 'F') AS given, sum(value) FILTER (WHERE flag <> 'N') AS a, sum(value) FILTER (WHERE line = 'F') AS b FROM cell GROUP BY 1),
  c AS (SELECT filing_id, v.status <> 'P' AS asked, b IS NOT NULL AS said, v.status = 'F' AS verified, v.kind = '1-URGENT' AND v.amount > 200000 AS unsafe, a, b, coalesce(wanted, []) AS wanted, coalesce(given, []) AS given FROM w JOIN version v USING (filing_id)),
  f AS (SELECT *, len(list_intersect(wanted, given)) AS hits, asked <> said AS f1, unsafe AS f2, asked AND NOT verified AS f3, asked AND a IS DISTINCT FROM b AS f4, NOT asked AND (said OR b IS NOT NULL) AS f5, NOT asked AND len(given) > 0 AS f6, asked AND len(list_intersect(wanted, given)) < len(given) AS f7 FROM c)
  SELECT filing_id, concat_ws(',', CASE WHEN f1 THEN 'answerability_mismatch' END, CASE WHEN f2 THEN 'unsafe_answer' END, CASE WHEN f3 THEN 'unverified_answer' END, CASE WHEN f4 THEN 'numeric_mismatch' END, CASE WHEN f5 THEN 'false_numeric_claim' END, CASE WHEN f6 THEN 'unexpected_citation' END, CASE WHEN f7 THEN 'unknown_citation' END) AS failures,
    CASE WHEN asked THEN round(CASE WHEN len(given) > 0 THEN hits / len(given) ELSE 0 END, 6) END AS precision, CASE WHEN asked THEN round(CASE WHEN len(wanted) > 0 THEN hits / len(wanted) ELSE 1 END, 6) END AS recall,
    CASE WHEN f4 THEN 'structured_fact' WHEN f1 THEN 'generation' WHEN f2 OR f5 OR f3 THEN 'verification' WHEN f7 OR f6 THEN 'citation' ELSE 'unclassified' END AS cause FROM f""")
@with_frames
def scores(x: Frames) -> DataFrame:
    only = lambda c, v: F.when(c, F.col(v))
    wanted, given = F.col("flag") != "N", F.col("line") == "F"
    cells = x.cell.groupBy("filing_id").agg(
        F.collect_list(only(wanted, "evidence_id")).alias("expected_ids"), F.collect_list(only(given, "evidence_id")).alias("citation_ids"), F.sum(only(wanted, "value")).alias("expected_value"), F.sum(only(given, "value")).alias("value")
    )
    cases = cells.join(x.version, "filing_id").select(
        "filing_id", (F.col("status") != "P").alias("expected_answerable"), F.col("value").isNotNull().alias("answerable"), (F.col("status") == "F").alias("verified"), ((F.col("kind") == "1-URGENT") & (F.col("amount") > 200000)).alias("unsafe"),
        "expected_value", "value", "expected_ids", "citation_ids", F.col("filing_id").alias("filing"), F.col("filing_id").alias("expected_filing"),
    )
    scored = A.score_cases(cases)
    return scored.select("filing_id", F.array_join("failures", ",").alias("failures"), F.round("citation_precision", 6).alias("precision"), F.round("citation_recall", 6).alias("recall"), "cause")


@query("e7_release_cases", """WITH y AS (SELECT o_custkey AS company, o_orderpriority AS account, CAST(year(o_orderdate) AS INT) AS yr, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM orders GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY company, account ORDER BY yr DESC) AS n FROM y), g AS (SELECT company, account, max(value) FILTER (WHERE n = 1) AS latest, count(*) AS k, string_agg(CAST(value AS VARCHAR), ',' ORDER BY n) AS vals FROM r WHERE n <= 3 GROUP BY 1, 2)
  SELECT c_custkey AS company, a.account, 'latest' AS kind, latest IS NOT NULL AS answerable, CAST(latest AS VARCHAR) AS expected FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW')) a(account) LEFT JOIN g ON g.company = c_custkey AND g.account = a.account
  UNION ALL SELECT company, account, 'three_year', TRUE, vals FROM g WHERE k = 3 AND account IN ('1-URGENT', '5-LOW')""")
def release_cases(s: SparkSession, d: str) -> DataFrame:
    facts = load_table(s, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("account"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value"))
    cases = A.release_cases(facts, load_table(s, d, "customer").select(F.col("c_custkey").alias("company")), ["1-URGENT", "5-LOW"])
    return cases.withColumn("expected", F.array_join(F.transform("expected", lambda v: v.cast("string")), ","))


@query("e8_release_failures", """WITH c AS (SELECT o_custkey AS k, list(CAST(o_totalprice AS DECIMAL(28,2))) FILTER (WHERE o_orderstatus = 'F') AS e, list(CAST(o_totalprice AS DECIMAL(28,2))) FILTER (WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') AS g,
    list(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS ei, list(o_orderkey) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'F') AS gi, bool_or(o_orderstatus = 'O') AS said, bool_and(o_totalprice > 5000) AS ok FROM orders GROUP BY 1),
  n AS (SELECT k, e IS NULL AS none, said, ok, list_sort(coalesce(e, [])) AS e, list_sort(coalesce(g, [])) AS g, list_sort(coalesce(ei, [])) AS ei, list_sort(coalesce(gi, [])) AS gi FROM c)
  SELECT k, concat_ws(',', CASE WHEN none AND said THEN 'unexpected_answer' END, CASE WHEN none AND len(g) > 0 THEN 'false_numeric_claim' END, CASE WHEN none AND len(gi) > 0 THEN 'unexpected_citation' END, CASE WHEN NOT none AND NOT said THEN 'unexpected_abstention' END, CASE WHEN NOT none AND NOT ok THEN 'unverified_answer' END,
    CASE WHEN NOT none AND e <> g THEN 'numeric_mismatch' END, CASE WHEN NOT none AND ei <> gi THEN 'citation_mismatch' END) AS failures FROM n""")
def release_failures(s: SparkSession, d: str) -> DataFrame:
    final, price = F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(28,2)")
    answers = load_table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.collect_list(F.when(final, price)).alias("expected"), F.collect_list(F.when(final & (F.col("o_orderpriority") != "5-LOW"), price)).alias("given"), F.collect_list(F.when(final, F.col("o_orderkey"))).alias("expected_ids"),
        F.collect_list(F.when(final & (F.col("o_orderdate") < "1998-01-01"), F.col("o_orderkey"))).alias("citation_ids"), F.bool_or(F.col("o_orderstatus") == "O").alias("answerable"), F.bool_and(F.col("o_totalprice") > 5000).alias("verified"),
    )
    return A.release_failures(answers).select("k", F.array_join("failures", ",").alias("failures"))


@query("e10_metamorphic", f"""WITH {FRAMES_SQL}, a AS (SELECT filing_id, line, value, flag, CASE WHEN row_index = 1 THEN [evidence_id] END AS ids, row_index FROM cell), b AS (SELECT * FROM a WHERE row_index = 1), o AS (SELECT * FROM a WHERE row_index = 2)
  SELECT b.filing_id, concat_ws(',', CASE WHEN b.line IS DISTINCT FROM o.line THEN 'line' END, CASE WHEN b.flag IS DISTINCT FROM o.flag THEN 'flag' END, CASE WHEN b.value <> o.value THEN 'value' END, 'citation') AS differences FROM b JOIN o USING (filing_id)""")
@with_frames
def metamorphic(x: Frames) -> DataFrame:
    ids = lambda n: x.cell.filter(f"row_index = {n}").select("filing_id", "line", "flag", "value", (F.array("evidence_id") if n == 1 else F.lit(None).cast("array<bigint>")).alias("ids"))
    return A.metamorphic_differences(ids(1), ids(2), "filing_id", ["line", "flag", "value"], "ids").withColumn("differences", F.array_join("differences", ","))


query("e11_suite_summary", """SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS failed, round(avg(quality), 6) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic, 'PARTIAL' AS status, CASE WHEN sum(toxic) > 0 THEN 'toxic,case_failures' ELSE '' END AS reasons, FALSE AS hard_gate_passed FROM labels""")(
    lambda s, d: A.suite_summary(load_table(s, d, "labels").withColumn("passed", F.col("toxic") != 1), 600_000, ["quality"], ["toxic"]).withColumn("quality", F.round("quality", 6))
)
query("q1_expected_counts", """SELECT coalesce(a.k, b.k) AS k, coalesce(e, 0) AS expected, coalesce(n, 0) AS found FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, CAST(round(abs(c_acctbal) / 500) AS BIGINT) AS e FROM customer) b USING (k) WHERE coalesce(e, 0) <> coalesce(n, 0)""")(
    lambda s, d: A.expected_counts(load_table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k", load_table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.round(F.abs("c_acctbal") / 500).cast("long").alias("expected")))
)
query("q11_metadata", """SELECT o.o_orderkey AS k, CASE WHEN l.k IS NULL THEN 'missing_in_corpus' ELSE concat_ws(',', CASE WHEN o_orderstatus <> l.st THEN 'st' END, CASE WHEN CAST(o_orderdate AS DATE) <> l.at THEN 'at' END) END AS differences
  FROM orders o LEFT JOIN (SELECT l_orderkey AS k, min(l_linestatus) AS st, min(CAST(l_shipdate AS DATE)) AS at FROM lineitem WHERE l_quantity > 5 GROUP BY 1) l ON l.k = o.o_orderkey WHERE l.k IS NULL OR o_orderstatus <> l.st OR CAST(o_orderdate AS DATE) <> l.at""")(
    lambda s, d: A.metadata_differences(
        load_table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_orderdate").cast("date").alias("at")),
        load_table(s, d, "lineitem").filter("l_quantity > 5").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("st"), F.min(F.col("l_shipdate").cast("date")).alias("at")), "k", ["st", "at"],
    )
)
query("q14_recomputed", """WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS n, CAST(max(o_totalprice) AS DOUBLE) AS top FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, CAST(round(abs(c_acctbal) / 500) AS DOUBLE) AS n, c_acctbal AS top FROM customer), m AS (SELECT k, b.n AS dn, a.n AS an, b.top AS dt, a.top AS act FROM a FULL JOIN b USING (k))
  SELECT k, 'n' AS measure, dn AS declared, an AS actual FROM m WHERE dn IS DISTINCT FROM an UNION ALL SELECT k, 'top', dt, act FROM m WHERE dt IS DISTINCT FROM act""")(
    lambda s, d: A.recomputed(load_table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.round(F.abs("c_acctbal") / 500).alias("n"), F.col("c_acctbal").alias("top")), load_table(s, d, "orders").withColumn("k", F.col("o_custkey")), "k", {"n": F.count("*"), "top": F.max("o_totalprice")})
)
_COVER = """p AS (SELECT company, account, period, first(id ORDER BY latest DESC, id DESC) AS id, first(latest ORDER BY latest DESC, id DESC) AS latest FROM c GROUP BY 1, 2, 3),
  b AS (SELECT company, account, id, latest, count(*) AS new FROM p GROUP BY ALL),
  m AS (SELECT *, sum(new) OVER (PARTITION BY company, account ORDER BY latest DESC, id DESC) - new AS before, sum(new) OVER (PARTITION BY company, account) AS total FROM b)"""


query("t11_covering_months", f"""WITH g AS (SELECT l_suppkey AS company, l_returnflag AS account, month(l_shipdate) AS m, CAST(min(l_orderkey) AS VARCHAR) AS id, CAST(max(year(l_shipdate)) AS VARCHAR) AS latest FROM lineitem GROUP BY 1, 2, 3),
  c AS (SELECT DISTINCT company, account, id, max(latest) OVER (PARTITION BY company, account, id) AS latest, CAST(year(l_shipdate) AS VARCHAR) AS period FROM g JOIN lineitem ON l_suppkey = company AND l_returnflag = account AND month(l_shipdate) = m), {_COVER}
  SELECT company, account, CAST(id AS BIGINT) AS evidence_id FROM m WHERE total >= 4 AND before < 4""")(
    lambda s, d: A.covering_periods(
        load_table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("account"), F.month("l_shipdate").alias("m")).agg(F.min("l_orderkey").alias("evidence_id"), F.collect_set(F.year("l_shipdate").cast("string")).alias("p"))
        .groupBy("company", "account", "evidence_id").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("periods")), ["company", "account"], 4,
    ).select("company", "account", F.col("evidence_id").cast("long").alias("evidence_id"))
)
query("t11_covering_periods", f"""WITH c AS (SELECT o_custkey AS company, o_orderpriority AS account, CAST(min(o_orderkey) AS VARCHAR) AS id, CAST(year(date_trunc('quarter', o_orderdate)) AS VARCHAR) AS latest, CAST(year(date_trunc('quarter', o_orderdate)) AS VARCHAR) AS period FROM orders GROUP BY o_custkey, o_orderpriority, date_trunc('quarter', o_orderdate)), {_COVER}
  SELECT company, account, CAST(id AS BIGINT) AS evidence_id FROM m WHERE total >= 3 AND before < 3""")(
    lambda s, d: A.covering_periods(
        load_table(s, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("account"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("q")).agg(F.min("o_orderkey").alias("evidence_id"), F.collect_set(F.year("o_orderdate").cast("string")).alias("periods")), ["company", "account"], 3
    )
)
query("t12_priority", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 5 ELSE 2 END AS priority FROM orders")(
    lambda s, d: A.by_priority(load_table(s, d, "orders"), "o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1, "5-LOW": 5}, "o_orderkey").select("o_orderkey", "priority")
)
query("x24_event_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")(
    lambda s, d: load_table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k is not null")
)
query("j10_parts_never_sold_much", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")(
    lambda s, d: load_table(s, d, "part").join(load_table(s, d, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")
)
