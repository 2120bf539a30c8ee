"""Answer, sufficiency, manifest and call checks and numbers of prose over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.prose import prose_numbers
from filigree.operators import verification as V
from filigree.plans.registry import query
from filigree.session import load_table, load_tables

text_of = lambda c: F.col(c).cast("string")


@query("d13_prose_numbers", """WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice AS DECIMAL(18, 2)) AS p, year(o_orderdate) AS y FROM orders),
  n AS (SELECT k, k * 1000 AS number FROM t UNION SELECT k, -c FROM t UNION SELECT k, p FROM t UNION SELECT k, 2500000000 FROM t UNION SELECT k, 1000 FROM t UNION SELECT k, y FROM t WHERE k % 2 = 0)
  SELECT k AS o_orderkey, CAST(number AS DECIMAL(18, 2)) AS number FROM n""")
def numbers(s: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    text = F.concat(
        F.lit("매출 "), text_of("o_orderkey"), F.lit(" 천원, -0x"), F.hex("o_custkey"), F.lit(" 외 "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2),
        F.lit("% 및 이십오억원 ("), year, F.lit("년, 접수번호 20240101000001)"),
    )
    years = F.array(F.when(F.col("o_orderkey") % 2 == 1, year))
    found = load_table(s, d, "orders").select("o_orderkey", F.explode(prose_numbers(text, years, F.array(F.lit("20240101000001")))).alias("number"))
    return found.select("o_orderkey", F.col("number").cast("decimal(18,2)").alias("number"))


@query("e14_answers", """WITH e AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 1) AS one FROM lineitem GROUP BY 1),
  a AS (SELECT k, one, k % 5 <> 0 AS answerable, o_orderstatus <> 'P' AS safe FROM e JOIN orders ON o_orderkey = k)
  SELECT k, concat_ws(',', CASE WHEN k % 3 = 1 OR (k % 3 = 0 AND NOT one) THEN 'unknown_citation' END, CASE WHEN answerable AND k % 3 = 2 THEN 'citation_missing' END,
  CASE WHEN answerable AND NOT safe THEN 'answer_asserted_without_safe_evidence' END, CASE WHEN NOT answerable THEN 'unanswerable_draft' END,
  CASE WHEN NOT answerable AND k % 3 <> 2 THEN 'unanswerable_answer_has_citation' END, CASE WHEN safe AND (NOT one OR k % 3 = 2) THEN 'structured_citation_missing' END,
  CASE WHEN k % 4 = 0 AND k % 7 = 0 THEN 'numeric_claim_not_grounded' END, CASE WHEN k % 4 = 1 THEN 'numeric_claim_not_decimal' END, CASE WHEN safe AND k % 4 > 1 THEN 'numeric_claim_missing' END) AS reasons,
  CASE WHEN k % 3 < 2 AND one THEN '1' ELSE '' END AS citations,
  k % 3 = 0 AND one AND answerable AND safe AND k % 4 = 0 AND k % 7 <> 0 AS verified FROM a""")
def answers(s: SparkSession, d: str) -> DataFrame:
    items, orders = load_tables(s, d, "lineitem", "orders")
    evidence = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(text_of("l_linenumber").alias("evidence_id"), F.col("l_returnflag").alias("text"))).alias("evidence"))
    k, none = F.col("k"), F.array().cast("array<string>")
    fact = F.struct(F.when(k % 7 == 0, "7").otherwise(k.cast("string")).alias("value"), F.array(F.lit("1")).alias("evidence_ids"))
    drafts = evidence.join(orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k").select(
        "k", F.lit("금액은?").alias("question"), F.lit("답").alias("answer"), (k % 5 != 0).alias("answerable"),
        F.when(k % 3 == 0, F.array(F.lit("1"))).when(k % 3 == 1, F.array(F.lit("1"), F.lit("9"))).alias("citation_ids"),
        F.when(k % 4 == 0, F.array(k.cast("string"))).when(k % 4 == 1, F.array(F.lit("x"))).otherwise(none).alias("numeric_values"), none.alias("reason_codes"),
        (F.col("o_orderstatus") != "P").alias("safe"), "evidence", F.array(fact).alias("facts"), F.lit(None).cast("struct<value:string,evidence_ids:array<string>>").alias("calculation"),
    )
    return V.verify_answers(drafts).select("k", F.array_join("reasons", ",").alias("reasons"), F.array_join("citations", ",").alias("citations"), "verified")


@query("e15_sufficiency", """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 3 AS t, o_orderstatus = 'P' AS bare, o_orderkey % 5 = 0 AS other, o_orderkey % 7 = 0 AS doubt FROM orders),
  m AS (SELECT *, CASE WHEN bare THEN 'filing_ids' END AS a1, CASE WHEN other THEN 'scope_mismatch:company' END AS a2,
    CASE WHEN bare THEN CASE t WHEN 0 THEN 'search_results,citable_evidence' WHEN 1 THEN 'representative_filings,representative_evidence' ELSE 'citable_evidence' END END AS a3 FROM a)
  SELECT k, CASE WHEN t = 2 AND doubt THEN CASE WHEN bare THEN 'insufficient' ELSE 'partial' END WHEN bare OR other THEN 'insufficient' WHEN doubt AND t < 2 THEN 'partial' ELSE 'sufficient' END AS status,
  CASE WHEN bare OR other OR doubt THEN coalesce(nullif(concat_ws(',', a1, a2, a3), ''), CASE t WHEN 0 THEN '' WHEN 1 THEN 'complete_requested_period' ELSE 'resolved_lineage' END) ELSE '' END AS missing,
  CASE WHEN t = 2 AND doubt THEN NOT bare ELSE NOT (bare OR other) END AS allowed FROM m""")
def sufficiency(s: SparkSession, d: str) -> DataFrame:
    k, doubt = F.col("o_orderkey"), F.col("o_orderkey") % 7 == 0
    filled = F.when(F.col("o_orderstatus") != "P", F.array(F.lit("a")))
    null = lambda kind: F.lit(None).cast(kind)
    scope = lambda company, kind: F.struct(company.alias("company"), *[null(kind).alias(n) for n in ("filing_id", "account")], *[null("string").alias(n) for n in ("start_date", "end_date")])
    requests = load_table(s, d, "orders").select(
        k.alias("k"), F.when(k % 3 == 0, V.TOOLS[1]).when(k % 3 == 1, V.TOOLS[3]).otherwise(V.TOOLS[4]).alias("tool"),
        scope(F.lit("c"), "string").alias("requested"), scope(F.array(F.when(k % 5 == 0, "d").otherwise("c")), "array<string>").alias("covered"),
        filled.alias("filing_ids"), filled.alias("evidence_ids"), filled.alias("item_quality"), F.lit("resolved").alias("correction_status"),
        F.when(doubt, "smoke_only").alias("dense_status"), null("array<string>").alias("warnings"), null("string").alias("context"),
        null("array<struct<support_level:string,validation_status:string,value_numeric:string,unit:string,period:string,scope:string,evidence_ids:array<string>>>").alias("facts"),
        null("int").alias("requirements"), null("array<boolean>").alias("requirement_coverage"), null("string").alias("account_status"),
        F.lit(1).alias("total_count"), (~doubt).alias("coverage_complete"), F.lit("o").alias("original_filing"), F.lit("u").alias("current_filing"),
        F.when(~doubt, "high").alias("lineage_confidence"),
    )
    return V.sufficiency(requests).select("k", "verdict.status", F.array_join("verdict.missing", ",").alias("missing"), "verdict.allowed")


@query("d10_manifest", """WITH c AS (SELECT l_orderkey AS id, l_linestatus AS split, l_returnflag AS category FROM lineitem),
  d AS (SELECT split, category, count(*) + CASE WHEN category = 'A' THEN 1 ELSE 0 END AS n FROM c GROUP BY split, category UNION ALL SELECT 'X', 'Y', 5),
  a AS (SELECT split, category, count(*) AS actual FROM c GROUP BY split, category)
  SELECT 'case_id_repeated' AS problem, CAST(id AS VARCHAR) AS case_id, NULL AS split, NULL AS category, 1 AS declared, count(*) AS actual FROM c GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'count_differs', NULL, split, category, n, coalesce(actual, 0) FROM d LEFT JOIN a USING (split, category) WHERE n <> coalesce(actual, 0)""")
def manifest(s: SparkSession, d: str) -> DataFrame:
    cases = load_table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("category"))
    declared = cases.groupBy("split", "category").agg((F.count("*") + F.when(F.col("category") == "A", 1).otherwise(0)).alias("n"))
    declared = declared.unionByName(s.range(1).select(F.lit("X").alias("split"), F.lit("Y").alias("category"), F.lit(5).cast("long").alias("n")))
    return V.manifest_problems(cases, declared, "id", ["split", "category"])


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS UBIGINT)) % 4294967296 AS BIGINT)" for k in range(8))


@query("d10_suite_digest", f"""SELECT printf('{'%08x' * 8}', {_WORDS}) AS digest
  FROM (SELECT sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_returnflag)) AS h FROM lineitem)""")
def digest(s: SparkSession, d: str) -> DataFrame:
    return V.suite_digest(load_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("d12_observed_calls", """WITH o AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS c FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 3 GROUP BY 1),
  r AS (SELECT o_orderkey AS id, o_orderstatus <> 'O' AS mine, o_orderkey % 4 + 1 AS probes, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM orders LEFT JOIN o ON id = o_orderkey)
  SELECT id AS case_id, CASE WHEN mine THEN c END AS call_count, NOT mine OR (n = probes AND c = probes) AS passed,
  CASE WHEN mine AND (n <> probes OR c <> probes) THEN 'runtime' END AS failure_category FROM r""")
def calls(s: SparkSession, d: str) -> DataFrame:
    orders, items = load_tables(s, d, "orders", "lineitem")
    lane = lambda mine: F.when(mine, "provider").otherwise("concurrency").alias("lane")
    results = orders.select(
        F.col("o_orderkey").alias("case_id"), lane(F.col("o_orderstatus") != "O"), (F.col("o_orderkey") % 4 + 1).alias("probe_count"), F.lit(True).alias("passed"),
        F.lit(None).cast("string").alias("failure_category"), F.lit(None).cast("array<string>").alias("failure_codes"),
    )
    seen = items.select(F.col("l_orderkey").alias("case_id"), lane(F.col("l_linestatus") == "F"), (F.col("l_quantity") - 3).alias("latency_ms"), (F.col("l_returnflag") != "R").alias("called"))
    return V.reconcile_calls(results, seen, "provider").select("case_id", "call_count", "passed", "failure_category")
