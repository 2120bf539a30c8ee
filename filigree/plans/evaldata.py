"""Evaluation data: candidates, admission, exclusion, audits and group ids over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import evaldata as V
from filigree.plans.registry import query
from filigree.session import load_table, load_tables

text_of = lambda c: F.col(c).cast("string")


@query("d1_evidence_links", """SELECT l_orderkey AS evidence_id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS facts FROM lineitem
  WHERE l_linestatus = 'F' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def evidence_links(s: SparkSession, d: str) -> DataFrame:
    facts = load_table(s, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("evidence_id"), "l_linenumber")
    links = V.evidence_links(facts, load_table(s, d, "orders").select(F.col("o_orderkey").alias("evidence_id")), "evidence_id", "l_linenumber")
    return links.select("evidence_id", F.array_join(F.col("facts").cast("array<string>"), ",").alias("facts"))


@query("d3_slot_candidates", """SELECT DISTINCT slot, item_id FROM benchmark, (VALUES ('first', 'the'), ('first', 'der'), ('second', 'an'), ('third', 'q')) t(slot, term) WHERE contains(text, term)""")
def slot_candidates(s: SparkSession, d: str) -> DataFrame:
    return V.slot_candidates(load_table(s, d, "benchmark"), {"first": ["the", "der"], "second": ["an"], "third": ["q"]}, "text").select("slot", "item_id")


@query("d4_safe_text_targets", """SELECT doc_id, coalesce(lang IN ('en', 'de') AND length(text) >= 80 AND (contains(text, 'the') OR contains(text, 'an')) AND NOT contains(text, 'http'), FALSE) AS safe FROM documents""")
def safe_text(s: SparkSession, d: str) -> DataFrame:
    return load_table(s, d, "documents").select(
        "doc_id", V.safe_text_target(F.col("lang"), F.col("text"), ["en", "de"], ["the", "an"], F.col("text").contains("http")).alias("safe")
    )


@query("d6_admission", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unresolved_lineage' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'missing_evidence'
  WHEN o_orderpriority = '1-URGENT' THEN 'unsafe_source_parse' WHEN o_orderkey % 4 = 0 THEN 'serving_path_invalid' WHEN o_orderkey % 5 = 0 THEN 'slot_target_filing_mismatch' END AS reason FROM orders""")
def admission(s: SparkSession, d: str) -> DataFrame:
    orders, items = load_tables(s, d, "orders", "lineitem")
    evidence = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(text_of("l_linenumber")).alias("target_evidence_ids"))
    slot = F.struct(
        F.lit("financial").alias("domain"), F.when(F.col("o_orderkey") % 4 == 0, "search_document").otherwise("financial_fact_evidence").alias("serving_path"),
        F.col("target_evidence_ids"), F.array(F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(text_of("o_orderkey"))).alias("filing_ids"),
        F.array(text_of("o_custkey")).alias("fact_ids"), F.lit("row").alias("fragment_type"), F.lit(0).alias("character_count"), F.lit(0).alias("marker_count"),
    )
    records = orders.join(evidence, "o_orderkey", "left").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise("root").alias("lineage_status"), "target_evidence_ids",
        F.array(text_of("o_orderkey")).alias("filing_ids"), F.lit("name").alias("issuer_name"), text_of("o_custkey").alias("issuer_corp_code"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("success").alias("parse_status"), F.sha2(text_of("o_orderkey"), 256).alias("source_sha256"),
        F.lit("proved").alias("answerability"), F.array(slot).alias("slots"),
    )
    return records.select("o_orderkey", V.admission_reason(["success"]).alias("reason"))


@query("d7_exclusions", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'invalid_plan' WHEN o_orderkey % 9 = 0 THEN 'no_query_executed'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)) THEN 'target_not_serving_admitted' END AS reason FROM orders""")
def exclusions(s: SparkSession, d: str) -> DataFrame:
    orders, items, parts = load_tables(s, d, "orders", "lineitem", "part")
    targets = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("targets"))
    cases = orders.join(targets, "o_orderkey", "left").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("plan_ok"), F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(1).alias("query_count"), "targets")
    return V.exclusion_reasons(cases, parts.filter("p_size <= 45").select(F.col("p_partkey").alias("part")), "o_orderkey", "part")


@query("d9_group_ids", """SELECT doc_id, 'issuer-' || left(sha256('issuer:' || coalesce(source, '')), 24) AS issuer_group_id, 'document-' || left(sha256('["' || doc_id || '"]'), 24) AS document_group_id, CAST(doc_id % 4 AS INT) AS variant FROM documents""")
def group_ids(s: SparkSession, d: str) -> DataFrame:
    rows = load_table(s, d, "documents").select("doc_id", "source", F.array(text_of("doc_id")).alias("documents"))
    return V.group_ids(rows, "source", "documents", "doc_id", 4).select("doc_id", "issuer_group_id", "document_group_id", "variant")


@query("d11_case_summary", """SELECT l_orderkey, count(*) AS observations, round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS routed, round(avg(CAST(l_linestatus = 'F' AS INT)), 6) AS exact FROM lineitem GROUP BY 1""")
def case_summary(s: SparkSession, d: str) -> DataFrame:
    rows = load_table(s, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("routed"), (F.col("l_linestatus") == "F").alias("exact"))
    return V.case_summary(rows, "l_orderkey", ["routed", "exact"])


@query("d14_fact_candidates", """SELECT o_orderkey, c_name, n_name, coalesce(cells, 0) AS cells, coalesce(returned, 0) AS returned, coalesce(suppliers, 0) AS suppliers FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN
  (SELECT l_orderkey, count(*) AS cells, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def fact_candidates(s: SparkSession, d: str) -> DataFrame:
    orders, customers, nations, items = load_tables(s, d, "orders", "customer", "nation", "lineitem")
    counts = items.groupBy("l_orderkey").agg(F.count("*").alias("cells"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", "c_name", "n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cells", "returned", "suppliers")])


@query("d15_candidate_audit", """WITH r AS (SELECT l_orderkey, unnest(CASE WHEN l_quantity > 45 THEN ['evidence_not_found'] ELSE list_filter([CASE WHEN l_linestatus <> 'F' THEN 'source_parse_failed' END,
  CASE WHEN l_returnflag = 'N' THEN 'lineage_not_answer_safe' END, CASE WHEN l_partkey % 10 = 0 THEN 'cross_filing_evidence' END], lambda x: x IS NOT NULL) END) AS reason FROM lineitem
  UNION ALL SELECT l_orderkey, 'duplicate_candidate' FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity HAVING count(*) > 1),
  g AS (SELECT l_orderkey, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1)
  SELECT l_orderkey, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN g USING (l_orderkey)""")
def candidate_audit(s: SparkSession, d: str) -> DataFrame:
    items = load_table(s, d, "lineitem").withColumn("evidence_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    records = items.groupBy("l_orderkey").agg(F.collect_list(F.struct("evidence_id", text_of("l_orderkey").alias("filing_id"), F.lit("x").alias("sha256"))).alias("evidence"))
    evidence = items.filter("l_quantity <= 45").select(
        "evidence_id", F.when(F.col("l_partkey") % 10 == 0, "other").otherwise(text_of("l_orderkey")).alias("filing_id"), F.lit("x").alias("sha256"),
        F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("parse_status"), F.lit(None).cast("string").alias("table_parse_status"),
        F.lit("xml").alias("format"), F.when(F.col("l_returnflag") == "N", "unresolved").otherwise("root").alias("lineage_status"),
    )
    audit = V.audit_candidates(records.withColumn("filing_ids", F.array(text_of("l_orderkey"))), evidence, "l_orderkey")
    return audit.select("l_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("d17_packets", """WITH ids AS (SELECT DISTINCT doc_id AS id FROM labels UNION SELECT DISTINCT doc_id + 1000000000 FROM labels),
  g AS (SELECT doc_id AS id, text, 'document' AS grain FROM documents UNION ALL SELECT item_id + 1000000000, text, 'benchmark' FROM benchmark)
  SELECT id, grain, left(text, 200) AS excerpt, length(text) > 200 AS truncated, CASE WHEN grain IS NULL THEN 'evidence_not_found' END AS issue FROM ids LEFT JOIN g USING (id)""")
def packets(s: SparkSession, d: str) -> DataFrame:
    labels, documents, benchmark = load_tables(s, d, "labels", "documents", "benchmark")
    ids = labels.select(F.explode(F.array("doc_id", F.col("doc_id") + 1_000_000_000)).alias("id"))
    return V.hydrate(ids, {"document": documents.select(F.col("doc_id").alias("id"), "text"), "benchmark": benchmark.select((F.col("item_id") + 1_000_000_000).alias("id"), "text")}, 200)


@query("d18_automatic_checks", """SELECT l_orderkey, 'evidence_outside_candidate_filings' AS rule_id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS message FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY 1
  UNION ALL SELECT DISTINCT l_orderkey, 'source_parse_not_success', l_linenumber || ':failed' FROM lineitem WHERE l_quantity > 48
  UNION ALL SELECT o_orderkey, 'latest_basis_requires_current_filings', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def automatic_checks(s: SparkSession, d: str) -> DataFrame:
    orders, items = load_tables(s, d, "orders", "lineitem")
    per_order = items.groupBy("l_orderkey").agg(
        F.collect_list(text_of("l_suppkey")).alias("evidence_filing_ids"), F.collect_set(F.when(F.col("l_suppkey") % 5 != 0, text_of("l_suppkey"))).alias("filing_ids"),
        F.collect_list(F.struct(text_of("l_linenumber").alias("source_id"), F.when(F.col("l_quantity") > 48, "failed").otherwise("success").alias("parse_status"))).alias("sources"),
    )
    records = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        *per_order.columns, F.when(F.col("o_orderstatus") == "F", "latest_effective").alias("version_basis"),
        F.array(F.struct(F.col("o_custkey").alias("filing_id"), (F.col("o_custkey") % 2 != 0).alias("is_current"))).alias("versions"),
    )
    return V.automatic_checks(records, "l_orderkey")


@query("d20_event_reports", """SELECT event_id, event_type FROM events WHERE (contains(regexp_replace(event_type, '[^가-힣A-Za-z0-9]', '', 'g'), 'click') OR contains(regexp_replace(event_type, '[^가-힣A-Za-z0-9]', '', 'g'), 'purchase'))
  AND CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'""")
def event_reports(s: SparkSession, d: str) -> DataFrame:
    return V.event_reports(load_table(s, d, "events"), "event_type", "ts", ["cl-ick", "purchase"], "2024-01-02", "2024-01-20").select("event_id", "event_type")


@query("e12_recomputed", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'calculation_operation_invalid' WHEN c_custkey % 3 = 0 THEN 'calculation_result_mismatch' END AS reason FROM customer""")
def recomputed(s: SparkSession, d: str) -> DataFrame:
    b = F.col("c_custkey").cast("decimal(18,2)")
    rows = load_table(s, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, "product").when(F.col("c_custkey") % 2 == 0, "sum").otherwise("difference").alias("operation"),
        F.lit(5).cast("decimal(18,2)").alias("a"), b.alias("b"),
        (b + F.when(F.col("c_custkey") % 2 == 0, 5).otherwise(-5) + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)).alias("declared"),
    )
    return V.recomputed(rows, "operation", "a", "b", "declared").select("c_custkey", "reason")


@query("e16_confirmed_values", """WITH c AS (SELECT l_orderkey, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT o_orderkey AS l_orderkey, CAST(1 + o_orderkey % 50 AS DOUBLE) AS value FROM orders)
  SELECT l_orderkey, value, CASE WHEN n = 1 THEN 'confirmed' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM f LEFT JOIN c USING (l_orderkey, value)""")
def confirmed(s: SparkSession, d: str) -> DataFrame:
    facts = load_table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 50).cast("double").alias("value"))
    return V.confirm_in_cells(facts, load_table(s, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("value")), "l_orderkey", "value")


@query("x13_seed_gates", """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies, l_returnflag, l_linestatus FROM lineitem),
  g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS vals FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN copies > 1 THEN 'duplicate_fact_id' END, CASE WHEN vals > 1 THEN 'conflicting_grain' END, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) THEN 'evidence_missing' END,
  CASE WHEN l_linestatus <> 'F' THEN 'not_validated' END], lambda x: x IS NOT NULL), ',') AS reasons FROM i JOIN g USING (l_orderkey)""")
def seed_gates(s: SparkSession, d: str) -> DataFrame:
    items, parts = load_tables(s, d, "lineitem", "part")
    seed = items.select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_partkey").alias("p_partkey"), "l_returnflag", F.when(F.col("l_linestatus") == "F", "validated").alias("validation_status"))
    gated = V.seed_gates(seed, parts.filter("p_size < 40"), "fact_id", ["l_orderkey"], ["l_returnflag"], "p_partkey")
    return gated.select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


query("x14_coverage_lists", """SELECT o_orderpriority, o_orderstatus, count(*) AS companies, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey) AS members FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1, 2""")(
    lambda s, d: load_table(s, d, "orders").filter("o_totalprice > 300000").groupBy("o_orderpriority", "o_orderstatus").agg(F.array_sort(F.collect_set("o_custkey")).alias("m")).select(
        "o_orderpriority", "o_orderstatus", F.size("m").cast("long").alias("companies"), F.array_join(F.col("m").cast("array<string>"), ",").alias("members")
    )
)
