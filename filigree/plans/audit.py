"""Universe, provenance, declared counts, event inventory and case generation over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import evaldata as V
from filigree.operators import extraction as X
from filigree.operators import relational as R
from filigree.plans.registry import query
from filigree.session import load_table, load_tables


@query("x10_universe", """WITH r AS (SELECT o_custkey AS company, max_by((o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS INT) END), (CAST(o_orderdate AS DATE), o_orderkey)) AS r FROM orders GROUP BY 1),
  s AS (SELECT c_custkey AS company, r[1] AS filing_id, r[3] AS base_year, coalesce(r[2] IN ('F', 'O'), FALSE) AS safe FROM customer LEFT JOIN r ON company = c_custkey)
  SELECT company, CASE WHEN safe AND base_year IS NOT NULL THEN filing_id END AS filing_id, CASE WHEN safe THEN base_year END AS fiscal_year,
  CASE WHEN NOT safe THEN 'answer_safe_annual_report_missing' WHEN base_year IS NULL THEN 'annual_report_fiscal_year_missing' END AS reason_code FROM s""")
def universe(s: SparkSession, d: str) -> DataFrame:
    reports = load_table(s, d, "orders").select(
        F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("filing_id"), F.col("o_orderdate").cast("date").alias("filed_at"),
        F.when(F.col("o_orderstatus") == "F", "root").when(F.col("o_orderstatus") == "O", "resolved").otherwise("unresolved").alias("lineage_status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("base_year"),
    )
    return X.universe(load_table(s, d, "customer").select(F.col("c_custkey").alias("company")), reports)


_CELL = "cells AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS evidence_id, min(CAST(l_quantity AS INT)) AS value FROM lineitem GROUP BY 1, 2)"


@query("e17_provenance", f"""WITH {_CELL}, f AS (SELECT l_orderkey AS fact_id, CASE l_orderkey % 3 WHEN 0 THEN sum(value) WHEN 1 THEN max(value) ELSE 7 END AS value, count(*) AS n, sum(value) AS total, bool_or(value = 7) AS has FROM cells GROUP BY 1)
  SELECT fact_id, CASE WHEN fact_id % 3 = 2 AND NOT has AND total <> 7 THEN 'fact_not_in_cited_evidence' END AS reason_code FROM f""")
def provenance(s: SparkSession, d: str) -> DataFrame:
    cells = load_table(s, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_quantity").cast("int").alias("value"))
    cells = cells.groupBy("l_orderkey", "evidence_id").agg(F.min("value").alias("value"))
    k = F.first("l_orderkey") % 3
    facts = cells.groupBy("l_orderkey").agg(F.when(k == 0, F.sum("value")).when(k == 1, F.max("value")).otherwise(7).alias("value"), F.collect_list("evidence_id").alias("evidence_ids"))
    return X.provenance(facts.withColumnRenamed("l_orderkey", "fact_id"), cells)


query("d19_declared_counts", """WITH a AS (SELECT l_orderkey AS k, count(*) AS actual FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_orderkey % 8 AS declared FROM orders)
  SELECT k, coalesce(declared, 0) AS declared, coalesce(actual, 0) AS actual FROM a FULL JOIN b USING (k) WHERE coalesce(declared, 0) <> coalesce(actual, 0)""")(
    lambda s, d: X.count_mismatches(load_table(s, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 8).alias("declared")), load_table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")
)


@query("a11_event_inventory", """SELECT o_custkey AS issuer, p AS pattern, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS latest, max_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS latest_id
  FROM orders, (VALUES ('URGENT'), ('HIGH'), ('E')) t(p) WHERE contains(o_orderpriority, p) GROUP BY 1, 2""")
def inventory(s: SparkSession, d: str) -> DataFrame:
    patterns = F.explode(F.array(*[F.lit(p) for p in ("URGENT", "HIGH", "E")]))
    rows = load_table(s, d, "orders").withColumn("pattern", patterns).filter(F.col("o_orderpriority").contains(F.col("pattern")))
    at = F.col("o_orderdate").cast("date")
    return rows.groupBy(F.col("o_custkey").alias("issuer"), "pattern").agg(F.count("*").alias("n"), F.max(at).alias("latest"), F.max_by("o_orderkey", F.struct(at, "o_orderkey")).alias("latest_id"))


@query("e19_cycled_cases", """WITH g AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT range AS case_no, s_suppkey FROM range(500) JOIN g ON g.i = range % g.n""")
def cycled(s: SparkSession, d: str) -> DataFrame:
    return V.cycled(s.range(500).withColumnRenamed("id", "case_no"), load_table(s, d, "supplier").select("s_suppkey"), "case_no", "s_suppkey").select("case_no", "s_suppkey")


@query("d5_template_expansion", """SELECT left(sha256(CAST(n_nationkey AS VARCHAR) || chr(31) || t), 20) AS case_id, n_nationkey, t AS template FROM nation, (VALUES ('sum', 0), ('list', 1), ('rank', 2)) x(t, r) WHERE n_regionkey >= r""")
def expansion(s: SparkSession, d: str) -> DataFrame:
    from filigree.functions.text import stable_digest

    templates = s.createDataFrame([("sum", 0), ("list", 1), ("rank", 2)], "template string, r int")
    rows = load_table(s, d, "nation").crossJoin(F.broadcast(templates)).filter("n_regionkey >= r")
    return rows.select(stable_digest(F.col("n_nationkey"), F.col("template"), length=20).alias("case_id"), "n_nationkey", "template")


@query("x9_reconstruction", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'not_reconstructed' WHEN o_orderkey % 5 = 0 THEN 'status_mismatch' WHEN o_orderkey % 3 = 0 THEN 'amount_mismatch' END AS reason_code FROM orders""")
def reconstruction(s: SparkSession, d: str) -> DataFrame:
    seed = load_table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    again = seed.filter("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, "?").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"))
    return X.validate_by_reconstruction(seed, again, "id", ["status", "amount"]).select("id", "reason_code")


@query("x23_ranked_if_complete", """WITH r AS (SELECT o_custkey AS company, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM orders GROUP BY 1), c AS (SELECT count(*) > 0 AS complete FROM r)
  SELECT company, value FROM r, c WHERE complete ORDER BY value DESC, company LIMIT 20""")
def ranked(s: SparkSession, d: str) -> DataFrame:
    r = load_table(s, d, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value"))
    complete = r.agg((F.count("*") > 0).alias("complete"))
    return r.crossJoin(F.broadcast(complete)).filter("complete").orderBy(F.desc("value"), "company").limit(20).select("company", "value")


@query("d16_group_splits")
def splits(s: SparkSession, d: str) -> DataFrame:
    """Events that share a user or a minute fall in one split."""
    events, = load_tables(s, d, "events")
    keys = F.array(F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("at:"), F.date_trunc("minute", F.col("ts").cast("timestamp"))))
    return X.group_splits(events.select(F.col("event_id").alias("case_id"), keys.alias("keys")), {"dev": 80, "test": 20})


query("u5_multiset_equality", "SELECT a.o_custkey, list_sort(list(a.o_orderstatus)) = list_sort(list(CASE WHEN a.o_orderkey % 4 = 0 THEN 'F' ELSE a.o_orderstatus END)) AS equal FROM orders a GROUP BY 1")(
    lambda s, d: load_table(s, d, "orders").groupBy("o_custkey").agg(
        (F.array_sort(F.collect_list("o_orderstatus")) == F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus"))))).alias("equal")
    )
)
query("w3_first_occurrence_rank", "SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS INT) AS rank FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2)")(
    lambda s, d: R.ranked_per_key(load_table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id")), ["user_id"], [F.asc("first_id")]).select("user_id", "event_type", "rank")
)
