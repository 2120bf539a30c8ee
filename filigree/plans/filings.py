"""Version lineage, policies and filters over orders as filings (issuer: the customer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import relational as R
from filigree.operators import versions as V
from filigree.plans.registry import query
from filigree.session import load_table

AS_OF = "1996-06-30"
FILINGS_SQL = """filings AS (SELECT o_orderkey AS filing_id, o_custkey AS issuer, CAST(o_orderdate AS DATE) AS filed_at,
  o_orderpriority AS kind, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"""
CHAIN_SQL = FILINGS_SQL + """, chain AS (SELECT *, CAST(row_number() OVER w AS INT) AS version_no, lag(filing_id) OVER w AS parent_id,
  filed_at AS effective_from, lead(filed_at) OVER w AS effective_to, lead(filing_id) OVER w IS NULL AS is_current
  FROM filings WINDOW w AS (PARTITION BY issuer ORDER BY filed_at, filing_id))"""


def filings(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("issuer"), F.col("o_orderdate").cast("date").alias("filed_at"),
        F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def chain(spark: SparkSession, d: str) -> DataFrame:
    return V.version_chain(filings(spark, d), "issuer", "filed_at", "filing_id")


def _bucket_sql(b: str) -> str:
    return f"WITH {FILINGS_SQL} SELECT CAST(date_trunc('{b}', filed_at) AS DATE) AS bucket, count(*) AS n FROM filings WHERE filed_at BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1"


for _b in ("day", "week", "month"):
    query(f"x24_trend_{_b}", _bucket_sql(_b))(
        lambda s, d, b=_b: R.time_buckets(filings(s, d).filter(F.col("filed_at").between("1995-01-01", "1996-12-31")), "filed_at", b)
    )

query("x24_trend_by_kind", f"""WITH {FILINGS_SQL} SELECT kind, count(*) AS n, max(filed_at) AS latest, max_by(filing_id, (filed_at, filing_id)) AS latest_id,
  CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS final FROM filings GROUP BY kind""")(
    lambda s, d: filings(s, d).groupBy("kind").agg(
        F.count("*").alias("n"), F.max("filed_at").alias("latest"), F.max_by("filing_id", F.struct("filed_at", "filing_id")).alias("latest_id"),
        F.sum((F.col("status") == "F").cast("int")).alias("final"),
    )
)
query("w2_version_chain", f"WITH {CHAIN_SQL} SELECT filing_id, issuer, version_no, parent_id, effective_from, effective_to, is_current FROM chain")(
    lambda s, d: chain(s, d).select("filing_id", "issuer", "version_no", "parent_id", "effective_from", "effective_to", "is_current")
)

_POLICY_SQL = {
    "current": f"effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR DATE '{AS_OF}' < effective_to)",
    "original": f"version_no = 1 AND effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR DATE '{AS_OF}' < effective_to)",
    "corrected": f"version_no > 1 AND effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR DATE '{AS_OF}' < effective_to)",
    "both": f"effective_from <= DATE '{AS_OF}'",
}
for _p, _sql in _POLICY_SQL.items():
    query(f"f2_policy_{_p}_as_of", f"WITH {CHAIN_SQL} SELECT filing_id, version_no FROM chain WHERE {_sql}")(
        lambda s, d, p=_p: chain(s, d).filter(V.version_predicate(p, F.lit(AS_OF).cast("date"))).select("filing_id", "version_no")
    )
query("f1_current_versions", f"WITH {CHAIN_SQL} SELECT filing_id, issuer FROM chain WHERE is_current")(
    lambda s, d: chain(s, d).filter(V.version_predicate()).select("filing_id", "issuer")
)


@query("j12_as_of_join", f"""WITH {CHAIN_SQL}, asked AS (SELECT c_custkey AS issuer, DATE '1995-01-01' + CAST(c_custkey % 1000 AS INT) AS asked_at FROM customer)
  SELECT a.issuer, a.asked_at, c.filing_id FROM asked a LEFT JOIN chain c ON a.issuer = c.issuer AND c.effective_from <= a.asked_at AND (c.effective_to IS NULL OR a.asked_at < c.effective_to)""")
def as_of(s: SparkSession, d: str) -> DataFrame:
    asked = load_table(s, d, "customer").select(F.col("c_custkey").alias("issuer"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("asked_at"))
    c = chain(s, d)
    return V.as_of_join(asked, c, "issuer", "asked_at").select(asked["issuer"], "asked_at", "filing_id")


@query("j14_unique_original", f"""WITH {FILINGS_SQL}, o AS (SELECT issuer, kind, count(*) AS matches, min(filing_id) AS original_id FROM filings WHERE status = 'F' GROUP BY 1, 2)
  SELECT f.filing_id, CASE WHEN coalesce(matches, 0) = 1 THEN 'resolved' WHEN matches > 1 THEN 'unresolved' ELSE 'missing_original' END AS lineage_status,
  CASE WHEN matches = 1 THEN o.original_id END AS original_id FROM filings f LEFT JOIN o USING (issuer, kind) WHERE f.status = 'P'""")
def originals(s: SparkSession, d: str) -> DataFrame:
    f = filings(s, d)
    return V.unique_original(f.filter("status = 'P'"), f.filter("status = 'F'"), ["issuer", "kind"], "filing_id").select("filing_id", "lineage_status", "original_id")


query("x25_lineage_summary", f"""WITH {CHAIN_SQL} SELECT issuer, count(*) AS versions, min_by(filing_id, version_no) AS root_id, max_by(filing_id, version_no) AS current_id,
  min(filed_at) AS first_at, max(filed_at) AS last_at FROM chain GROUP BY issuer""")(
    lambda s, d: V.lineage_summary(chain(s, d), "issuer", "filed_at", "filing_id")
)
query("r18_largest_event", f"""WITH {FILINGS_SQL}, n AS (SELECT issuer, kind, count(*) AS versions FROM filings GROUP BY 1, 2)
  SELECT issuer, kind, versions FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY versions DESC, kind DESC) AS r FROM n) WHERE r = 1""")(
    lambda s, d: V.largest_event(filings(s, d), "issuer", "kind")
)
query("f3_f6_f8_filters", """SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_name = 'BUILDING') AND (lower(c_name) LIKE '%1%' OR lower(c_name) LIKE '%customer#00000002%') AND c_acctbal BETWEEN 0 AND 5000""")(
    lambda s, d: load_table(s, d, "customer").filter(
        V.all_of([V.any_equal(F.lit("BUILDING"), "c_mktsegment", "c_name"), V.has_any_term(["1", "Customer#00000002"], "c_name"), None, F.col("c_acctbal").between(0, 5000)])
    ).select("c_custkey", "c_name")
)
query("w1_stratified_sample", f"WITH {FILINGS_SQL} SELECT kind, status, filing_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind, status ORDER BY filing_id) AS r FROM filings) WHERE r <= 5")(
    lambda s, d: R.stratified_sample(filings(s, d), ["kind", "status"], [F.asc("filing_id")], 5).select("kind", "status", "filing_id", "rank")
)
query("w5_last_two", f"WITH {FILINGS_SQL} SELECT issuer, filing_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY filed_at DESC, filing_id DESC) AS r FROM filings) WHERE r <= 2")(
    lambda s, d: R.top_per_key(filings(s, d), ["issuer"], [F.desc("filed_at"), F.desc("filing_id")], 2).select("issuer", "filing_id", "rank")
)
query("a10_latest_per_issuer", f"WITH {FILINGS_SQL} SELECT issuer, filing_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY filed_at DESC, filing_id) AS r FROM filings) WHERE r = 1")(
    lambda s, d: R.first_per_key(filings(s, d), ["issuer"], [F.desc("filed_at"), F.asc("filing_id")]).select("issuer", "filing_id", "amount")
)
query("d2_latest_name", """SELECT o_custkey AS issuer, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS name FROM orders WHERE o_orderpriority <> '' GROUP BY 1""")(
    lambda s, d: load_table(s, d, "orders").filter("o_orderpriority <> ''").groupBy(F.col("o_custkey").alias("issuer")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("name"))
)
query("j20_scalar_per_group", f"WITH {FILINGS_SQL} SELECT c_custkey AS issuer, (SELECT min(filing_id) FROM filings f WHERE f.issuer = c_custkey) AS first_id, (SELECT count(*) FROM filings f WHERE f.issuer = c_custkey) AS n FROM customer")(
    lambda s, d: load_table(s, d, "customer").select(F.col("c_custkey").alias("issuer")).join(
        filings(s, d).groupBy("issuer").agg(F.min("filing_id").alias("first_id"), F.count("*").alias("n")), "issuer", "left"
    ).na.fill(0, ["n"])
)
