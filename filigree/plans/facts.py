"""Facts, calculations, conflicts and coverage over line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import calculation as C
from filigree.operators import relational as R
from filigree.plans.registry import query
from filigree.session import load_table, load_tables

REVENUE_SQL = """revenue AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def revenue(s: SparkSession, d: str) -> DataFrame:
    """Revenue per company and year, in exact decimals."""
    items, orders = load_tables(s, d, "lineitem", "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value")
    )


query("f7_fiscal_year_facts", f"WITH {REVENUE_SQL} SELECT * FROM revenue WHERE fiscal_year = 1996")(lambda s, d: revenue(s, d).filter("fiscal_year = 1996"))
query("w4_growth", f"""WITH {REVENUE_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY company ORDER BY fiscal_year) AS previous FROM revenue)
  SELECT company, fiscal_year, value, previous, value - previous AS difference, CASE WHEN previous <> 0 THEN round(CAST(value - previous AS DOUBLE) / CAST(previous AS DOUBLE) * 100, 3) END AS growth FROM p""")(
    lambda s, d: R.change_over_periods(revenue(s, d), ["company"], "fiscal_year", "value").withColumn(
        "growth", F.when(F.col("previous") != 0, F.round(F.col("difference").cast("double") / F.col("previous").cast("double") * 100, 3))
    )
)
query("w6_latest_three_periods", f"WITH {REVENUE_SQL} SELECT company, fiscal_year, value, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC) AS r FROM revenue) WHERE r <= 3")(
    lambda s, d: R.top_per_key(revenue(s, d), ["company"], [F.desc("fiscal_year")], 3)
)

# quotients in whole numbers, rounded once half away from zero, as a SQL that divides decimals in doubles cannot be exact
_OVER = {"ratio": "b * 1000000", "percentage_ratio": "b * 100000000", "growth_rate": "(b - a) * 100000000"}
_EXACT = {op: f"sign({n}) * sign(a) * CAST((2 * abs({n}) + abs(a)) // (2 * abs(a)) AS DECIMAL(30,0)) * 0.000001" for op, n in _OVER.items()} | {"sum": "(a + b) * 0.01", "difference": "(b - a) * 0.01", "lookup": "a * 0.01"}
for _op, _e in _EXACT.items():
    _zero = "FALSE" if _op not in _OVER else "a = 0"

    def _calc(s: SparkSession, d: str, op: str = _op) -> DataFrame:
        c = load_table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, 0).otherwise(F.col("c_acctbal")).cast("decimal(18,2)").alias("a"), (F.col("c_custkey") * 3).cast("decimal(18,2)").alias("b"))
        return c.select("c_custkey", C.calculate(op, *[F.col("a"), F.col("b")][: 1 if op == "lookup" else 2]).alias("r")).select("c_custkey", "r.value", "r.reason")

    query(f"x15_{_op}", f"""WITH c AS (SELECT c_custkey, CAST(round(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END * 100) AS HUGEINT) AS a, CAST(c_custkey * 300 AS HUGEINT) AS b FROM customer)
      SELECT c_custkey, CASE WHEN NOT ({_zero}) THEN CAST({_e} AS DECIMAL(38,6)) END AS value, CASE WHEN {_zero} THEN 'zero_base' END AS reason FROM c""")(_calc)

query("x17_extremes", f"""WITH {REVENUE_SQL}, t AS (SELECT fiscal_year, max(value) AS top FROM revenue GROUP BY 1)
  SELECT fiscal_year, max(value) AS top_value, min(company) AS winner, count(*) > 1 AS tie FROM revenue JOIN t USING (fiscal_year) WHERE value = top GROUP BY 1""")(
    lambda s, d: C.extremes(revenue(s, d), ["fiscal_year"], "company", "value")
)
query("x18_identity_gap", """SELECT l_orderkey, sum(CASE WHEN l_linenumber = 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) - sum(CASE WHEN l_linenumber = 2 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END)
  - sum(CASE WHEN l_linenumber = 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS gap FROM lineitem GROUP BY 1""")(
    lambda s, d: C.identity_gap(load_table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("account"), C.money("l_extendedprice").alias("value")), ["l_orderkey"], "account", "value", "1", ["2", "3"])
)
query("x19_same_grain", "SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS same_grain FROM lineitem GROUP BY 1")(
    lambda s, d: C.same_grain(load_table(s, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])
)
query("x20_premise", f"""WITH {REVENUE_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY company ORDER BY fiscal_year) AS previous FROM revenue)
  SELECT company, fiscal_year, value > previous AS premise_holds FROM p WHERE previous IS NOT NULL""")(
    lambda s, d: R.change_over_periods(revenue(s, d), ["company"], "fiscal_year", "value").filter("previous is not null").select(
        "company", "fiscal_year", C.premise_check(F.lit(1), F.col("previous"), F.col("value")).alias("premise_holds")
    )
)
query("j6_label_value_pairs", """SELECT DISTINCT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_linenumber AS l_linenumber_after, b.l_partkey AS l_partkey_after
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber""")(
    lambda s, d: R.following_pairs(*[load_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")] * 2, ["l_orderkey"], "l_linenumber")
)
query("j19_band_join", """SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS l_linenumber_near, b.l_partkey AS l_partkey_near FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber - 2 AND a.l_linenumber + 1 WHERE a.l_returnflag = 'R'""")(
    lambda s, d: R.band_join(load_table(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"), load_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", 2, 1)
)
query("j10_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(
    lambda s, d: load_table(s, d, "customer").join(load_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
)
query("j11_s14_semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")(
    lambda s, d: load_table(s, d, "part").join(load_table(s, d, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")
)
query("j1_projection", """SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 30 AND o_orderstatus <> 'P'""")(
    lambda s, d: load_table(s, d, "lineitem").filter("l_quantity >= 30").join(load_table(s, d, "orders").filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    .join(load_table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    .select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment", "n_name")
)
query("j2_a4_distinct_list", """SELECT o_custkey AS company, count(*) AS facts, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")(
    lambda s, d: load_table(s, d, "lineitem").join(load_table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("company")).agg(
        F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")
    )
)
query("j4_a6_flags", """SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), FALSE) AS any_returned, coalesce(bool_and(l_linestatus = 'F'), FALSE) AS all_final FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")(
    lambda s, d: load_table(s, d, "orders").join(load_table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(
        F.coalesce(F.bool_or(F.col("l_returnflag") == "R"), F.lit(False)).alias("any_returned"), F.coalesce(F.bool_and(F.col("l_linestatus") == "F"), F.lit(False)).alias("all_final")
    )
)
query("j13_merge_sides", """SELECT k, a.n AS ordered, b.n AS balance FROM (SELECT o_custkey % 50 AS k, count(*) AS n FROM orders WHERE o_custkey % 50 < 40 GROUP BY 1) a
  FULL JOIN (SELECT c_custkey % 50 AS k, count(*) AS n FROM customer WHERE c_custkey % 50 > 10 GROUP BY 1) b USING (k)""")(
    lambda s, d: R.merge_sides(
        load_table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.count("*").alias("ordered")).filter("k < 40"),
        load_table(s, d, "customer").groupBy((F.col("c_custkey") % 50).alias("k")).agg(F.count("*").alias("balance")).filter("k > 10"), ["k"],
    )
)
query("j15_exactly_one", """WITH f AS (SELECT o_custkey AS c_custkey, count(*) AS n, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT c.c_custkey, CASE WHEN n = 1 THEN o_orderkey END AS o_orderkey, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS match_status FROM customer c LEFT JOIN f USING (c_custkey)""")(
    lambda s, d: R.exactly_one(load_table(s, d, "customer").select("c_custkey"), load_table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), ["c_custkey"], "o_orderkey")
)
_YEARS = "SELECT CAST(y AS INT) AS fiscal_year FROM (VALUES (1994), (1995), (1996)) t(y)"
query("j18_missing_grains", f"WITH {REVENUE_SQL} SELECT c_custkey AS company, fiscal_year FROM customer CROSS JOIN ({_YEARS}) y WHERE NOT EXISTS (SELECT 1 FROM revenue r WHERE r.company = c_custkey AND r.fiscal_year = y.fiscal_year)")(
    lambda s, d: R.missing_grains(load_table(s, d, "customer").select(F.col("c_custkey").alias("company")), s.createDataFrame([(1994,), (1995,), (1996,)], "fiscal_year int"), revenue(s, d), ["company", "fiscal_year"])
)
query("a12_coverage", f"""WITH {REVENUE_SQL}, g AS (SELECT c_custkey AS company, y.fiscal_year, r.company IS NOT NULL AS there FROM customer CROSS JOIN ({_YEARS}) y LEFT JOIN revenue r ON r.company = c_custkey AND r.fiscal_year = y.fiscal_year)
  SELECT company, CAST(sum(CAST(there AS INT)) AS BIGINT) AS present, coalesce(string_agg(CASE WHEN NOT there THEN CAST(fiscal_year AS VARCHAR) END, ',' ORDER BY fiscal_year), '') AS missing, bool_and(there) AS complete FROM g GROUP BY 1""")(
    lambda s, d: R.coverage(load_table(s, d, "customer").select(F.col("c_custkey").alias("company")), s.createDataFrame([("1994",), ("1995",), ("1996",)], "fiscal_year string"), revenue(s, d).withColumn("fiscal_year", F.col("fiscal_year").cast("string")), "company", "fiscal_year")
)
query("a13_reject_conflicts", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) = 1)""")(
    lambda s, d: R.reject_conflicts(load_table(s, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber")
)
query("a14_priority_resolution", """WITH f AS (SELECT l_partkey, CAST(ascii(l_returnflag) AS INT) AS priority, l_suppkey AS v FROM lineitem), m AS (SELECT l_partkey, min(priority) AS priority FROM f GROUP BY 1)
  SELECT l_partkey, min(priority) AS priority, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'unique' END AS resolution FROM f JOIN m USING (l_partkey, priority) GROUP BY 1""")(
    lambda s, d: R.resolve_by_priority(load_table(s, d, "lineitem").select("l_partkey", F.ascii("l_returnflag").alias("priority"), F.col("l_suppkey").alias("v")), ["l_partkey"], "priority", "v")
)
query("a15_reject_duplicates", "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) = 1)")(
    lambda s, d: R.reject_duplicates(load_table(s, d, "lineitem"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")
)
@query("a21_attribution_sum", """SELECT t.l_orderkey, t.l_linenumber, CAST(CAST(a.l_extendedprice AS DECIMAL(18,2)) + CAST(b.l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,2)) AS attributed FROM lineitem t
  JOIN lineitem a ON a.l_orderkey = t.l_orderkey AND a.l_linenumber = t.l_linenumber + 1 JOIN lineitem b ON b.l_orderkey = t.l_orderkey AND b.l_linenumber = t.l_linenumber + 2""")
def attribution(s: SparkSession, d: str) -> DataFrame:
    t = load_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.money("l_extendedprice").alias("v"))
    part = lambda n: t.select("l_orderkey", (F.col("l_linenumber") - n).alias("l_linenumber"), F.col("v").alias(f"v{n}"))
    return t.join(part(1), ["l_orderkey", "l_linenumber"]).join(part(2), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("v1") + F.col("v2")).cast("decimal(28,2)").alias("attributed"))


query("w7_term_years", "SELECT l_orderkey, l_linenumber, CAST(1996 - (max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber) AS INT) AS term_year FROM lineitem")(
    lambda s, d: R.term_years(load_table(s, d, "lineitem").withColumn("fy", F.lit(1996)), "l_orderkey", "l_linenumber", "fy").select("l_orderkey", "l_linenumber", "term_year")
)
query("t1_top_k", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(
    lambda s, d: load_table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
)
query("t2_top_k_per_key", "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")(
    lambda s, d: R.top_per_key(load_table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")
)
query("t6_threshold_list", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 5000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 70")(
    lambda s, d: load_table(s, d, "supplier").filter("s_acctbal >= 5000").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(70).select("s_suppkey", "s_name")
)
query("u1_union_all", "SELECT o_orderkey AS id, 'order' AS grain FROM orders UNION ALL SELECT l_orderkey, 'item' FROM lineitem")(
    lambda s, d: load_table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("grain")).unionByName(load_table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("item").alias("grain")))
)
query("u2_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")(
    lambda s, d: load_table(s, d, "nation").select(F.col("n_name").alias("name")).union(load_table(s, d, "region").select("r_name")).distinct()
)
query("u3_difference", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')")(
    lambda s, d: load_table(s, d, "lineitem").filter("l_returnflag = 'A'").select("l_suppkey").distinct().join(load_table(s, d, "lineitem").filter("l_quantity = 50 and l_returnflag = 'R'").select("l_suppkey"), "l_suppkey", "left_anti")
)
@query("d8_round_robin", """WITH p AS (SELECT p_partkey, p_size % 3 AS pool, row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_size % 3) AS n FROM part),
  a AS (SELECT range AS k, CAST(range % 3 AS INT) AS pool FROM range(300)) SELECT a.k, p.p_partkey FROM a JOIN p ON a.pool = p.pool AND p.i = (a.k // 3) % p.n""")
def round_robin(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = load_table(s, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("pool"))
    w = Window.partitionBy("pool")
    p = p.withColumns({"i": F.row_number().over(w.orderBy("p_partkey")) - 1, "n": F.count("*").over(w)})
    a = s.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("pool"))
    return a.join(p, "pool").filter(F.col("i") == F.expr("(k div 3) % n")).select("k", "p_partkey")
