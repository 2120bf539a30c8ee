"""Comparison along axes, schemas, exact claims, correction pairs, labelled dates and units, driven by values of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import text
from filigree.operators import calculation as C
from filigree.operators import evaldata, schemas, verification
from filigree.plans.registry import query
from filigree.session import load_table, load_tables
from filigree.sources import markup

text_of = lambda c: F.col(c).cast("string")
AXES = ["company", "period", "metric", "scope", "unit"]
ASKED = {"period": ["1996", "1997"], "metric": ["level", "total"]}

_FACTS = """facts AS (SELECT CAST(o_custkey AS VARCHAR) AS company, CAST(year(o_orderdate) AS VARCHAR) AS period, m.metric, o_orderpriority AS scope, CASE WHEN o_orderstatus = 'P' THEN 'usd' ELSE 'won' END AS unit,
    CASE WHEN m.metric = 'total' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(floor(o_totalprice / 100000) * 100000 AS DECIMAL(18,2)) END AS v FROM orders, (VALUES ('total'), ('level')) m(metric)),
  grain AS (SELECT company, period, metric, scope, unit, CASE WHEN min(v) = max(v) THEN min(v) END AS v, CAST(min(v) < max(v) AS INT) AS torn FROM facts GROUP BY ALL)"""


def _along(axis: str) -> str:
    rest = ", ".join(f"CAST(NULL AS VARCHAR) AS {a}" if a == axis else a for a in AXES)
    return f"SELECT '{axis}' AS compared, {axis} AS member, {rest}, v, torn FROM grain"


_LACKS = " ".join(f"WHEN compared = '{a}' THEN concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce(bool_or(member = '{m}' AND v IS NOT NULL), FALSE) THEN '{m}' END" for m in ms) + ")" for a, ms in ASKED.items())


@query("x17_axes", f"""WITH {_FACTS}, e AS ({" UNION ALL ".join(_along(a) for a in AXES)}), t AS (SELECT *, max(v) OVER (PARTITION BY compared, {", ".join(AXES)}) AS top FROM e),
  g AS (SELECT compared, {", ".join(AXES)}, count(v) AS members, CAST(sum(torn) AS BIGINT) AS ambiguous, max(v) AS top_value, count(*) FILTER (v = top) > 1 AS tie, min(member) FILTER (v = top) AS best,
    CASE {_LACKS} ELSE '' END AS missing FROM t GROUP BY compared, {", ".join(AXES)})
  SELECT compared, {", ".join(AXES)}, members, ambiguous, top_value, tie, missing, CASE WHEN missing <> '' OR ambiguous > 0 THEN 'incomplete' WHEN members < 2 THEN 'single' ELSE 'complete' END AS status,
    CASE WHEN missing = '' AND ambiguous = 0 AND members > 1 AND NOT tie THEN best END AS winner FROM g""")
def axes(s: SparkSession, d: str) -> DataFrame:
    total, level = F.col("o_totalprice"), F.floor(F.col("o_totalprice") / 100000) * 100000
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("decimal(18,2)").alias("v")) for m, v in (("total", total), ("level", level))])
    facts = load_table(s, d, "orders").select(
        F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("period"), F.explode(metrics).alias("m"), F.col("o_orderpriority").alias("scope"), F.when(F.col("o_orderstatus") == "P", "usd").otherwise("won").alias("unit")
    )
    return C.compare_axes(facts.select("company", "period", "m.metric", "scope", "unit", "m.v"), AXES, "v", ASKED)


ORDER_SCHEMA = {
    "type": "object", "required": ["id", "status", "lines"],
    "properties": {
        "id": {"type": "integer", "minimum": 100}, "status": {"enum": ["F", "O"]}, "priority": {"type": "string", "pattern": "[1-3]-[A-Z]+", "minLength": 7}, "at": {"type": "string", "format": "date"}, "total": {"type": ["integer", "null"]},
        "lines": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {
            "type": "object", "additionalProperties": False,
            "properties": {"number": {"type": "integer"}, "flag": {"oneOf": [{"const": "R"}, {"type": "string", "minLength": 2}]}, "tax": {"type": "number", "minimum": 2}},
        }},
    },
}


@query("g_schema", """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f, CAST(round(l_tax * 100) AS INT) AS t, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS x FROM lineitem),
  i AS (SELECT *, '$.lines[' || (row_number() OVER (PARTITION BY k ORDER BY n, f, t, x) - 1) || ']' AS p FROM l), c AS (SELECT k, count(*) AS n, count(DISTINCT (n, f, t, x)) AS m FROM l GROUP BY 1), o AS (SELECT * FROM orders LEFT JOIN c ON k = o_orderkey)
  SELECT o_orderkey, '$.id' AS path, 'minimum' AS rule FROM o WHERE o_orderkey < 100 UNION ALL SELECT o_orderkey, '$.status', 'enum' FROM o WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT o_orderkey, '$.priority', 'pattern' FROM o WHERE o_orderpriority >= '4' UNION ALL SELECT o_orderkey, '$.priority', 'minLength' FROM o WHERE length(o_orderpriority) < 7
  UNION ALL SELECT o_orderkey, '$.at', 'date' FROM o WHERE month(o_orderdate) < 10 UNION ALL SELECT o_orderkey, '$.total', 'type' FROM o WHERE o_totalprice < 200000
  UNION ALL SELECT o_orderkey, '$.lines', 'required' FROM o WHERE n IS NULL UNION ALL SELECT o_orderkey, '$.lines', 'minItems' FROM o WHERE n < 2 UNION ALL SELECT o_orderkey, '$.lines', 'uniqueItems' FROM o WHERE m < n
  UNION ALL SELECT k, p || '.flag', r.rule FROM i, (VALUES ('oneOf'), ('const'), ('minLength')) r(rule) WHERE f <> 'R' AND k IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT k, p || '.tax', 'minimum' FROM i WHERE t < 2 AND k IN (SELECT o_orderkey FROM orders) UNION ALL SELECT k, p || '.note', 'unknown' FROM i WHERE x = 1 AND k IN (SELECT o_orderkey FROM orders)""")
def order_schema(s: SparkSession, d: str) -> DataFrame:
    items, orders = load_tables(s, d, "lineitem", "orders")
    line = F.struct(
        F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("flag"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.when(F.col("l_discount") > 0.05, "dear").alias("note")
    )
    lines = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line), _by_note).alias("lines"))
    # a month without its zero is no date; small totals are texts
    day = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.date_format("o_orderdate", "dd"))
    record = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), day.alias("at"),
        F.when(F.col("o_totalprice") >= 200000, F.floor("o_totalprice")).alias("total"), F.when(F.col("o_totalprice") < 200000, text_of("o_totalprice")).alias("total_text"), F.col("lines"),
    )
    # two fields of which one is there become the one field of the record
    records = orders.join(lines, "o_orderkey", "left").select("o_orderkey", F.regexp_replace(F.to_json(record), '"total_text"', '"total"').alias("record"))
    return schemas.schema_violations(records, "record", ORDER_SCHEMA).select("o_orderkey", "path", "rule")


def _by_note(a, b):
    """Order by number, flag and tax, lines without a note first."""
    key = lambda x: F.struct(x["number"], x["flag"], x["tax"], x["note"].isNotNull())
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


@query("e14_exact", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'answer_asserted_without_safe_evidence' END, CASE WHEN l_linestatus <> 'F' THEN 'unanswerable_draft' END,
  CASE WHEN l_linestatus <> 'F' THEN 'unanswerable_answer_has_citation' END, CASE WHEN round(l_tax * 100) <> 0 THEN 'numeric_claim_not_grounded' END) AS reasons FROM lineitem""")
def exact_claims(s: SparkSession, d: str) -> DataFrame:
    """A claim with twelve more places than its fact: right only where the last digit, the tax, is zero."""
    price = C.money("l_extendedprice").cast("string")
    one = F.array(F.lit("1"))
    drafts = load_table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("?").alias("question"), F.lit("-").alias("answer"), (F.col("l_linestatus") == "F").alias("answerable"), (F.col("l_returnflag") != "R").alias("safe"),
        one.alias("citation_ids"), F.array(F.concat(price, F.lit("00000000000"), F.round(F.col("l_tax") * 100).cast("int"))).alias("numeric_values"), F.array().cast("array<string>").alias("reason_codes"),
        F.array(F.struct(F.lit("1").alias("evidence_id"), F.col("l_returnflag").alias("text"))).alias("evidence"), F.array(F.struct(price.alias("value"), one.alias("evidence_ids"))).alias("facts"),
        F.lit(None).cast("struct<value:string,evidence_ids:array<string>>").alias("calculation"),
    )
    return verification.verify_answers(drafts).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("reasons", ",").alias("reasons"))


@query("d6_correction_pairs", """WITH e AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, bool_and(l_linestatus = 'O') AS first_open, bool_or(l_linestatus = 'O') AS last_open, bool_or(l_returnflag = 'R') AS cited FROM lineitem GROUP BY 1)
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_totalprice < 100000 THEN 'correction_pair_required'
    WHEN o_orderpriority <> '1-URGENT' AND a < b AND NOT first_open AND last_open AND cited THEN NULL ELSE 'correction_pair_invalid' END AS reason FROM orders JOIN e ON l_orderkey = o_orderkey""")
def correction_pairs(s: SparkSession, d: str) -> DataFrame:
    items, orders = load_tables(s, d, "lineitem", "orders")
    n, open_ = F.col("l_linenumber"), F.col("l_linestatus") == "O"
    lines = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(n).cast("string").alias("a"), F.max(n).cast("string").alias("b"), F.bool_and(open_).alias("first_open"), F.bool_or(open_).alias("last_open"),
        F.collect_set(n.cast("string")).alias("numbers"), F.bool_or(F.col("l_returnflag") == "R").alias("cited"),
    )
    of_order = lambda c: F.concat(text_of("o_orderkey"), F.lit("-"), c)
    pair = F.struct(
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("event_id"), of_order(F.col("a")).alias("original_filing_id"), of_order(F.col("b")).alias("current_filing_id"),
        F.col("a").alias("original_evidence_id"), F.col("b").alias("current_evidence_id"), F.col("first_open").alias("original_is_current"), F.col("last_open").alias("current_is_current"),
    )
    # evidence that no returned line cites is not among the slots'
    slot = F.struct(F.when(F.col("cited"), F.col("numbers")).alias("target_evidence_ids"), F.transform("numbers", of_order).alias("filing_ids"))
    records = orders.join(lines, "o_orderkey").select(
        "o_orderkey", F.array(F.when(F.col("o_orderstatus") == "O", "status").otherwise("correction_materiality")).alias("supported_dimensions"), F.when(F.col("o_totalprice") >= 100000, pair).alias("version_pair"), F.array(slot).alias("slots")
    )
    return records.select("o_orderkey", evaldata.correction_pair_failure().alias("reason"))


query("g_submission_dates", """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate AS DATE) END AS at FROM orders""")(
    lambda s, d: load_table(s, d, "orders").select(
        "o_orderkey", text.submission_date(F.concat(F.when(F.col("o_orderstatus") == "F", "최초제출일: ").when(F.col("o_orderstatus") == "O", "정정관련 공시서류제출일 ").otherwise("작성일: "), F.date_format("o_orderdate", "yyyy.MM.dd"))).alias("at")
    )
)
query("s10_units", """SELECT o_orderkey AS table_no, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '천원' WHEN o_orderstatus = 'F' THEN '원' END AS unit FROM orders""")(
    lambda s, d: markup.unit_and_caption(
        load_table(s, d, "orders").select(
            F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("table_no"),
            F.when(F.col("o_orderpriority") == "3-MEDIUM", "천원").when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "yyyy.MM.dd")).when(F.col("o_orderpriority") == "1-URGENT", "당기말 현재").alias("declared_unit"),
            F.explode(F.array(
                F.struct(F.lit(0).alias("sequence_no"), F.lit("note").alias("kind"), F.when(F.col("o_orderstatus") == "F", "(단위 : 원)").otherwise("원").alias("text")),
                F.struct(F.lit(1).alias("sequence_no"), F.lit("note").alias("kind"), F.concat(F.lit("단위: "), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(" 기준")).alias("text")),
                F.struct(F.lit(2).alias("sequence_no"), F.lit("table").alias("kind"), F.lit("").alias("text")),
            )).alias("b"),
        ).select("page_id", "table_no", "declared_unit", "b.*")
    ).select("table_no", "unit")
)
