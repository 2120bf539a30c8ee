"""Answers over order lines: lines are evidence, return flags are slots, quantities are facts; every reason comes from values of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import claims as K
from filigree.plans.registry import query
from filigree.session import load_table

_LINES = """l AS (SELECT l_orderkey AS answer, l_linenumber AS n, CAST(min(l_quantity) AS BIGINT) AS q, min(l_tax) < 0.07 AS ok, min(l_returnflag) AS rf, min(l_linestatus) AS ls FROM lineitem GROUP BY 1, 2),
  k AS (SELECT *, bool_and(ok) OVER (PARTITION BY answer, rf) AS kept, min(n) OVER (PARTITION BY answer) AS lo, max(n) OVER (PARTITION BY answer) AS hi FROM l)"""
_CALCULATED = f"""{_LINES}, p AS (SELECT a.answer, a.n AS an, b.n AS bn, a.q AS aq, b.q + CASE WHEN a.ls = 'O' AND b.ls = 'F' THEN 1 ELSE 0 END AS bq, a.ok AND b.ok AS ok, a.rf = b.rf AND a.kept AS owned, b.q % 7 = 0 AS torn, b.q % 10 = 0 AS strange,
    a.q % 5 = 0 AS wrong, a.ls = 'O' AS adds, list_filter([CASE WHEN a.kept THEN a.q END, CASE WHEN b.kept THEN b.q END], lambda x: x IS NOT NULL) AS known FROM k a JOIN k b ON a.answer = b.answer AND a.n = a.lo AND b.n = b.hi AND a.n < b.n),
  c AS (SELECT *, CASE WHEN adds THEN aq + bq ELSE bq - aq END + CASE WHEN wrong THEN 1 ELSE 0 END AS declared, concat_ws(',', CASE WHEN NOT ok THEN 'calculation_support_not_admitted' END, CASE WHEN torn THEN 'calculation_numeric_invalid' END, CASE WHEN NOT torn AND strange THEN 'calculation_operation_invalid' END,
    CASE WHEN NOT torn AND NOT strange AND wrong THEN 'calculation_result_mismatch' END, CASE WHEN NOT list_contains(known, aq) OR NOT list_contains(known, bq) THEN 'calculation_operand_evidence_missing' END, CASE WHEN NOT owned THEN 'calculation_slot_unowned' END) AS reasons FROM p)"""
_CLAIMED = f"""{_CALCULATED}, r AS (SELECT k.*, CASE WHEN k.n = hi AND q % 3 = 0 THEN 1 ELSE 0 END AS refers, c.reasons AS cr, c.declared, q + CASE WHEN ls = 'O' THEN 0 ELSE 1 END AS number FROM k LEFT JOIN c ON c.answer = k.answer),
  v AS (SELECT *, coalesce(refers = 1 AND cr = '', FALSE) AS rests FROM r),
  w AS (SELECT answer, n, number, concat_ws(',', CASE WHEN NOT ok THEN 'claim_citation_not_admitted' END, CASE WHEN NOT kept THEN 'evidence_slot_mismatch' END, CASE WHEN NOT kept THEN 'fact_ref_not_admitted' END, CASE WHEN refers = 1 AND cr <> '' THEN cr END,
    CASE WHEN refers = 1 AND cr IS NULL THEN 'calculation_ref_not_admitted' END, CASE WHEN kept AND rests THEN 'evidence_slot_mismatch' END, CASE WHEN NOT ((kept AND number = q) OR (rests AND number = declared)) THEN 'numeric_value_not_grounded' END, CASE WHEN number <> q THEN 'prose_number_unlisted' END) AS reasons FROM v)"""


def frames(s: SparkSession, d: str) -> dict[str, DataFrame]:
    lines = load_table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("n")).agg(
        F.min("l_quantity").cast("long").alias("q"), (F.min("l_tax") < 0.07).alias("ok"), F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls")
    )
    line = F.struct("n", "q", "ls")
    pairs = lines.groupBy("answer").agg(F.min(line).alias("a"), F.max(line).alias("b")).filter("a.n < b.n")
    base, subject = F.col("a.q"), F.col("b.q") + F.when((F.col("a.ls") == "O") & (F.col("b.ls") == "F"), 1).otherwise(0)
    adds = F.col("a.ls") == "O"
    declared = F.when(adds, base + subject).otherwise(subject - base) + F.when(base % 5 == 0, 1).otherwise(0)
    given = K.admission(lines.groupBy("answer").agg(F.collect_list(F.when(F.col("ok"), F.col("n"))).alias("evidence_ids")), lines.groupBy("answer", F.col("rf").alias("slot")).agg(F.collect_list("n").alias("evidence_ids"), F.lit(True).alias("complete")))
    facts = K.admitted_facts(lines.select("answer", F.col("n").alias("fact"), F.array("n").alias("evidence_ids"), F.array(F.col("q").cast("string")).alias("numbers")), given)
    calculations = K.admitted_calculations(
        pairs.select(
            "answer", F.lit("c").alias("calculation"), F.when(F.col("b.q") % 10 == 0, "product").when(adds, "sum").otherwise("difference").alias("operation"), F.array(base.cast("string"), subject.cast("string")).alias("operands"),
            F.when(F.col("b.q") % 7 == 0, "n/a").otherwise(declared.cast("string")).alias("declared"), F.array("a.n", "b.n").alias("evidence_ids"),
        ), facts, given,
    )
    last = lines.groupBy("answer").agg(F.max("n").alias("hi"))
    claims = K.verified_claims(
        lines.join(last, "answer").select(
            "answer", F.col("n").alias("claim"), F.concat(F.lit("sold "), "q").alias("text"), F.array("n").alias("citations"), F.array("rf").alias("slots"), F.array("n").alias("fact_refs"),
            F.array(F.when((F.col("n") == F.col("hi")) & (F.col("q") % 3 == 0), "c")).alias("calculation_refs"), F.array((F.col("q") + F.when(F.col("ls") == "O", 0).otherwise(1)).cast("string")).alias("numbers"),
        ), given, facts, calculations,
    )
    answers = lines.groupBy("answer").agg(F.concat(F.lit("first "), F.min(line)["q"]).alias("text"), F.collect_list("n").alias("citations"))
    return {"facts": facts, "calculations": calculations, "claims": claims, "answers": K.verified_answers(answers, given, claims)}


@query("e12_admitted_facts", f"WITH {_LINES} SELECT answer, n AS fact, CASE WHEN kept THEN rf ELSE '' END AS owners, CASE WHEN NOT ok THEN 'fact_support_not_admitted' WHEN NOT kept THEN 'fact_slot_unowned' END AS reason FROM k")
def facts(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d)["facts"].select("answer", "fact", F.array_join("owners", ",").alias("owners"), "reason")


@query("e12_admitted_calculations", f"WITH {_CALCULATED} SELECT answer, reasons FROM c")
def calculations(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d)["calculations"].select("answer", F.array_join("reasons", ",").alias("reasons"))


@query("e13_verified_claims", f"WITH {_CLAIMED} SELECT answer, n AS claim, reasons FROM w")
def claims(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d)["claims"].select("answer", "claim", F.array_join("reasons", ",").alias("reasons"))


@query("e13_verified_answers", f"""WITH {_CLAIMED}, g AS (SELECT answer, list_sort(list_distinct(flatten(list(list_filter(string_split(reasons, ','), lambda x: x <> ''))))) AS rs, list(number) AS numbers FROM w GROUP BY 1),
  o AS (SELECT answer, NOT bool_and(ok) AS astray, min(q) FILTER (n = lo) AS first FROM k GROUP BY 1)
  SELECT answer, array_to_string(list_concat(rs, list_filter([CASE WHEN astray THEN 'top_level_citations_mismatch' END, CASE WHEN NOT list_contains(numbers, first) THEN 'prose_number_unlisted' END], lambda x: x IS NOT NULL AND NOT list_contains(rs, x))), ',') AS reasons FROM g JOIN o USING (answer)""")
def answers(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d)["answers"].select("answer", F.array_join("reasons", ",").alias("reasons"))
