"""E12, E13 on hand-made answers: implicit and incomplete slots, calculations done again, every reason of claims and answers."""

from filigree.operators import claims as K

FACT = "answer int, fact string, evidence_ids array<string>, numbers array<string>"
CALC = "answer int, calculation string, operation string, operands array<string>, declared string, evidence_ids array<string>"
CLAIM = "answer int, claim string, text string, citations array<string>, slots array<string>, fact_refs array<string>, calculation_refs array<string>, numbers array<string>"
SLOT = "answer int, slot string, evidence_ids array<string>, complete boolean"


def parts(spark, slots=()):
    admitted = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"]), (3, None)], "answer int, evidence_ids array<string>")
    rows = [(1, "x", ["a", "b"], None), (1, "y", ["c"], False), (1, "z", ["c", "q"], True), (1, "e", [], True), (3, "x", ["a"], True), *slots]
    given = K.admission(admitted, spark.createDataFrame(rows, SLOT))
    facts = [(1, "f1", ["a"], ["10"]), (1, "f2", ["b", "b"], ["2.50", "x"]), (1, "f3", ["c"], ["7"]), (1, "f4", ["q"], ["7"]), (1, "f5", None, ["1"]), (2, "g", ["d"], ["4"]), (3, "h", ["a"], []), (9, "i", ["a"], None)]
    facts = K.admitted_facts(spark.createDataFrame(facts, FACT), given)
    calcs = [
        (1, "sum", "sum", ["10", "2.5"], "12.5", ["a", "b"]), (1, "growth", "growth_rate", ["2.5", "10.0"], "300", ["b", "a"]), (1, "off", "difference", ["10", "2.5"], "7.5", ["a", "b"]),
        (1, "bad", "ratio", ["10"], "1", ["a"]), (1, "nan", "sum", ["10", "x"], "1", ["a"]), (1, "none", "sum", None, "0", None), (1, "far", "lookup", ["7"], "7", ["c"]), (2, "own", "lookup", ["4"], "4.0", ["d"]),
    ]
    return given, facts, K.admitted_calculations(spark.createDataFrame(calcs, CALC), facts, given)


def test_admission(spark):
    given, facts, calcs = parts(spark)
    got = {r["answer"]: [(x["slot"], x["ids"]) for x in r["slots"]] for r in given.collect()}
    assert got == {1: [("x", ["a", "b"])], 2: [("tool_evidence", ["d"])], 3: []}
    assert {r["fact"]: (r["owners"], r["reason"]) for r in facts.collect()} == {
        "f1": (["x"], None), "f2": (["x"], None), "f3": ([], "fact_slot_unowned"), "f4": ([], "fact_support_not_admitted"), "f5": ([], "fact_slot_unowned"),
        "g": (["tool_evidence"], None), "h": ([], "fact_support_not_admitted"), "i": ([], "fact_support_not_admitted"),
    }
    support, operand, unowned = "calculation_support_not_admitted", "calculation_operand_evidence_missing", "calculation_slot_unowned"
    assert {r["calculation"]: r["reasons"] for r in calcs.collect()} == {
        "sum": [], "growth": [], "off": ["calculation_result_mismatch"], "bad": ["calculation_operation_invalid"], "nan": ["calculation_numeric_invalid"],
        "none": [support, "calculation_numeric_invalid", unowned], "far": [operand, unowned], "own": [],
    }


def test_claims_and_answers(spark):
    given, facts, calcs = parts(spark)
    rows = [
        (1, "good", "grew 12.5 to 10", ["a", "b"], ["x"], ["f1"], ["sum"], ["12.50", "10"]), (1, "cites", "", ["q"], ["x"], None, None, None), (1, "slot", "", ["a"], ["y"], None, None, None),
        (1, "fact", "", ["a"], ["x"], ["f1", "f3"], None, None), (1, "calc", "", ["a", "b"], ["x"], None, ["off", "gone"], None), (1, "thin", "", ["a"], ["x"], ["f2"], None, None),
        (1, "nan", "is NaN", ["a"], ["x"], None, None, ["x"]), (1, "free", "about 11", ["a"], ["x"], ["f1"], None, ["10", "9"]), (1, "empty", None, None, None, None, None, None), (2, "own", "4", ["d"], ["tool_evidence"], ["g"], ["own"], ["4"]),
    ]
    claims = K.verified_claims(spark.createDataFrame(rows, CLAIM), given, facts, calcs)
    mismatch = "evidence_slot_mismatch"
    assert {r["claim"]: r["reasons"] for r in claims.collect()} == {
        "good": [], "cites": ["claim_citation_not_admitted", mismatch], "slot": [mismatch], "fact": ["fact_ref_not_admitted"], "calc": ["calculation_result_mismatch", "calculation_ref_not_admitted"], "thin": [mismatch],
        "nan": ["numeric_value_not_finite"], "free": ["numeric_value_not_grounded", "prose_number_unlisted"], "empty": ["claim_citation_not_admitted"], "own": [],
    }
    answers = [(2, "4", ["d"]), (1, "12.5 and 8", ["a"]), (3, None, None), (7, "", ["a"])]
    two = claims.filter("claim in ('good', 'own')")
    got = K.verified_answers(spark.createDataFrame(answers, "answer int, text string, citations array<string>"), given, two.unionByName(two.filter("claim = 'good'")))
    assert {r["answer"]: r["reasons"] for r in got.collect()} == {
        2: [], 1: ["claim_id_duplicate", "top_level_citations_mismatch", "prose_number_unlisted"], 3: ["claim_missing", "top_level_citations_mismatch"], 7: ["claim_missing", "top_level_citations_mismatch"],
    }
    assert K.verified_answers(got.select("answer").limit(0).selectExpr("answer", "'' AS text", "array('') AS citations"), given, two).count() == 0
