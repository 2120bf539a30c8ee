"""Statement extraction and audit forms on small inputs."""

from decimal import Decimal

from pyspark.sql import functions as F

from filigree.functions import text
from filigree.operators import extraction as X


def test_labels_and_numbers(spark):
    rows = spark.createDataFrame([("Ⅰ. 매출액 (주 3)", "(△5)"), ("1. 영업 이익", "+7"), ("자산총계[주석 1]", "(-3)"), ("IV 기타", "1 234")], "l string, n string")
    got = rows.select(text.account_label(F.col("l")).alias("l"), text.numeric_value(F.col("n")).alias("n")).collect()
    assert [r["l"] for r in got] == ["매출액", "영업이익", "자산총계", "기타"] and [r["n"] for r in got] == [-5, 7, -3, 1234]


def test_statements_to_facts(spark):
    tables = spark.createDataFrame(
        [
            ("t1", "f1", "success", ["III", "2. 연결재무제표"], "연결 손익계산서", "(단위 : 백 만원)"), ("t2", "f1", "success", ["4. 재무제표"], "손익계산서", "원"),
            ("t3", "f1", "failed", ["2. 연결재무제표"], "재무상태표", "원"), ("t4", "f1", "success", ["2. 연결재무제표"], "주석", "원"), ("t5", "f1", "success", [], "재무상태표", "원"),
            ("t6", "f1", "success", ["2. 연결재무제표"], "포괄손익계산서", "백만원"), ("t7", "f2", "success", ["4. 재무제표"], "재무상태표", "천원"),
        ],
        "table_id string, filing_id string, parse_status string, section_path array<string>, caption string, unit_text string",
    )
    kept = X.classify_statements(tables)
    got = {r["table_id"]: (r["scope"], r["statement_type"], r["statement_priority"], r["scale"]) for r in kept.collect()}
    assert got == {"t1": ("consolidated", "IS", 0, 10**6), "t2": ("separate", "IS", 0, 1), "t6": ("consolidated", "CIS", 1, 10**6), "t7": ("separate", "BS", 0, 1000)}
    cells = [(t, r, c, x) for t in ("t1", "t2", "t6") for r, c, x in ((0, 1, "제 12 기"), (0, 2, "제 11 기"), (1, 0, "Ⅰ. 매출액"), (1, 1, "1,000"), (1, 2, "(900)"), (2, 0, "기타"), (2, 1, "5"))]
    cells += [("t7", 0, 1, "2023년"), ("t7", 1, 0, "자산총계"), ("t7", 1, 1, "10"), ("t7", 2, 0, "자산총계"), ("t7", 2, 1, "11")]
    cells = spark.createDataFrame([(*c, f"e{k}") for k, c in enumerate(cells)], "table_id string, row_index int, column_index int, text string, evidence_id string")
    years = X.year_columns(cells.filter("row_index = 0").withColumn("report_year", F.lit(2023)))
    accounts = spark.createDataFrame([("매출액", "revenue"), ("자산총계", "total_assets")], "label string, account_id string")
    rows = X.resolve_filing(X.candidates(kept, cells, accounts, years)).collect()
    assert sorted((r["filing_id"], r["account_id"], r["fiscal_year"], r["value_numeric"], r["scope"], r["statement_type"], r["reason_code"] or "") for r in rows) == [
        ("f1", "revenue", 2022, Decimal(-900), "consolidated", "IS", ""), ("f1", "revenue", 2023, Decimal(1000), "consolidated", "IS", ""),
        ("f2", "total_assets", 2023, Decimal(10), "separate", "BS", "conflicting_metric_grain"), ("f2", "total_assets", 2023, Decimal(11), "separate", "BS", "conflicting_metric_grain"),
    ]


def test_reconstruction(spark):
    seed = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7), (4, "d", 8)], "id int, unit string, value int")
    again = spark.createDataFrame([(1, "a", 5), (2, "x", 9), (3, None, 7)], "id int, unit string, value int")
    got = {r["id"]: r["reason_code"] for r in X.validate_by_reconstruction(seed, again, "id", ["unit", "value"]).collect()}
    assert got == {1: None, 2: "unit_mismatch", 3: None, 4: "not_reconstructed"}


def test_events(spark):
    facts = spark.createDataFrame([("f1", "t", "p", "1", "원"), ("f1", "t", "p", "2", "원"), ("f2", "t", "p", "3", "원"), ("f2", "t", "p", "3", "원"), ("f3", "t", "other", "3", "원")], "filing_id string, fact_type string, predicate string, value string, unit string")
    allow = spark.createDataFrame([("t", "p", "amount", "numeric")], "fact_type string, predicate string, predicate_id string, answer_kind string")
    assert sorted((r["filing_id"], r["reason_code"] or "") for r in X.allowed_events(facts, allow).collect()) == [("f1", "conflicting_values")] * 2 + [("f2", "")] * 2
    cells = spark.createDataFrame([(1, "5", "원"), (1, "-", "원"), (2, "5", "원"), (2, "6", "원"), (3, "7", "주"), (4, "x", "원")], "fact_id int, text string, unit_text string")
    got = {r["fact_id"]: (r["value"], r["reason_code"]) for r in X.numeric_event_cell(cells).collect()}
    assert got == {1: (5, None), 2: (None, "ambiguous_numeric_cell"), 3: (None, "unit_unclear"), 4: (None, "no_numeric_cell")}


def test_universe(spark):
    companies = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "company string")
    reports = spark.createDataFrame([("a", 1, "2023", "root", 2022), ("a", 2, "2024", "resolved", 2023), ("b", 3, "2024", "unresolved", 2023), ("c", 4, "2024", "root", None)], "company string, filing_id int, filed_at string, lineage_status string, base_year int")
    got = {r["company"]: (r["filing_id"], r["fiscal_year"], r["reason_code"]) for r in X.universe(companies, reports).collect()}
    assert got == {"a": (2, 2023, None), "b": (None, None, "answer_safe_annual_report_missing"), "c": (None, None, "annual_report_fiscal_year_missing"), "d": (None, None, "answer_safe_annual_report_missing")}


def test_group_splits(spark):
    cases = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "z"]), (3, ["z"]), (4, ["q"]), (5, [])], "case_id long, keys array<string>")
    rows = {r["case_id"]: r for r in X.group_splits(cases, {"dev": 50, "test": 50}).collect()}
    assert [rows[k]["group_id"] for k in range(1, 6)] == [1, 1, 1, 4, 5]
    assert len({rows[k]["split"] for k in (1, 2, 3)}) == 1 and {r["split"] for r in rows.values()} <= {"dev", "test"}


def test_audits(spark):
    facts = spark.createDataFrame([(1, 5, ["a"]), (2, 8, ["a", "b"]), (3, 9, ["a"]), (4, 1, ["z"]), (5, 1, [])], "fact_id int, value int, evidence_ids array<string>")
    cells = spark.createDataFrame([("a", 5), ("b", 3)], "evidence_id string, value int")
    got = {r["fact_id"]: r["reason_code"] for r in X.provenance(facts, cells).collect()}
    assert got == {1: None, 2: None, 3: "fact_not_in_cited_evidence", 4: "fact_without_resolvable_evidence", 5: "fact_without_resolvable_evidence"}
    answers = spark.createDataFrame([(1, "answerable", "1,000"), (2, "answerable", "5"), (3, "answerable", "5")], "question_id int, answerability string, value string")
    reviews = spark.createDataFrame([(1, "answerable", "1000", "supported"), (1, "answerable", "1 000", "supported"), (2, "answerable", "5", "supported"), (2, "answerable", "6", "supported")], "question_id int, answerability string, value string, support_verdict string")
    assert {r["question_id"]: r["passes"] for r in X.review_agreement(answers, reviews).collect()} == {1: True, 2: False, 3: False}
    claims = spark.createDataFrame([(1, ["a"], ["5"], ["a"], ["5", "6"]), (2, ["b"], ["7"], ["a"], ["5"]), (3, [], [], ["a"], [])], "id int, citations array<string>, numbers array<string>, admitted_citations array<string>, admitted_numbers array<string>")
    assert [r["reasons"] for r in X.claim_checks(claims).orderBy("id").collect()] == [[], ["citations_not_admitted", "numbers_not_admitted"], ["no_citation"]]
    declared = spark.createDataFrame([("x", 2), ("y", 1)], "k string, declared int")
    bad = X.count_mismatches(declared, spark.createDataFrame([("x",), ("x",), ("z",)], "k string"), "k").collect()
    assert sorted((r["k"], r["declared"], r["actual"]) for r in bad) == [("y", 1, 0), ("z", 0, 1)]
