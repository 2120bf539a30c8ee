"""Evaluation-data operators and resumable sinks on hand-made rows, nulls and empty inputs."""

import pytest
from pyspark.sql import functions as F

from filigree.operators import evaldata as V
from filigree.sources import tables

SLOT = "struct<domain:string,serving_path:string,target_evidence_ids:array<string>,filing_ids:array<string>,fact_ids:array<string>,fragment_type:string,character_count:int,marker_count:int>"
RECORD = f"lineage_status string, target_evidence_ids array<string>, filing_ids array<string>, issuer_name string, issuer_corp_code string, parse_status string, source_sha256 string, answerability string, slots array<{SLOT}>"
TEXT = ("text", "search_document", ["e1"], ["f1"], None, "paragraph", 100, 1)
FACT = ("financial", "financial_fact_evidence", ["e2"], ["f1"], ["x"], None, None, None)
GOOD = {"lineage_status": "root", "target_evidence_ids": ["e2", "e1"], "filing_ids": ["f1"], "issuer_name": "n", "issuer_corp_code": "c", "parse_status": "success", "source_sha256": "0" * 64, "answerability": "proved", "slots": [TEXT, FACT]}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None), ({"lineage_status": None}, "unresolved_lineage"), ({"lineage_status": "missing_original"}, "unresolved_lineage"), ({"target_evidence_ids": None}, "missing_evidence"),
        ({"target_evidence_ids": []}, "missing_evidence"), ({"filing_ids": None}, "missing_filing"), ({"issuer_name": ""}, "ambiguous_issuer"), ({"issuer_corp_code": None}, "ambiguous_issuer"),
        ({"parse_status": None}, "unsafe_source_parse"), ({"source_sha256": "0"}, "invalid_source_hash"), ({"source_sha256": None}, "invalid_source_hash"), ({"answerability": None}, "answerability_not_proved"),
        ({"slots": []}, "slot_targets_invalid"), ({"slots": None}, "slot_targets_invalid"), ({"slots": [TEXT]}, "slot_target_evidence_mismatch"),
        ({"filing_ids": ["f2"]}, "slot_target_filing_mismatch"), ({"slots": [("text", "other", *TEXT[2:]), FACT]}, "serving_path_invalid"), ({"slots": [(None, "other", *TEXT[2:]), FACT]}, "serving_path_invalid"),
        ({"slots": [(*TEXT[:6], 79, 1), FACT]}, "text_target_not_answer_safe"), ({"slots": [(*TEXT[:5], "heading", 100, 1), FACT]}, "text_target_not_answer_safe"),
        ({"slots": [TEXT, (*FACT[:4], [], *FACT[5:])]}, "slot_fact_ids"),
    ],
)
def test_admission(spark, change, reason):
    record = {**GOOD, **change}
    row = spark.createDataFrame([tuple(record.values())], RECORD).select(V.admission_reason(["success"]).alias("r")).first()
    assert row["r"] == reason


def test_audit(spark):
    records = spark.createDataFrame(
        [(1, ["f"], [("a", "f", "h")]), (2, ["f"], [("b", "f", "h"), ("b", "f", "h")]), (3, ["g"], [("a", "f", "z")]), (4, ["f"], []), (5, None, [("none", "f", "h")])],
        "id int, filing_ids array<string>, evidence array<struct<evidence_id:string,filing_id:string,sha256:string>>",
    )
    evidence = spark.createDataFrame(
        [("a", "f", "h", "success", None, "xml", "root"), ("b", "f", "h", None, "partial", "pdf", None)],
        "evidence_id string, filing_id string, sha256 string, parse_status string, table_parse_status string, format string, lineage_status string",
    )
    found = {r["id"]: r["reasons"] for r in V.audit_candidates(records, evidence, "id").collect()}
    assert found == {
        1: [], 2: ["duplicate_candidate", "lineage_not_answer_safe", "source_parse_failed", "table_parse_failed", "visual_evidence_blocked"],
        3: ["citation_mismatch", "cross_filing_evidence"], 4: [], 5: ["evidence_not_found"],
    }


def test_recomputed(spark):
    rows = spark.createDataFrame([("sum", 1, 2, 3), ("ratio", 4, 1, 1), ("ratio", 0, 1, 1), ("x", 1, 1, 1), ("sum", None, 1, 1), (None, 1, 1, 1)], "op string, a int, b int, v int")
    assert [r["reason"] for r in V.recomputed(rows, "op", "a", "b", "v").collect()] == [
        None, "calculation_result_mismatch", "calculation_operation_invalid", "calculation_operation_invalid", "calculation_numeric_invalid", "calculation_operation_invalid",
    ]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_cycled(spark, n):
    pool = spark.range(n).select((F.col("id") * 10).alias("x")).repartition(3)
    got = sorted((r["k"], r["x"]) for r in V.cycled(spark.range(10).withColumnRenamed("id", "k"), pool, "k", "x").collect())
    assert got == ([] if not n else [(k, k % n * 10) for k in range(10)])


def test_exclusions_of_empty_cases(spark):
    cases = spark.createDataFrame([(1, True, 1, []), (2, True, 1, None), (3, None, 1, [9]), (4, True, None, [9]), (5, True, 2, [8]), (6, True, 2, [9])], "id int, plan_ok boolean, query_count int, targets array<int>")
    served = spark.createDataFrame([(9,)], "e int")
    found = {r["id"]: r["reason"] for r in V.exclusion_reasons(cases, served, "id", "e").collect()}
    assert found == {1: None, 2: None, 3: "invalid_plan", 4: "no_query_executed", 5: "target_not_serving_admitted", 6: None}


def test_resumable_sinks(spark, tmp_path):
    rows = spark.range(20).select("id", (F.col("id") % 3).alias("p"))
    path = str(tmp_path / "parts")
    tables.write_partitions(rows, path, "p")
    tables.write_partitions(rows.filter("p = 1"), path, "p")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))
    path = str(tmp_path / "vectors")
    done = tables.append_missing(rows.filter("id < 12"), path, "id")
    assert tables.append_missing(rows.union(rows), path, "id", done).count() == 20
    assert tables.append_missing(rows, path, "id", spark.read.parquet(path)).count() == 20
