"""Exact calculation, comparison along axes, schemas, exact numbers, correction pairs and labelled dates."""

import json
import re
from decimal import ROUND_HALF_UP, Decimal, localcontext
from itertools import product

import pytest
from pyspark.sql import functions as F

from filigree.functions import text
from filigree.operators import calculation as C
from filigree.operators import evaldata, schemas
from filigree.sources import markup


def test_calculation_is_exact(spark):
    values = ["0.01", "3", "-7", "99999999999999999999.99", "0.000001", "123456789012345678.123456", "0"]
    rows = list(product(values, values))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", *[C.calculate(o, F.col("a"), F.col("b")).alias(o) for o in C.OPERATIONS], C.calculate("lookup", F.col("b")).alias("lookup"), C.calculate("sum", F.col("a"), F.col("b"), F.col("a")).alias("three")).collect()
    for r in got:
        a, b = Decimal(r["a"]), Decimal(r["b"])
        with localcontext() as context:
            context.prec = 90
            want = {"sum": a + b, "difference": b - a, "lookup": b, "three": a + b + a}
            if a:
                want |= {"ratio": b / a, "percentage_ratio": b / a * 100, "growth_rate": (b - a) / a * 100}
            for name in (*C.OPERATIONS, "lookup", "three"):
                if name not in want:
                    assert (r[name]["value"], r[name]["reason"]) == (None, "zero_base")
                    continue
                exact = want[name].quantize(Decimal("0.000001"), ROUND_HALF_UP)
                assert (r[name]["value"], r[name]["reason"]) == ((None, "out_of_range") if abs(exact) >= 10**32 else (exact, None)), (name, a, b)


def test_calculation_reasons(spark):
    row = spark.sql("select 'x' a, '1' b, cast(null as string) c, '0.00000001' d")
    c = F.col
    got = row.select(C.calculate("sum", c("a"), c("b")).alias("p"), C.calculate("ratio", c("c"), c("b")).alias("q"), C.calculate("lookup", c("d")).alias("r")).first()
    assert [got[k]["reason"] for k in "pqr"] == ["not_exact", "missing_operand", "not_exact"]
    for name, args in (("lookup", 2), ("ratio", 1), ("difference", 3), ("sum", 0), ("product", 2)):
        with pytest.raises(ValueError):
            C.calculate(name, *[c("a")] * args)


AXES = ["company", "period", "metric", "scope", "unit"]


def test_compare_axes(spark):
    rows = [
        ("a", "2023", "sales", "all", "won", 5), ("b", "2023", "sales", "all", "won", 7), ("c", "2023", "sales", "all", "won", 7),
        ("a", "2024", "sales", "all", "won", 9), ("a", "2024", "sales", "all", "won", 9), ("b", "2024", "sales", "all", "won", 1), ("b", "2024", "sales", "all", "won", 2),
        ("c", "2024", "sales", "all", "usd", None), ("a", "2023", "profit", "all", "won", 1), ("a", "2023", "sales", "own", "won", 8), (None, "2025", "sales", "all", "won", 3),
    ]
    got = C.compare_axes(spark.createDataFrame(rows, ", ".join(f"{a} string" for a in AXES) + ", v int"), AXES, "v", {"company": ["a", "b"]}).collect()
    at = {(r["compared"], *[r[a] for a in AXES]): r for r in got}
    tied = at["company", None, "2023", "sales", "all", "won"]
    assert (tied["members"], tied["tie"], tied["winner"], tied["status"], tied["top_value"]) == (3, True, None, "complete", 7)
    torn = at["company", None, "2024", "sales", "all", "won"]
    assert (torn["members"], torn["ambiguous"], torn["missing"], torn["status"], torn["winner"]) == (1, 1, "b", "incomplete", None)
    years = at["period", "a", None, "sales", "all", "won"]
    assert (years["winner"], years["status"], years["top_value"]) == ("2024", "complete", 9)
    assert at["scope", "a", "2023", "sales", None, "won"]["winner"] == "own" and at["metric", "a", "2023", None, "all", "won"]["winner"] == "sales"
    assert at["company", None, "2025", "sales", "all", "won"]["missing"] == "a,b" and at["period", "", None, "sales", "all", "won"]["status"] == "single"
    empty = at["unit", "c", "2024", "sales", "all", None]
    assert (empty["members"], empty["top_value"], empty["status"], empty["tie"]) == (0, None, "single", False)
    assert C.compare_axes(spark.createDataFrame([], "company string, v int"), ["company"], "v").count() == 0
    with pytest.raises(ValueError):
        C.compare_axes(spark.createDataFrame([], "company string, v int"), ["company"], "v", {"year": ["1"]})


SCHEMA = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": ["integer", "null"], "minimum": 3}, "kind": {"enum": ["x", 1, True, None]}, "name": {"type": "string", "minLength": 2, "pattern": "[a-z가-힣]+"},
        "at": {"oneOf": [{"type": "string", "format": "date"}, {"const": 0}]}, "parts": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number"}}}},
    },
}
RECORDS = [
    '{"id": 5, "kind": "x"}', '{"id": 2, "kind": 1, "name": "A"}', '{"id": null, "kind": null, "name": "ab", "at": "2024-02-29"}', '{"id": true, "kind": true, "at": "2023-02-29"}',
    '{"kind": "y", "more": 1, "also:this": {}, "at": 0}', '{"id": "3", "kind": 2, "parts": []}', '{"id": 4, "kind": "x", "parts": [{"n": 1.5}, {"n": "1"}, {}, 7]}',
    '{"id": 4, "kind": "x", "name": "가나", "parts": [{"n": 1, "m": 2}, {"m": 2, "n": 1}]}', '[1]', '7', 'null', '{', '', None, '{"id": 4.5, "kind": "x", "at": null}', '{"id": 1e1, "kind": false}', '{"id": 3.0, "kind": 1}', '{"id": 123456789012345678901234567890, "kind": 1}',
]


def plainly(v, s, at):
    """The rules said plainly, for the words that SCHEMA uses."""
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    same = lambda a, b: type(a) is type(b) and a == b
    if "const" in s and not same(v, s["const"]):
        return [(at, "const")]
    if "enum" in s and not any(same(v, e) for e in s["enum"]):
        return [(at, "enum")]
    if "oneOf" in s:
        tried = [plainly(v, b, at) for b in s["oneOf"]]
        return [] if [] in tried else [(at, "oneOf"), *sum(tried, [])]
    is_a = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "null": v is None, "integer": number and isinstance(v, int), "number": number}
    if "type" in s and not any(is_a[k] for k in ([s["type"]] if isinstance(s["type"], str) else s["type"])):
        return [(at, "type")]
    out = []
    if isinstance(v, str):
        out += [(at, "minLength")] * (len(v) < s.get("minLength", 0)) + [(at, "pattern")] * ("pattern" in s and not re.fullmatch(s["pattern"], v))
        out += [(at, "date")] * (s.get("format") == "date" and v != "2024-02-29")
    if number and v < s.get("minimum", v):
        out.append((at, "minimum"))
    if isinstance(v, list):
        out += [(at, "minItems")] * (len(v) < s.get("minItems", 0)) + [(at, "uniqueItems")] * (len({json.dumps(x, sort_keys=True) for x in v}) < len(v))
        out += [x for i, e in enumerate(v) for x in plainly(e, s["items"], f"{at}[{i}]")]
    if isinstance(v, dict):
        out += [(f"{at}.{k}", "required") for k in s.get("required", []) if k not in v]
        out += [(f"{at}.{k}", "unknown") for k in v if s.get("additionalProperties") is False and k not in s["properties"]]
        out += [x for k, c in s["properties"].items() if k in v for x in plainly(v[k], c, f"{at}.{k}")]
    return out


def test_schema(spark):
    def want(record):
        try:
            value = json.loads(record or "", parse_float=lambda t: float(t) if "e" in t or float(t) % 1 else int(float(t)))
        except json.JSONDecodeError:
            return [("$", "json")]
        return sorted(plainly(value, SCHEMA, "$"))

    df = spark.createDataFrame(list(enumerate(RECORDS)), "k int, record string")
    got = {}
    for r in schemas.schema_violations(df, "record", json.dumps(SCHEMA)).collect():
        got.setdefault(r["k"], []).append((r["path"], r["rule"]))
    for k, record in enumerate(RECORDS):
        assert sorted(got.get(k, [])) == want(record), record
    for bad in ({"allOf": []}, {"format": "email"}, {"const": [1]}):
        with pytest.raises(ValueError):
            schemas.schema_violations(df, "record", bad)


def test_exact_number(spark):
    same = [["1", "1.0", "01", "+1", "1e0", "10E-1", " 1 ", "1."], ["-0.5", "-.50", "-5e-1"], ["0", "-0", "0.000", "0e9"], ["1" + "0" * 60, "1e60"], ["0." + "0" * 50 + "1", "1e-51"], ["1.000000001"], ["1.0000000010000000001"]]
    bad = ["", ".", "1,000", "e5", "1e", "0x1", "nan", None]
    rows = [(k, x) for k, xs in enumerate(same) for x in xs]
    got = spark.createDataFrame(rows, "k int, x string").select("k", text.exact_number(F.col("x")).alias("n")).distinct().collect()
    assert sorted(r["k"] for r in got) == list(range(len(same))) and len({r["n"] for r in got}) == len(same) and None not in {r["n"] for r in got}
    assert {r["n"] for r in spark.createDataFrame([(x,) for x in bad], "x string").select(text.exact_number(F.col("x")).alias("n")).collect()} == {None}


def test_labelled_dates_and_units(spark):
    rows = [("최초제출일: 2024년 3월 5일",), ("작성일 2024년 3월 5일",), ("정정관련 공시서류제출일 2023.1.2",), ("최초제출일 미정",), (None,)]
    assert [str(r["d"]) for r in spark.createDataFrame(rows, "t string").select(text.submission_date(F.col("t")).alias("d")).collect()] == ["2024-03-05", "None", "2023-01-02", "None", "None"]
    blocks = [
        (1, 0, "note", None, None, "(단위 : 천원)"), (1, 1, "note", None, None, "단위: 2024.01.02"), (1, 2, "table", 0, "기준", ""), (1, 3, "table", 1, "백만원", ""),
        (2, 0, "note", None, None, "단위 : 현재"), (2, 1, "table", 0, None, ""),
    ]
    df = spark.createDataFrame(blocks, "page_id int, sequence_no int, kind string, table_no int, declared_unit string, text string")
    assert {(r["page_id"], r["table_no"]): r["unit"] for r in markup.unit_and_caption(df).collect()} == {(1, 0): "천원", (1, 1): "백만원", (2, 0): None}


def test_correction_pairs(spark):
    slots = [(["e1"], ["f1"]), (["e2"], ["f2"])]
    right = ("ev", "f1", "f2", "e1", "e2", False, True)
    cases = [
        (["correction_materiality"], right, None), (["correction_materiality"], None, "correction_pair_required"), (["other"], None, None), (None, None, None),
        *[(["correction_materiality"], (*right[:k], v, *right[k + 1 :]), "correction_pair_invalid") for k, v in ((0, ""), (0, None), (1, "f2"), (1, None), (2, "f3"), (3, "e9"), (4, None), (5, True), (5, None), (6, False), (6, None))],
    ]
    pair = "struct<event_id:string,original_filing_id:string,current_filing_id:string,original_evidence_id:string,current_evidence_id:string,original_is_current:boolean,current_is_current:boolean>"
    df = spark.createDataFrame([(k, d, p, slots) for k, (d, p, _) in enumerate(cases)], f"k int, supported_dimensions array<string>, version_pair {pair}, slots array<struct<target_evidence_ids:array<string>,filing_ids:array<string>>>")
    got = {r["k"]: r["reason"] for r in df.select("k", evaldata.correction_pair_failure().alias("reason")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, _, want in cases]
