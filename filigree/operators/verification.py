"""Checks of answers, of evidence, of manifests and of observed calls: reasons as arrays of codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import exact_number, has_injection
from filigree.operators.evaldata import all_failures, blank, empty

# Words of questions that ask for a number, and words that evidence must hold if asked for.
NUMERIC_WORDS = ["얼마", "금액", "몇", "수량", "가격", "증가율", "성장률", "증감률", "비율"]
CLAIM_WORDS = ["승인", "완료", "체결", "해지", "변경"]
NONE = lambda: F.array().cast("array<string>")


def listed(c: Column | str) -> Column:
    return F.coalesce(c, NONE())


def within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


# ---- answers ------------------------------------------------------------------------------


def verify_answers(drafts: DataFrame) -> DataFrame:
    """The reasons against each drafted answer, its citations that are evidence, and whether it stands.

    ``drafts``: question, answer, answerable, citation_ids, numeric_values and reason_codes (arrays of
    string); safe (whether the evidence may answer), evidence (array of struct: evidence_id, text),
    facts (array of struct: value, evidence_ids) and calculation (struct: value, evidence_ids), numbers
    as text, compared exactly at any number of places. Null arrays are empty, a null calculation is none. A number that is no decimal gives
    ``numeric_claim_not_decimal`` beside what the others give.
    """
    c = F.col
    cited, values, evidence_of = listed("citation_ids"), listed("numeric_values"), lambda f: listed(f["evidence_ids"])
    facts = F.coalesce("facts", F.array().cast("array<struct<value:string,evidence_ids:array<string>>>"))
    allowed = listed(F.transform("evidence", lambda e: e["evidence_id"]))
    answerable, safe = F.coalesce("answerable", F.lit(False)), F.coalesce("safe", F.lit(False))
    computed = listed(c("calculation")["evidence_ids"])
    needed = F.when(F.size(computed) > 0, computed).otherwise(F.flatten(F.transform(facts, evidence_of)))
    loose = F.exists(facts, lambda f: (F.size(evidence_of(f)) == 0) | ~within(evidence_of(f), allowed))
    number = exact_number
    result = number(c("calculation")["value"])
    trusted = F.array_compact(F.concat(F.transform(facts, lambda f: number(f["value"])), F.array(result)))
    claimed = F.transform(values, number)
    asks = lambda words: [c("question").contains(w) for w in words]
    in_evidence = lambda w: F.coalesce(F.exists("evidence", lambda e: F.coalesce(e["text"].contains(w), F.lit(False))), F.lit(False))
    lacks = [q & ~in_evidence(w) for w, q in zip(CLAIM_WORDS, asks(CLAIM_WORDS), strict=True)]
    found = all_failures(
        ("unknown_citation", ~within(cited, allowed)),
        ("citation_missing", answerable & (F.size(cited) == 0)),
        ("answer_asserted_without_safe_evidence", answerable & ~safe),
        ("unanswerable_draft", ~answerable),
        ("prompt_injection_detected", has_injection("answer")),
        ("unanswerable_answer_has_citation", ~answerable & (F.size(cited) > 0)),
        ("structured_citation_missing", safe & (F.size(facts) > 0) & (loose | (F.size(cited) == 0) | ~within(needed, cited))),
        ("calculation_citation_missing", ~within(computed, cited)),
        ("numeric_claim_mismatch", F.exists(claimed, lambda v: v != result)),
        ("numeric_claim_not_grounded", F.exists(claimed, lambda v: v.isNotNull() & ~F.coalesce(F.array_contains(trusted, v), F.lit(False))) | ((F.size(values) > 0) & (F.size(trusted) == 0))),
        ("numeric_claim_not_decimal", F.exists(claimed, lambda v: v.isNull())),
        ("required_claim_term_missing", safe & reduce(lambda a, b: a | b, lacks)),
        ("numeric_claim_missing", safe & reduce(lambda a, b: a | b, asks(NUMERIC_WORDS)) & (F.size(values) == 0)),
    )
    return (
        drafts.withColumns({"reasons": F.array_distinct(F.concat(listed("reason_codes"), found)), "citations": F.array_intersect(cited, allowed), "_found": F.size(found)})
        .withColumn("verified", c("_found") == 0)
        .drop("_found")
    )


# ---- sufficiency --------------------------------------------------------------------------

TOOLS = ("get_financial_facts", "search_disclosures", "build_summary_context", "analyze_disclosure_trend", "get_correction_lineage")
FACT_FIELDS = ("value_numeric", "unit", "period", "scope", "evidence_ids")


def sufficiency(requests: DataFrame) -> DataFrame:
    """Whether each tool's evidence is enough: struct(status, reasons, missing, action, allowed).

    ``requests``: tool; requested and covered (structs of text: company, filing_id, account, start_date,
    end_date; a covered company, filing or account is an array of admitted values); filing_ids,
    evidence_ids and item_quality (arrays of string); correction_status, dense_status, warnings;
    context; facts (array of struct: support_level, validation_status, value_numeric, unit, period,
    scope as text, evidence_ids), requirements (their number), requirement_coverage (array of boolean);
    account_status; total_count, coverage_complete; original_filing, current_filing,
    lineage_confidence. Null is absent, and context alone tells null (not asked for) from empty.
    """
    c, lit = F.col, F.lit
    asked, got = c("requested"), c("covered")
    financial, searching = c("tool") == TOOLS[0], c("tool").isin(*TOOLS[1:3])
    trend, correction = c("tool") == TOOLS[3], c("tool") == TOOLS[4]
    no_items, uncited, no_filings = empty(c("item_quality")), empty(c("evidence_ids")), empty(c("filing_ids"))

    scope = [("filing_ids", no_filings & ~financial)]
    scope += [(f"scope_mismatch:{n}", ~blank(asked[n]) & ~F.coalesce(F.array_contains(got[n], asked[n]), lit(False))) for n in ("company", "filing_id", "account")]
    scope += [("scope_mismatch:start_date", ~blank(asked["start_date"]) & ~blank(got["start_date"]) & (got["start_date"] < asked["start_date"]))]
    scope += [("scope_mismatch:end_date", ~blank(asked["end_date"]) & ~blank(got["end_date"]) & (got["end_date"] > asked["end_date"]))]
    unknown = all_failures(
        ("evidence_quality_not_fully_known", F.exists("item_quality", lambda q: blank(q) | (q == "unknown"))),
        ("correction_policy_status_not_fully_known", F.coalesce(c("correction_status"), lit("unknown")).isin("unknown", "uncertain")),
    )

    absent = lambda f, n: F.coalesce(F.size(f[n]) <= 0, lit(True)) if n == "evidence_ids" else blank(f[n])
    invalid = lambda f: (F.coalesce(f["support_level"], lit("")) != "structured") | (F.coalesce(f["validation_status"], lit("")) != "validated")
    n_asked, coverage = F.coalesce("requirements", lit(0)), F.coalesce("requirement_coverage", F.array().cast("array<boolean>"))
    uncovered = F.filter(
        F.when(n_asked > 0, F.transform(F.sequence(lit(0), F.greatest(n_asked, lit(1)) - 1), lambda i: F.when(~F.coalesce(F.get(coverage, i), lit(False)), F.concat(lit("financial_comparison_requirement:"), i.cast("string"))))).otherwise(NONE()),
        lambda x: x.isNotNull(),
    )
    per_fact = F.flatten(F.transform(F.coalesce("facts", F.array().cast(requests.schema["facts"].dataType)), lambda f: all_failures(
        ("structured_validated_status", invalid(f)), *[(f"financial_fact:{n}", absent(f, n)) for n in FACT_FIELDS]
    )))
    own = (
        F.when(financial, F.concat(
            all_failures(("validated_structured_financial_fact", empty(c("facts")))), per_fact,
            all_failures(("financial_comparison_requirement_coverage", (n_asked > 0) & (F.size(coverage) != n_asked))), uncovered,
            all_failures(("citable_evidence", uncited), ("evidence_items", no_items)),
        ))
        .when(searching, all_failures(("search_results", no_items), ("citable_evidence", uncited), ("summary_context_text", c("context") == "")))
        .when(trend, all_failures(("filing_count", F.coalesce("total_count", lit(0)) <= 0), ("representative_filings", no_filings), ("representative_evidence", uncited)))
        .when(correction, all_failures(("original_filing", blank(c("original_filing"))), ("current_filing", blank(c("current_filing"))), ("citable_evidence", uncited)))
        .otherwise(NONE())
    )
    held = requests.withColumns({"_missing": F.array_distinct(F.concat(all_failures(*scope), own)), "_unknown": unknown})

    texts = lambda *xs: F.array(*[lit(x) for x in xs]) if xs else NONE()
    verdict = lambda status, reasons, missing, action, allowed: F.struct(
        lit(status).alias("status"), reasons.alias("reasons"), missing.alias("missing"), lit(action).alias("action"), lit(allowed).alias("allowed")
    )
    missing, doubts = c("_missing"), c("_unknown")
    lacking = F.size(missing) > 0
    unclear = F.coalesce(c("account_status") == "ambiguous", lit(False)) | F.array_contains(missing, "scope_mismatch:company")
    smoke = F.coalesce(c("dense_status").contains("smoke_only"), lit(False)) | F.coalesce(F.array_contains("warnings", "dense_smoke_only"), lit(False))
    unsure = (F.coalesce("lineage_confidence", lit("none")) != "high") | (F.coalesce("correction_status", lit("")) != "resolved")
    unproved, of_facts = F.concat(doubts, texts("no_citable_filtered_result")), F.concat(doubts, texts("financial_fact_contract_not_met"))
    chain = texts("correction_lineage_uncertain"), F.when(lacking, missing).otherwise(texts("resolved_lineage"))
    return held.withColumn("verdict", (
        F.when(financial & lacking & unclear, verdict("insufficient", of_facts, missing, "ask_clarification", False))
        .when(financial & lacking, verdict("insufficient", of_facts, missing, "abstain", False))
        .when(financial, verdict("sufficient", texts("validated_structured_fact_with_evidence"), NONE(), "answer", True))
        .when(searching & lacking, verdict("insufficient", unproved, missing, "abstain", False))
        .when(searching & (smoke | (F.size(doubts) > 0)), verdict("partial", F.concat(doubts, texts("filtered_evidence_available_with_warning")), NONE(), "answer_with_warning", True))
        .when(searching, verdict("sufficient", texts("filtered_citable_results_available"), NONE(), "answer", True))
        .when(trend & lacking, verdict("insufficient", texts("trend_has_no_verifiable_filings"), missing, "abstain", False))
        .when(trend & ~F.coalesce("coverage_complete", lit(False)), verdict("partial", texts("trend_source_covers_only_part_of_requested_period"), texts("complete_requested_period"), "answer_with_warning", True))
        .when(trend, verdict("sufficient", texts("trend_counts_trace_to_filings"), NONE(), "answer", True))
        .when(correction & unsure & ~no_filings & ~uncited, verdict("partial", *chain, "answer_with_warning", True))
        .when(correction & unsure, verdict("insufficient", *chain, "abstain", False))
        .when(correction & lacking, verdict("insufficient", texts("correction_chain_incomplete"), missing, "abstain", False))
        .when(correction, verdict("sufficient", texts("resolved_correction_chain"), NONE(), "answer", True))
        .otherwise(verdict("insufficient", texts("unknown_tool_contract"), texts("known_tool"), "abstain", False))
    )).drop("_missing", "_unknown")


# ---- manifests and observed calls ---------------------------------------------------------


def suite_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash of all rows as a multiset, eight sums of 32-bit words of their SHA-256 modulo 2^32.

    Partial sums combine before the shuffle and the order of rows does not count.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]).cast("binary"), 256)
    word = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    sums = rows.agg(*[F.coalesce(F.sum(word(k)), F.lit(0)).alias(f"w{k}") for k in range(8)])
    return sums.select(F.concat(*[F.lpad(F.lower(F.hex((F.col(f"w{k}") % (1 << 32)).cast("long"))), 8, "0") for k in range(8)]).alias("digest"))


def manifest_problems(cases: DataFrame, declared: DataFrame, key: str, groups: list[str], count: str = "n") -> DataFrame:
    """What differs between a manifest's cases and its declared counts per group: a row per problem.

    ``case_id_missing`` and ``case_id_repeated`` name the case; ``count_differs`` the group, with both
    counts. A group on one side only counts 0 on the other; null groups are groups.
    """
    none = {g: F.lit(None).cast(cases.schema[g].dataType).alias(g) for g in groups}
    blank_id = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    ids = cases.groupBy(key).agg(F.count("*").alias("actual")).filter(blank_id | (F.col("actual") > 1)).select(
        F.when(blank_id, "case_id_missing").otherwise("case_id_repeated").alias("problem"), F.col(key).cast("string").alias("case_id"), *none.values(), F.lit(1).cast("long").alias("declared"), "actual"
    )
    sides = cases.select(*groups, F.lit(0).cast("long").alias("declared"), F.lit(1).cast("long").alias("actual")).unionByName(
        declared.select(*groups, F.col(count).cast("long").alias("declared"), F.lit(0).cast("long").alias("actual"))
    )
    counts = sides.groupBy(*groups).agg(F.sum("declared").alias("declared"), F.sum("actual").alias("actual")).filter("declared <> actual")
    return ids.unionByName(counts.select(F.lit("count_differs").alias("problem"), F.lit(None).cast("string").alias("case_id"), *groups, "declared", "actual"))


def reconcile_calls(results: DataFrame, observations: DataFrame, lane: str) -> DataFrame:
    """Results of the lane get their observed calls; one whose rows or calls are not as many as its probes fails.

    ``results``: case_id, lane, probe_count, passed, failure_category, failure_codes. ``observations``:
    case_id, lane, latency_ms, called. Only finite latencies of 0 or more count. A category given
    before stays; other lanes stay as they are.
    """
    latency = F.col("latency_ms")
    valid = (F.col("lane") == lane) & latency.isNotNull() & ~F.isnan(latency.cast("double")) & (latency >= 0) & (latency.cast("double") < float("inf"))
    seen = observations.filter(valid).groupBy("case_id").agg(F.count("*").alias("_rows"), F.count_if(F.coalesce("called", F.lit(False))).alias("_calls"))
    mine, rows, calls = F.coalesce(F.col("lane") == lane, F.lit(False)), F.coalesce("_rows", F.lit(0)), F.coalesce("_calls", F.lit(0))
    wrong = mine & F.coalesce((rows != F.col("probe_count")) | (calls != F.col("probe_count")), F.lit(True))
    code = "provider_generation_not_observed"
    return results.join(seen, "case_id", "left").withColumns({
        "call_count": F.when(mine, calls),
        "passed": F.when(wrong, False).otherwise(F.col("passed")),
        "failure_category": F.when(wrong & blank(F.col("failure_category")), "runtime").otherwise(F.col("failure_category")),
        "failure_codes": F.when(wrong, F.array_union(listed("failure_codes"), F.array(F.lit(code)))).otherwise(F.col("failure_codes")),
    }).drop("_rows", "_calls")
