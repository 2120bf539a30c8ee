"""Generation and audit of evaluation data: candidates, admission, exclusion, group ids, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators import calculation as C
from filigree.session import materialize

# The path that serves each domain, and the lineage states that are not safe.
SERVING_PATH = {"text": "search_document", "financial": "financial_fact_evidence", "event": "event_fact_evidence"}
UNSAFE_LINEAGE = ["unresolved", "missing_original"]
SAFE_LINEAGE = ["root", "resolved"]


def first_failure(*checks: tuple[str, Column]) -> Column:
    """The reason of the first check whose condition holds (null counts as not), else null."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for reason, condition in checks], F.lit(None).cast("string"))


def all_failures(*checks: tuple[str, Column]) -> Column:
    """The reasons of all checks whose conditions hold, in their order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(reason)) for reason, condition in checks]))


def empty(array: Column) -> Column:
    return F.coalesce(F.size(array) <= 0, F.lit(True))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


# ---- candidates ---------------------------------------------------------------------------


def evidence_links(facts: DataFrame, evidence: DataFrame, key: str, fact: str) -> DataFrame:
    """Per known evidence id the facts that rest on it, in order."""
    return facts.join(evidence.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(fact)).alias("facts"))


def slot_candidates(evidence: DataFrame, slots: dict[str, list[str]], text: str) -> DataFrame:
    """D3: a row per slot and evidence row that holds one of the slot's terms.

    Slots are configuration, so their terms stand in the plan and the evidence is read once,
    without a join.
    """
    hit = {name: reduce(lambda a, b: a | b, [F.col(text).contains(t) for t in terms]) for name, terms in slots.items()}
    return evidence.withColumn("slot", F.explode(all_failures(*hit.items())))


def safe_text_target(kind: Column, text: Column, allowed: list[str], markers: list[str], injected: Column, least: int = 80) -> Column:
    """Text of an allowed kind, long enough, with a marker and without instructions to a model."""
    marked = reduce(lambda a, b: a | b, [text.contains(m) for m in markers])
    return F.coalesce(kind.isin(allowed) & (F.length(text) >= least) & marked & ~injected, F.lit(False))


def event_reports(items: DataFrame, name: str, at: str, patterns: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Items whose name holds a pattern, both reduced to letters and digits, dated within [start, end]."""
    bare = lambda c: F.regexp_replace(c, "[^가-힣A-Za-z0-9]", "")
    found = items.filter(reduce(lambda a, b: a | b, [bare(F.col(name)).contains(bare(F.lit(p))) for p in patterns]))
    return found if start is None else found.filter(F.col(at).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# ---- admission and exclusion --------------------------------------------------------------


def slot_failure(slot: Column, least: int = 80) -> Column:
    """The first thing wrong with one slot: its serving path, its facts, or its text."""
    paths = F.create_map(*[F.lit(x) for pair in SERVING_PATH.items() for x in pair])
    of_facts = slot["domain"].isin("financial", "event")
    unsafe = (slot["fragment_type"] == "heading") | (F.coalesce(slot["character_count"], F.lit(0)) < least) | (F.coalesce(slot["marker_count"], F.lit(0)) < 1)
    return first_failure(
        ("serving_path_invalid", F.coalesce(F.element_at(paths, F.coalesce(slot["domain"], F.lit(""))) != slot["serving_path"], F.lit(True))),
        ("slot_fact_ids", of_facts & empty(slot["fact_ids"])),
        ("text_target_not_answer_safe", (slot["domain"] == "text") & F.coalesce(unsafe, F.lit(False))),
    )


def admission_reason(allowed_parse: list[str]) -> Column:
    """Why a source record is not admitted, the first reason in order; null admits it.

    The record has lineage_status, target_evidence_ids, filing_ids, issuer_name, issuer_corp_code,
    parse_status, source_sha256, answerability and slots (array of struct: domain, serving_path,
    target_evidence_ids, filing_ids, fact_ids, fragment_type, character_count, marker_count).
    """
    c = F.col
    of_slots = lambda field: F.flatten(F.transform("slots", lambda s: F.coalesce(s[field], F.array().cast("array<string>"))))
    same = F.array_sort(F.array_distinct(of_slots("target_evidence_ids"))) == F.array_sort(F.array_distinct("target_evidence_ids"))
    return F.coalesce(
        first_failure(
            ("unresolved_lineage", c("lineage_status").isNull() | c("lineage_status").isin(UNSAFE_LINEAGE)),
            ("missing_evidence", empty(c("target_evidence_ids"))),
            ("missing_filing", empty(c("filing_ids"))),
            ("ambiguous_issuer", blank(c("issuer_name")) | blank(c("issuer_corp_code"))),
            ("unsafe_source_parse", ~F.coalesce(c("parse_status").isin(allowed_parse), F.lit(False))),
            ("invalid_source_hash", F.coalesce(F.length("source_sha256") != 64, F.lit(True))),
            ("answerability_not_proved", F.coalesce(c("answerability") != "proved", F.lit(True))),
            ("slot_targets_invalid", empty(c("slots"))),
        ),
        F.get(F.array_compact(F.transform("slots", lambda s: slot_failure(s))), F.lit(0)),
        first_failure(
            ("slot_target_evidence_mismatch", ~same),
            ("slot_target_filing_mismatch", F.size(F.array_except(of_slots("filing_ids"), c("filing_ids"))) > 0),
        ),
    )


def correction_pair_failure() -> Column:
    """Why the version pair of a record about a correction is not admitted; null for other records and for a right pair.

    The record has supported_dimensions (array of string), version_pair (struct: event_id, original_filing_id,
    current_filing_id, original_evidence_id, current_evidence_id, original_is_current, current_is_current) and slots
    as in ``admission_reason``. A pair must name its event and two different filings that slots admit, and evidence
    that slots admit; the original must be known to be superseded, the current one to be current.
    """
    pair = F.col("version_pair")
    admitted = lambda field: F.flatten(F.transform("slots", lambda s: F.coalesce(s[field], F.array().cast("array<string>"))))
    inside = lambda field, *names: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(admitted(field), pair[n]), F.lit(False)) for n in names])
    right = (
        ~blank(pair["event_id"]) & ~blank(pair["original_filing_id"]) & (pair["original_filing_id"] != pair["current_filing_id"])
        & inside("filing_ids", "original_filing_id", "current_filing_id") & inside("target_evidence_ids", "original_evidence_id", "current_evidence_id")
        & ~pair["original_is_current"] & pair["current_is_current"]
    )
    failure = first_failure(("correction_pair_required", pair.isNull()), ("correction_pair_invalid", ~F.coalesce(right, F.lit(False))))
    return F.when(F.array_contains("supported_dimensions", "correction_materiality"), failure)


def exclusion_reasons(cases: DataFrame, served: DataFrame, key: str, evidence: str) -> DataFrame:
    """Why a case leaves the denominator: an invalid plan, no query, or a target that is not served.

    ``cases`` has plan_ok, query_count and ``targets`` (array of ``evidence`` ids).
    """
    lacking = cases.select(key, F.explode("targets").alias(evidence)).join(served.select(evidence), evidence, "left_anti").select(key).distinct()
    return cases.join(lacking.withColumn("_lacking", F.lit(True)), key, "left").select(
        key,
        first_failure(
            ("invalid_plan", ~F.coalesce("plan_ok", F.lit(False))),
            ("no_query_executed", F.coalesce("query_count", F.lit(0)) <= 0),
            ("target_not_serving_admitted", F.col("_lacking")),
        ).alias("reason"),
    )


def seed_gates(seed: DataFrame, evidence: DataFrame, key: str, grain: list[str], values: list[str], link: str) -> DataFrame:
    """The reasons against each seed fact: repeated id, conflicting grain, unknown evidence, not validated.

    Counts per id and per grain are aggregates joined back, so a hot grain is combined map-side.
    """
    ids = seed.groupBy(key).agg(F.count("*").alias("_copies"))
    grains = seed.groupBy(*grain).agg(F.count_distinct(F.struct(*values)).alias("_values"))
    known = evidence.select(link).distinct().withColumn("_known", F.lit(True))
    return (
        seed.join(ids, key, "left").join(grains, grain, "left").join(known, link, "left")
        .withColumn("reasons", all_failures(
            ("duplicate_fact_id", F.col("_copies") > 1), ("conflicting_grain", F.col("_values") > 1),
            ("evidence_missing", F.col("_known").isNull()), ("not_validated", F.coalesce(F.col("validation_status") != "validated", F.lit(True))),
        ))
        .drop("_copies", "_values", "_known")
    )


# ---- group ids and summaries --------------------------------------------------------------


def group_ids(rows: DataFrame, issuer: str, documents: str, ordinal: str, variants: int) -> DataFrame:
    """Issuer and document groups as hashes, and the template variant of the ordinal."""
    digest = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 24)
    return rows.withColumns({
        "issuer_group_id": F.concat(F.lit("issuer-"), digest(F.concat(F.lit("issuer:"), F.coalesce(issuer, F.lit(""))))),
        "document_group_id": F.concat(F.lit("document-"), digest(F.to_json(documents))),
        "variant": F.pmod(F.col(ordinal), F.lit(variants)).cast("int"),
    })


def case_summary(observations: DataFrame, case: str, flags: list[str]) -> DataFrame:
    """Per case the number of observations and the share for which each flag holds; null is a miss."""
    share = [F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")), 6).alias(f) for f in flags]
    return observations.groupBy(case).agg(F.count("*").alias("observations"), *share)


def cycled(cases: DataFrame, pool: DataFrame, case: str, order: str) -> DataFrame:
    """Case n takes the pool's row n modulo its size, in order.

    The pool is cut in ranges of the order and numbered within each; only one count per range is
    collected.
    """
    ranged = materialize(pool.repartitionByRange(order).sortWithinPartitions(order).select("*", F.monotonically_increasing_id().alias("_at")), "cycled")
    within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(within[0].alias("_range")).agg(F.count("*").alias("n")).orderBy("_range").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["_range"]], total = total, total + r["n"]
    if not total:
        return cases.join(pool, F.lit(False))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), within[0])
    return cases.withColumn("_place", F.pmod(F.col(case), F.lit(total))).join(ranged.withColumn("_place", offset + within[1]).drop("_at"), "_place").drop("_place")


# ---- audit --------------------------------------------------------------------------------


def hydrate(ids: DataFrame, grains: dict[str, DataFrame], most: int) -> DataFrame:
    """Each id with its text from any of the grains, cut at ``most`` characters; one not found is an issue.

    ``ids`` and the grains share the column id; a grain has text besides.
    """
    rows = reduce(DataFrame.unionByName, [g.select("id", "text").withColumn("grain", F.lit(name)) for name, g in grains.items()])
    return ids.select("id").distinct().join(rows, "id", "left").select(
        "id", "grain", F.substring("text", 1, most).alias("excerpt"), (F.length("text") > most).alias("truncated"),
        F.when(F.col("grain").isNull(), "evidence_not_found").alias("issue"),
    )


def audit_candidates(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """The sorted reasons against each record; none passes it.

    ``records``: ``key``, filing_ids and evidence (array of struct: evidence_id, filing_id, sha256).
    ``evidence``: evidence_id, filing_id, sha256, parse_status, table_parse_status, format, lineage_status.
    """
    actual = evidence.select("evidence_id", F.struct(*evidence.columns).alias("a"))
    cited = records.select(key, "filing_ids", F.explode("evidence").alias("e")).withColumn("evidence_id", F.col("e.evidence_id")).join(actual, "evidence_id", "left")
    there, differs = F.col("a").isNotNull(), lambda x, y: ~x.eqNullSafe(y)
    reasons = all_failures(
        ("evidence_not_found", ~there),
        ("cross_filing_evidence", there & (differs(F.col("a.filing_id"), F.col("e.filing_id")) | ~F.coalesce(F.array_contains("filing_ids", F.col("a.filing_id")), F.lit(False)))),
        ("citation_mismatch", there & differs(F.col("a.sha256"), F.col("e.sha256"))),
        ("source_parse_failed", there & differs(F.col("a.parse_status"), F.lit("success"))),
        ("table_parse_failed", there & (F.col("a.table_parse_status") != "success")),
        ("visual_evidence_blocked", there & (F.col("a.format") == "pdf")),
        ("lineage_not_answer_safe", there & ~F.coalesce(F.col("a.lineage_status").isin(SAFE_LINEAGE), F.lit(False))),
    )
    found = cited.select(key, F.explode(reasons).alias("reason")).groupBy(key).agg(F.collect_set("reason").alias("found"))
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    own = all_failures(("duplicate_candidate", F.size(ids) > F.size(F.array_distinct(ids))))
    return records.join(found, key, "left").select(key, F.array_sort(F.array_union(F.coalesce("found", F.array().cast("array<string>")), own)).alias("reasons"))


def automatic_checks(records: DataFrame, key: str) -> DataFrame:
    """Distinct (rule, message) of each record.

    ``records``: ``key``, filing_ids, version_basis, evidence_filing_ids, sources (array of struct:
    source_id, parse_status) and versions (array of struct: filing_id, is_current).
    """
    outside = F.array_sort(F.array_distinct(F.array_except("evidence_filing_ids", "filing_ids")))
    failed = F.filter("sources", lambda s: F.coalesce(s["parse_status"], F.lit("")) != "success")
    stale = F.transform(F.filter("versions", lambda v: ~F.coalesce(v["is_current"], F.lit(False))), lambda v: v["filing_id"].cast("string"))
    issue = lambda rule, message: F.struct(F.lit(rule).alias("rule_id"), message.alias("message"))
    issues = F.concat(
        F.filter(F.array(issue("evidence_outside_candidate_filings", F.array_join(outside, ","))), lambda _: F.size(outside) > 0),
        F.transform(F.coalesce(failed, F.array().cast("array<struct<source_id:string,parse_status:string>>")), lambda s: issue("source_parse_not_success", F.concat_ws(":", s["source_id"].cast("string"), F.coalesce(s["parse_status"], F.lit(""))))),
        F.filter(F.array(issue("latest_basis_requires_current_filings", F.array_join(stale, ","))), lambda _: (F.col("version_basis") == "latest_effective") & (F.size(stale) > 0)),
    )
    return records.select(key, F.explode(F.array_distinct(issues)).alias("i")).select(key, "i.rule_id", "i.message")


def recomputed(rows: DataFrame, operation: str, a: str, b: str, declared: str) -> DataFrame:
    """Why a declared calculation is not admitted: unknown operation, missing numbers, or another result (exact to six places)."""
    operations = ["sum", "difference", "ratio", "percentage_ratio", "growth_rate"]
    value = F.coalesce(*[F.when(F.col(operation) == op, C.calculate(op, F.col(a), F.col(b))["value"]) for op in operations])
    return rows.withColumn("reason", first_failure(
        ("calculation_numeric_invalid", F.col(a).isNull() | F.col(b).isNull() | F.col(declared).isNull()),
        ("calculation_operation_invalid", ~F.coalesce(F.col(operation).isin(operations), F.lit(False)) | value.isNull()),
        ("calculation_result_mismatch", value != F.col(declared).cast(C.RESULT)),
    ))


def confirm_in_cells(facts: DataFrame, cells: DataFrame, document: str, value: str) -> DataFrame:
    """Whether a fact's value stands in exactly one cell of its document, in several, or in none."""
    found = cells.groupBy(document, value).agg(F.count("*").alias("cells"))
    n = F.coalesce("cells", F.lit(0))
    return facts.join(found, [document, value], "left").withColumn("status", F.when(n == 1, "confirmed").when(n > 1, "ambiguous").otherwise("missing")).drop("cells")
