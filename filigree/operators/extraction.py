"""From statement tables to validated facts, and the audit forms around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import account_label, numeric_value, unit_scale
from filigree.operators.components import connected_components

# Section titles and their scope; caption markers with type and priority, in order.
SCOPES = {"2. 연결재무제표": "consolidated", "4. 재무제표": "separate"}
STATEMENTS = [("재무상태표", "BS", 0), ("포괄손익계산서", "CIS", 1), ("손익계산서", "IS", 0)]


def classify_statements(tables: DataFrame) -> DataFrame:
    """scope, statement_type, priority and scale of the main statement tables among ``tables``
    (table_id, parse_status, section_path array, caption, unit_text); other tables go."""
    section = F.trim(F.try_element_at("section_path", F.lit(-1)))
    caption = F.regexp_replace(F.coalesce("caption", F.lit("")), r"(?U)\s+", "")
    scope = kind = priority = None
    for title, name in SCOPES.items():
        scope = F.when(section == title, name) if scope is None else scope.when(section == title, name)
    for marker, name, order in STATEMENTS:
        hit = caption.contains(marker)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        priority = F.when(hit, order) if priority is None else priority.when(hit, order)
    marked = tables.withColumns({"scope": scope, "statement_type": kind, "statement_priority": priority, "scale": unit_scale(F.col("unit_text"))})
    return marked.filter("parse_status = 'success' and scope is not null and statement_type is not null and scale is not null")


def year_columns(header: DataFrame) -> DataFrame:
    """(table_id, column_index, fiscal_year) of header cells (table_id, column_index, text, report_year).

    A term number counts back from the table's largest, which is the report's year; a cell
    without one may name a year itself.
    """
    term = F.regexp_extract(F.regexp_replace("text", r"\s+", ""), "제([0-9]+)기", 1).try_cast("int")
    years = F.filter(F.regexp_extract_all("text", F.lit("([0-9]+)")), lambda n: (F.length(n) == 4) & n.startswith("20"))
    year = F.get(years, F.lit(0)).try_cast("int")
    marked = header.withColumns({"_term": term, "_year": year})
    top = F.max("_term").over(Window.partitionBy("table_id"))
    marked = marked.withColumn("fiscal_year", F.coalesce(F.col("report_year") - (top - F.col("_term")), F.col("_year")))
    return marked.filter("fiscal_year is not null").groupBy("table_id", "column_index").agg(F.min("fiscal_year").alias("fiscal_year"))


def candidates(tables: DataFrame, cells: DataFrame, accounts: DataFrame, years: DataFrame) -> DataFrame:
    """One row per labelled numeric cell under a year: the label in column 0 names the account.

    ``accounts`` (label, account_id) is a short catalogue of constants.
    """
    label = cells.filter("column_index = 0").select("table_id", "row_index", account_label(F.col("text")).alias("label"))
    named = label.join(F.broadcast(accounts), "label")
    values = cells.filter("column_index > 0").select("table_id", "row_index", "column_index", "evidence_id", numeric_value(F.col("text")).alias("value_numeric"))
    found = values.filter("value_numeric is not null").join(named, ["table_id", "row_index"]).join(years, ["table_id", "column_index"])
    return found.join(tables.select("table_id", "filing_id", "scope", "statement_type", "statement_priority", "scale"), "table_id")


def resolve_filing(rows: DataFrame) -> DataFrame:
    """Per filing the consolidated scope if it has one, else the separate one; per account
    and year the single row of the smallest statement priority, else a reason."""
    has = F.max(F.when(F.col("scope") == "consolidated", 1).otherwise(0)).over(Window.partitionBy("filing_id"))
    scoped = rows.withColumn("_both", has).filter((F.col("scope") == "consolidated") == (F.col("_both") == 1)).drop("_both")
    grain = ["filing_id", "account_id", "fiscal_year"]
    lowest = scoped.groupBy(*grain).agg(F.min("statement_priority").alias("statement_priority"))
    kept = scoped.join(lowest, [*grain, "statement_priority"])
    seen = kept.groupBy(*grain).agg(F.count("*").alias("_n"), F.countDistinct("value_numeric").alias("_values"))
    reason = F.when(F.col("_n") == 1, None).when(F.col("_values") > 1, "conflicting_metric_grain").otherwise("duplicate_metric_grain")
    return kept.join(seen, grain).withColumn("reason_code", reason).drop("_n", "_values")


def first_failure(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """The reason of the first check, in order, that a row fails (null: none)."""
    return rows.withColumn("reason_code", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks], F.lit(None).cast("string")))


def validate_by_reconstruction(seed: DataFrame, recomputed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Seed rows against the same rows computed again, field by field."""
    again = recomputed.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    joined = seed.join(again, key, "left")
    checks = [(F.col("_there"), "not_reconstructed"), *((F.col(f).eqNullSafe(F.col(f"_{f}")), f"{f}_mismatch") for f in fields)]
    return first_failure(joined, checks).select(*seed.columns, "reason_code")


def allowed_events(facts: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Facts whose (fact_type, predicate) is listed, with the id and kind of the list;
    a filing that gives one predicate several values loses them all, with the reason."""
    listed = facts.join(F.broadcast(allowlist), ["fact_type", "predicate"])
    kinds = listed.groupBy("filing_id", "predicate_id").agg(F.countDistinct(F.struct("value", "unit")).alias("_kinds"))
    return listed.join(kinds, ["filing_id", "predicate_id"]).withColumn("reason_code", F.when(F.col("_kinds") > 1, "conflicting_values")).drop("_kinds")


def numeric_event_cell(cells: DataFrame) -> DataFrame:
    """Per fact its numeric cell (fact_id, text, unit_text), if it is the only one and its unit is clear."""
    number = cells.withColumns({"value": numeric_value(F.col("text")), "scale": unit_scale(F.col("unit_text"))})
    one = number.groupBy("fact_id").agg(F.count("value").alias("_n"), F.min("value").alias("value"), F.min(F.when(F.col("value").isNotNull(), F.col("scale"))).alias("scale"))
    reason = F.when(F.col("_n") == 0, "no_numeric_cell").when(F.col("_n") > 1, "ambiguous_numeric_cell").when(F.col("scale").isNull(), "unit_unclear")
    return one.withColumn("reason_code", reason).select("fact_id", F.when(reason.isNull(), F.col("value")).alias("value"), "scale", "reason_code")


def universe(companies: DataFrame, reports: DataFrame) -> DataFrame:
    """Per company its latest current annual report, or the reason why there is none.

    ``reports``: company, filing_id, filed_at, lineage_status, base_year.
    """
    latest = reports.groupBy("company").agg(F.max_by(F.struct("filing_id", "lineage_status", "base_year"), F.struct("filed_at", "filing_id")).alias("r"))
    safe = F.coalesce(F.col("r.lineage_status").isin("root", "resolved"), F.lit(False))
    reason = F.when(~safe, "answer_safe_annual_report_missing").when(F.col("r.base_year").isNull(), "annual_report_fiscal_year_missing")
    return companies.select("company").distinct().join(latest, "company", "left").select(
        "company", F.when(reason.isNull(), F.col("r.filing_id")).alias("filing_id"), F.when(reason.isNull(), F.col("r.base_year")).alias("fiscal_year"), reason.alias("reason_code")
    )


def group_splits(cases: DataFrame, shares: dict[str, int]) -> DataFrame:
    """Cases that share a key, directly or by others, get one group and one split.

    ``cases``: case_id (number) and keys (array). A case is linked with the smallest case of each of
    its keys, so a key of many cases makes one edge per case. The group is named by its smallest
    case, and a hash of the name decides the split.
    """
    keyed = cases.select("case_id", F.explode("keys").alias("key")).distinct()
    low = keyed.groupBy("key").agg(F.min("case_id").alias("low"))
    edges = keyed.join(low, "key").select(F.col("case_id").alias("a"), F.col("low").alias("b"))
    groups = connected_components(edges).select(F.col("node").alias("case_id"), F.col("label").alias("_label"))
    out = cases.join(groups, "case_id", "left").withColumn("group_id", F.coalesce("_label", "case_id")).drop("_label")
    bucket = F.conv(F.substring(F.sha2(F.col("group_id").cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long") % sum(shares.values())
    split, border = None, 0
    for name, share in shares.items():
        border += share
        split = F.when(bucket < border, name) if split is None else split.when(bucket < border, name)
    return out.withColumn("split", split)


def provenance(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """Whether each fact (fact_id, value, evidence_ids) is one of its cited cells' values or their sum."""
    cited = facts.select("fact_id", "value", F.explode_outer("evidence_ids").alias("evidence_id")).join(cells.select("evidence_id", F.col("value").alias("cell")), "evidence_id", "left")
    got = cited.groupBy("fact_id", "value").agg(F.count("cell").alias("_n"), F.bool_or(F.col("cell") == F.col("value")).alias("_one"), F.sum("cell").alias("_sum"))
    reason = F.when(F.col("_n") == 0, "fact_without_resolvable_evidence").when(~(F.coalesce("_one", F.lit(False)) | (F.col("_sum") == F.col("value"))), "fact_not_in_cited_evidence")
    return got.select("fact_id", reason.alias("reason_code"))


def review_agreement(answers: DataFrame, reviews: DataFrame, least: int = 2) -> DataFrame:
    """Per question whether enough reviewers all agree with the candidate and find it supported."""
    plain = lambda c: F.regexp_replace(c, r"[\s,]", "")
    met = answers.join(reviews.select("question_id", F.col("answerability").alias("_a"), F.col("value").alias("_v"), "support_verdict"), "question_id", "left")
    got = met.groupBy("question_id").agg(
        F.count("support_verdict").alias("reviews"),
        F.coalesce(F.bool_and(F.col("_a") == F.col("answerability")), F.lit(False)).alias("answerability_agreement"),
        F.coalesce(F.bool_and(plain(F.col("_v")) == plain(F.col("value"))), F.lit(False)).alias("exact_agreement"),
        F.coalesce(F.bool_and(F.col("support_verdict") == "supported"), F.lit(False)).alias("supported"),
    )
    return got.withColumn("passes", (F.col("reviews") >= least) & F.col("answerability_agreement") & F.col("exact_agreement") & F.col("supported"))


def claim_checks(claims: DataFrame) -> DataFrame:
    """Per claim which of its citations and numbers are not admitted (arrays against arrays)."""
    extra = {n: F.array_except(F.coalesce(n, F.array().cast("array<string>")), F.coalesce(f"admitted_{n}", F.array().cast("array<string>"))) for n in ("citations", "numbers")}
    reasons = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(f"{n}_not_admitted")) for n, x in extra.items()], F.when(F.size(F.coalesce("citations", F.array().cast("array<string>"))) == 0, F.lit("no_citation"))))
    return claims.withColumn("reasons", reasons).withColumn("verified", F.size("reasons") == 0)


def count_mismatches(declared: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys whose declared count is not the count of rows; a missing side counts as 0."""
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    both = declared.join(actual, key, "full").na.fill(0, ["declared", "actual"])
    return both.filter("declared <> actual")
