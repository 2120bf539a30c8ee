"""Serving facts and evidence: answer-safe filters, grain matches, evidence joins, hydration, lookups."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a figure as a forecast.
FORECAST = ["forecast", "estimate", "projection", "guidance", "예상", "전망", "추정"]
SAFE_LINEAGE = ["root", "resolved"]


# ---- filters ------------------------------------------------------------------------------


def image_references(coverage: str = "coverage_json") -> Column:
    """The number of image references that a coverage record declares; 0 where it has none or no number."""
    return F.coalesce(F.get_json_object(coverage, "$.image_reference_count").try_cast("int"), F.lit(0))


def answer_safe(status: str = "parse_status", kind: str = "detected_format", coverage: str = "coverage_json") -> Column:
    """parsed with success, no PDF, no image references."""
    return F.coalesce((F.col(status) == "success") & (F.col(kind) != "pdf") & (image_references(coverage) == 0), F.lit(False))


def validated_actual(status: str, *described: str) -> Column:
    """validated, and none of the describing columns names a forecast."""
    words = F.lower(F.concat_ws(" ", *described))
    return F.coalesce(F.col(status) == "validated", F.lit(False)) & ~reduce(lambda a, b: a | b, [words.contains(w) for w in FORECAST])


def grain_matches(names: list[str], company: Column, scope: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """a fact answers a request: one of its names is the company, its scope is the asked one, its
    instant lies in the asked span or its duration is that span, and it has evidence."""
    out = reduce(lambda a, b: a | b, [F.coalesce(F.col(n) == company, F.lit(False)) for n in names])
    if scope is not None:
        out &= F.col("scope").eqNullSafe(scope)
    instant = F.col("period_type") == "instant"
    for asked, side, edge in ((start, "period_start", lambda a: F.col("instant_date") >= a), (end, "period_end", lambda a: F.col("instant_date") <= a)):
        if asked is not None:
            out &= F.coalesce(F.when(instant, edge(asked)).otherwise(F.col(side) == asked), F.lit(False))
    return out & (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0)


def in_slot(start: Column, end: Column, slot_start: Column, slot_end: Column) -> Column:
    """a period lies inside a slot whose open sides are null; a period without any date does not."""
    inside = (slot_start.isNull() | F.coalesce(start >= slot_start, F.lit(False))) & (slot_end.isNull() | F.coalesce(end <= slot_end, F.lit(False)))
    return inside & F.coalesce(start, end).isNotNull()


def period_owned(refs: DataFrame, facts: DataFrame, slot_start: Column, slot_end: Column) -> DataFrame:
    """F14 per evidence id: all facts that rest on it lie in the slot; without facts its own date decides.

    ``refs`` (evidence_id, own_date), ``facts`` (evidence_id, period_start, period_end).
    """
    all_in = facts.groupBy("evidence_id").agg(F.bool_and(in_slot(F.col("period_start"), F.col("period_end"), slot_start, slot_end)).alias("_all_in"))
    own = in_slot(F.col("own_date"), F.col("own_date"), slot_start, slot_end)
    return refs.join(all_in, "evidence_id", "left").withColumn("owned", F.coalesce("_all_in", own)).drop("_all_in")


def label_candidates(fragments: DataFrame, kinds: list[str], labels: list[str]) -> DataFrame:
    """F16: fragments of the given kinds whose text names one of the labels; the filter reaches the scan."""
    return fragments.filter(F.col("fragment_type").isin(kinds) & reduce(lambda a, b: a | b, [F.col("text").contains(x) for x in labels]))


def displayed(facts: DataFrame, value: str = "value", scale: str = "scale") -> DataFrame:
    """normalised and displayed value and a struct of identifiers beside the columns of a fact."""
    whole = (F.col(value) * F.col(scale)).cast("decimal(38,4)")
    return facts.withColumns({"value_normalised": whole, "display": F.format_number(whole, 0), "identifiers": F.struct("fact_id", "filing_id")})


# ---- joins --------------------------------------------------------------------------------


def facts_with_evidence(facts: DataFrame, evidence: DataFrame, cells: DataFrame, sources: DataFrame, versions: DataFrame, version: Column) -> DataFrame:
    """Validated facts with their evidence, one row per fact: sorted evidence ids, largest number of images, lineage.

    A column that a group shares is taken by ``min``, so that no row decides by chance.
    """
    met = (
        facts.filter("validation_status = 'validated'")
        .join(versions.filter(version).select("filing_id", "lineage_status"), "filing_id")
        .join(evidence, "fact_id")
        .join(cells.select("evidence_id", "source_id"), "evidence_id")
        .join(sources.filter(answer_safe()), "source_id")
    )
    own = [F.min(c).alias(c) for c in facts.columns if c != "fact_id"]
    return met.groupBy("fact_id").agg(*own, F.min("lineage_status").alias("lineage_status"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.max(image_references()).alias("image_reference_count"))


def overlay_facts(overlay: DataFrame, filings: DataFrame, versions: DataFrame, evidence: DataFrame, cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts of an overlay with their filing; the evidence ids as one sorted JSON array."""
    met = (
        overlay.join(filings.select("filing_id", "issuer", "filed_at"), "filing_id")
        .join(versions.filter(F.col("lineage_status").isin(SAFE_LINEAGE) & F.col("is_current")).select("filing_id"), "filing_id")
        .join(evidence, "fact_id")
        .join(cells.select("evidence_id", "source_id"), "evidence_id")
        .join(sources.filter(answer_safe()).select("source_id"), "source_id")
    )
    return met.groupBy("fact_id").agg(F.min("issuer").alias("issuer"), F.max("filed_at").alias("filed_at"), F.to_json(F.array_sort(F.collect_set("evidence_id"))).alias("evidence_json"))


def evidence_flags(facts: DataFrame, evidence: DataFrame, cells: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Every fact, with evidence or without: whether all its evidence is a cell, of its own filing, from a safe source, and its lineage is safe."""
    met = (
        facts.select("fact_id", F.col("filing_id").alias("own_filing"))
        .join(evidence, "fact_id", "left")
        .join(cells.select("evidence_id", "filing_id", "source_id"), "evidence_id", "left")
        .join(sources.withColumn("safe", answer_safe()).select("source_id", "safe"), "source_id", "left")
        .join(versions.select(F.col("filing_id").alias("own_filing"), "lineage_status"), "own_filing", "left")
    )
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
    return met.groupBy("fact_id").agg(
        F.count("evidence_id").alias("evidence"),
        every(F.col("filing_id").isNotNull()).alias("all_cells"),
        every(F.col("filing_id") == F.col("own_filing")).alias("all_own"),
        every(F.col("safe")).alias("all_safe"),
        every(F.col("lineage_status").isin(SAFE_LINEAGE)).alias("safe_lineage"),
    )


def with_root(versions: DataFrame, event: str) -> DataFrame:
    """Current versions with the first version of their event, if there is one."""
    roots = versions.filter("version_no = 1").select(F.col(event), F.col("filing_id").alias("original_filing_id"))
    return versions.filter("is_current").join(roots, event, "left")


def rows_of_cells(cells: DataFrame, fragments: DataFrame) -> DataFrame:
    """The row fragment of each cell: same filing and table, and the row that the fragment's locator names."""
    rows = fragments.withColumn("row_index", F.get_json_object("locator_json", "$.row").try_cast("int")).filter("fragment_type = 'table_row' and row_index is not null")
    return cells.join(rows.select("filing_id", "table_id", "row_index", F.col("fragment_id")), ["filing_id", "table_id", "row_index"])


def hydrated(wanted: DataFrame, grains: list[DataFrame], sources: DataFrame, versions: DataFrame, version: Column) -> DataFrame:
    """(evidence_id, place) with text, source and version of whichever grain holds the id, admitted versions only, places kept."""
    every = reduce(DataFrame.unionByName, [g.select("evidence_id", "filing_id", "source_id", "text") for g in grains])
    return wanted.join(every, "evidence_id").join(sources.select("source_id", "detected_format"), "source_id").join(versions.filter(version).select("filing_id", "version_no"), "filing_id")


def filing_mismatches(facts: DataFrame, evidence: DataFrame, cells: DataFrame) -> DataFrame:
    """Evidence that lies in another filing than its fact."""
    met = facts.select("fact_id", F.col("filing_id").alias("fact_filing")).join(evidence, "fact_id").join(cells.select("evidence_id", F.col("filing_id").alias("cell_filing")), "evidence_id")
    return met.filter("fact_filing <> cell_filing")


def validated_without_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q10: validated facts that no evidence supports."""
    return facts.filter("validation_status = 'validated'").join(evidence.select("fact_id"), "fact_id", "left_anti")


def reconcile(seed: DataFrame, gold: DataFrame) -> DataFrame:
    """Every validated seed against its gold record (key, filing_id, value, scale, evidence_ids on both sides): all reasons, sorted."""
    n_seed = seed.groupBy("key").agg(F.count("*").alias("_seeds"))
    first = ["filing_id", "value", "scale", "evidence_ids"]
    one = gold.groupBy("key").agg(F.count("*").alias("_golds"), F.min(F.struct(*first)).alias("_gold"))
    met = seed.join(n_seed, "key").join(one, "key", "left")
    known = F.col("_golds").isNotNull()
    differs = lambda c: known & ~F.col(c).eqNullSafe(F.col(f"_gold.{c}"))
    same = lambda a: F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<bigint>"))))
    reasons = [
        ("duplicate_seed", F.col("_seeds") != 1), ("missing_gold", ~known), ("duplicate_gold", F.col("_golds") > 1), ("filing_mismatch", differs("filing_id")),
        ("value_mismatch", differs("value")), ("scale_mismatch", differs("scale")), ("evidence_mismatch", known & (same(F.col("evidence_ids")) != same(F.col("_gold.evidence_ids")))),
    ]
    found = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons])))
    return met.withColumn("reason_codes", found).withColumn("status", F.when(F.size("reason_codes") == 0, "covered").otherwise("gap")).drop("_seeds", "_golds", "_gold")


# ---- order and limits ---------------------------------------------------------------------


def guarded(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The rows in order, none at all where there are more than ``most``. One row above the limit is enough to know."""
    first = rows.orderBy(*order).limit(most + 1)
    number = first.agg(F.count("*").alias("_n"))
    return first.crossJoin(F.broadcast(number)).filter(F.col("_n") <= most).drop("_n")


def catalogue_place(column: Column, names: list[str]) -> Column:
    """The place of a name in a catalogue; names that it lacks come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), column), F.lit(0)), F.lit(len(names) + 1))


# ---- lookups and derived periods ----------------------------------------------------------


def unique_statement_value(cells: DataFrame, key: list[str], consolidated: str, value: str) -> DataFrame:
    """Per key the value of its consolidated cells, else of the others, if it is one; else the reason."""
    best = cells.groupBy(*key).agg(F.bool_or(consolidated).alias("_has"))
    met = cells.join(best, key).filter(F.col(consolidated) == F.col("_has"))
    kinds = F.countDistinct(value)
    return met.groupBy(*key).agg(F.when(kinds == 1, F.min(value)).alias(value), F.bool_or(consolidated).alias("is_consolidated"), F.when(kinds > 1, "value_conflict").when(kinds == 0, "no_value").alias("reason"))


def derived(facts: DataFrame, key: list[str], period: str, value: str, operation: str) -> DataFrame:
    """Growth between neighbouring periods; difference or ratio of the last two; the sum of all.

    Values are decimals. A key with too few periods, or a zero base, has no row.
    """
    places = "decimal(38,10)"
    short = lambda c: c.cast("decimal(22,4)")  # noqa: E731  (a quotient of two such keeps 16 places)
    if operation == "sum":
        return facts.groupBy(*key).agg(F.sum(value).cast(places).alias("result"))
    window = Window.partitionBy(*key).orderBy(period)
    pairs = facts.withColumns({"from_period": F.lag(period).over(window), "_before": F.lag(value).over(window)}).filter("_before is not null")
    if operation == "growth_rate":
        made = pairs.filter("_before <> 0").withColumn("result", (short((F.col(value) - F.col("_before")) * 100) / short(F.col("_before"))).cast(places))
        return made.select(*key, "from_period", F.col(period).alias("to_period"), "result")
    if operation not in ("difference", "ratio"):
        raise ValueError("operation must be growth_rate, difference, ratio or sum")
    last = pairs.withColumn("_last", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(period)))).filter("_last = 1")
    if operation == "difference":
        return last.select(*key, (F.col(value) - F.col("_before")).cast(places).alias("result"))
    return last.filter("_before <> 0").select(*key, (short(F.col(value)) / short(F.col("_before"))).cast(places).alias("result"))


def reviewed(rejects: DataFrame, decisions: DataFrame, grain: list[str], label: str, value: str) -> DataFrame:
    """Groups of duplicate rejects that a decision names a preferred label for: admitted if their values agree and the label is one row's.

    One row per group: status and reason_code.
    """
    met = rejects.join(decisions.select(*grain, F.col(label).alias("_wanted")), grain, "left")
    group = met.groupBy(*grain).agg(F.countDistinct(value).alias("values"), F.count_if(F.col(label) == F.col("_wanted")).alias("preferred"), F.bool_or(F.col("_wanted").isNotNull()).alias("decided"))
    reason = F.when(~F.col("decided"), "undecided").when(F.col("values") != 1, "review_value_conflict").when(F.col("preferred") != 1, "review_preferred_label_not_unique")
    return group.select(*grain, F.when(reason.isNull(), "admitted").otherwise("unresolved").alias("status"), reason.alias("reason_code"))


def label_inventory(cells: DataFrame, tables: DataFrame, titles: list[str]) -> DataFrame:
    """How often each text stands in column 0 of the tables whose caption, blanks aside, names one of the titles."""
    bare = F.regexp_replace("caption", " ", "")
    wanted = tables.filter((F.col("parse_status") == "success") & reduce(lambda a, b: a | b, [bare.contains(t) for t in titles])).select("table_id")
    return cells.filter((F.col("column_index") == 0) & (F.trim("text") != "")).join(wanted, "table_id", "left_semi").groupBy("text").agg(F.count("*").alias("n"))


def computed_columns(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Several computed columns at once."""
    return rows.withColumns(dict(columns))
