"""What an answer may rest on (facts and calculations whose evidence a slot owns), and whether its claims do.

All frames have a column ``answer``. What one answer was given (evidence, slots, facts, calculations) is one tool's
reply, so it is kept as arrays of one row; the frames meet by equi-joins on the answer. Null arrays are empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.prose import prose_numbers
from filigree.functions.text import exact_number
from filigree.operators import calculation as C
from filigree.operators.evaldata import all_failures

# The slot of an answer that declares none, words that are no finite number.
IMPLICIT_SLOT = "tool_evidence"
NOT_FINITE = ["nan", "inf", "infinity"]

TEXTS = "array<string>"


def listed(x: Column | str) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(x, F.array()).cast(TEXTS)))


def within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def numbers_of(x: Column | str) -> Column:
    """Texts of numbers in their one writing; null for what is none."""
    return F.transform(F.coalesce(x, F.array().cast(TEXTS)), exact_number)


def admission(admitted: DataFrame, slots: DataFrame) -> DataFrame:
    """(answer, admitted, slots): the slots (answer, slot, evidence_ids, complete) of each answer that count.

    A slot counts if it is not incomplete, has evidence, and all of it is admitted. An answer without any slot row has
    one slot of all that is admitted.
    """
    own = admitted.select("answer", listed("evidence_ids").alias("admitted"))
    each = own.join(slots.select("answer", "slot", listed("evidence_ids").alias("_ids"), F.coalesce("complete", F.lit(True)).alias("_complete")), "answer", "left")
    counts = F.col("_complete") & (F.size("_ids") > 0) & within(F.col("_ids"), F.col("admitted"))
    got = each.groupBy("answer", "admitted").agg(F.count("slot").alias("_rows"), F.array_sort(F.collect_list(F.when(counts, F.struct(F.col("slot").cast("string").alias("slot"), F.col("_ids").alias("ids"))))).alias("slots"))
    implicit = F.array(F.struct(F.lit(IMPLICIT_SLOT).alias("slot"), F.array_sort("admitted").alias("ids")))
    return got.withColumn("slots", F.when((F.col("_rows") == 0) & (F.size("admitted") > 0), implicit).otherwise(F.col("slots"))).drop("_rows")


def owning(ids: Column) -> Column:
    """The slots that hold all of the evidence; none for no evidence."""
    return F.transform(F.filter("slots", lambda s: (F.size(ids) > 0) & within(ids, s["ids"])), lambda s: s["slot"])


def admitted_facts(facts: DataFrame, given: DataFrame) -> DataFrame:
    """Facts (answer, fact, evidence_ids, numbers) with ``owners`` (slots) and ``reason`` (null: admitted). ``given`` is an ``admission``."""
    met = facts.join(given, "answer", "left").withColumns({"evidence_ids": listed("evidence_ids"), "admitted": listed("admitted")}).withColumn("owners", F.coalesce(owning(F.col("evidence_ids")), F.array().cast(TEXTS)))
    reason = F.when(~within(F.col("evidence_ids"), F.col("admitted")), "fact_support_not_admitted").when(F.size("owners") == 0, "fact_slot_unowned")
    return met.withColumn("reason", reason).drop("admitted", "slots")


def recalculated(operation: Column, operands: Column) -> Column:
    """X15 for an operation named per row and an array of operands: the value, null where it cannot be had."""
    n, base, subject = F.size(operands), F.get(operands, F.lit(0)), F.get(operands, F.size(operands) - 1)
    total = F.aggregate(operands, F.lit(0).cast(C.RESULT), lambda s, x: F.try_add(s, x.try_cast(C.OPERAND)).cast(C.RESULT))
    value = F.when((operation == "lookup") & (n == 1), base.try_cast(C.RESULT)).when((operation == "sum") & (n > 0), total)
    for name in C.OPERATIONS:
        if name != "sum":
            value = value.when((operation == name) & (n == 2), C.calculate(name, base, subject)["value"])
    return value


def facts_of(facts: DataFrame) -> DataFrame:
    """(answer, facts): the admitted facts of each answer as one array."""
    fact = F.struct(F.col("fact").cast("string").alias("fact"), F.col("evidence_ids").alias("ids"), F.array_compact(numbers_of("numbers")).alias("numbers"))
    return facts.filter(F.col("reason").isNull()).groupBy("answer").agg(F.array_sort(F.collect_list(fact)).alias("facts"))


def admitted_calculations(calculations: DataFrame, facts: DataFrame, given: DataFrame) -> DataFrame:
    """Calculations (answer, calculation, operation, operands, declared, evidence_ids) with ``owners`` and ``reasons`` (empty: admitted).

    A calculation is done again from its operands, and each operand must be a number of an admitted fact whose evidence the
    calculation cites. ``facts`` is the result of ``admitted_facts``.
    """
    met = calculations.join(given, "answer", "left").join(facts_of(facts), "answer", "left")
    ids, parsed = listed("evidence_ids"), numbers_of("operands")
    met = met.withColumns({"evidence_ids": ids, "admitted": listed("admitted"), "_parsed": parsed, "_value": recalculated(F.col("operation"), F.col("operands"))}).withColumn("owners", F.coalesce(owning(F.col("evidence_ids")), F.array().cast(TEXTS)))
    usable = F.transform(F.filter("facts", lambda f: within(f["ids"], F.col("evidence_ids"))), lambda f: f["numbers"])
    met = met.withColumn("_known", F.coalesce(F.flatten(usable), F.array().cast(TEXTS)))
    invalid = (F.size("_parsed") <= 0) | F.exists("_parsed", lambda x: x.isNull()) | F.col("declared").try_cast(C.RESULT).isNull()
    reasons = all_failures(
        ("calculation_support_not_admitted", (F.size("evidence_ids") == 0) | ~within(F.col("evidence_ids"), F.col("admitted"))),
        ("calculation_numeric_invalid", invalid), ("calculation_operation_invalid", ~invalid & F.col("_value").isNull()),
        ("calculation_result_mismatch", ~invalid & (F.col("_value") != F.col("declared").try_cast(C.RESULT))),
        ("calculation_operand_evidence_missing", ~within(F.array_compact("_parsed"), F.col("_known"))), ("calculation_slot_unowned", F.size("owners") == 0),
    )
    return met.withColumn("reasons", reasons).drop("admitted", "slots", "facts", "_parsed", "_value", "_known")


def verified_claims(claims: DataFrame, given: DataFrame, facts: DataFrame, calculations: DataFrame) -> DataFrame:
    """Claims (answer, claim, text, citations, slots, fact_refs, calculation_refs, numbers) with ``reasons`` (empty: verified).

    A claim must cite admitted evidence inside the slots it names, rest on admitted facts and calculations whose evidence it
    cites, list only numbers of those, and list every number of its text. Reasons stand once, in the order of these checks.
    """
    done = F.struct(F.col("calculation").cast("string").alias("name"), F.col("evidence_ids").alias("ids"), F.array_compact(F.array(exact_number(F.col("declared")))).alias("numbers"), "reasons")
    results = calculations.groupBy("answer").agg(F.array_sort(F.collect_list(done)).alias("_results"))
    named = claims.withColumnRenamed("slots", "slot_refs").withColumns({c: listed(c) for c in ("citations", "slot_refs", "fact_refs", "calculation_refs")})
    met = named.join(given, "answer", "left").join(facts_of(facts), "answer", "left").join(results, "answer", "left")
    none = F.array().cast(TEXTS)
    met = met.withColumns({
        "_facts": F.filter("facts", lambda f: F.array_contains("fact_refs", f["fact"])),
        "_tried": F.filter("_results", lambda r: F.array_contains("calculation_refs", r["name"])),
        "_slots": F.filter("slots", lambda s: F.array_contains("slot_refs", s["slot"])),
        "_declared": numbers_of("numbers"), "_prose": numbers_of(prose_numbers(F.coalesce("text", F.lit("")), none, none)),
    })
    met = met.withColumn("_done", F.filter("_tried", lambda r: F.size(r["reasons"]) == 0))
    every = lambda c, field: F.coalesce(F.flatten(F.transform(c, lambda x: x[field])), none)
    met = met.withColumns({
        "_held": every("_slots", "ids"), "_support": F.concat(every("_facts", "ids"), every("_done", "ids")), "_grounded": F.concat(every("_facts", "numbers"), every("_done", "numbers")),
        "_missing": F.array_except("calculation_refs", F.coalesce(F.transform("_tried", lambda r: r["name"]), none)), "admitted": listed("admitted"),
    })
    found = lambda c: F.coalesce(F.size(F.array_distinct(c)), F.lit(0))
    outside = (F.size("slot_refs") > found(F.transform("_slots", lambda s: s["slot"]))) | ~within(F.col("citations"), F.col("_held"))
    unsupported = ~within(F.col("_support"), F.col("citations")) | ~within(F.col("_support"), F.col("_held"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    infinite = F.arrays_overlap(words, F.array(*[F.lit(w) for w in NOT_FINITE])) | F.exists("_declared", lambda x: x.isNull())
    first = all_failures(
        ("claim_citation_not_admitted", (F.size("citations") == 0) | ~within(F.col("citations"), F.col("admitted"))), ("evidence_slot_mismatch", outside),
        ("fact_ref_not_admitted", F.size("fact_refs") > found(F.transform("_facts", lambda f: f["fact"]))),
    )
    last = all_failures(
        ("calculation_ref_not_admitted", F.size("_missing") > 0), ("evidence_slot_mismatch", unsupported), ("numeric_value_not_finite", infinite),
        ("numeric_value_not_grounded", ~within(F.array_compact("_declared"), F.col("_grounded"))), ("prose_number_unlisted", ~within(F.array_compact("_prose"), F.array_compact("_declared"))),
    )
    out = met.withColumn("reasons", F.array_distinct(F.concat(first, every("_tried", "reasons"), last)))
    return out.select(*[c for c in named.columns if c != "slot_refs"], F.col("slot_refs").alias("slots"), "reasons")


def verified_answers(answers: DataFrame, given: DataFrame, claims: DataFrame) -> DataFrame:
    """Answers (answer, text, citations) with ``reasons``: those of their claims, no claim, a claim id twice, citations that are
    not those of the claims, numbers of the text that no claim lists. ``claims`` is the result of ``verified_claims``."""
    none = F.array().cast(TEXTS)
    got = claims.groupBy("answer").agg(
        F.count("*").alias("_claims"), F.countDistinct("claim").alias("_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("_of_claims"),
        F.array_distinct(F.flatten(F.collect_list("citations"))).alias("_cited"), F.array_distinct(F.array_compact(F.flatten(F.collect_list(numbers_of("numbers"))))).alias("_numbers"),
    )
    met = answers.withColumn("citations", listed("citations")).join(given.select("answer", "admitted"), "answer", "left").join(got, "answer", "left")
    cited, numbers = F.coalesce("_cited", none), numbers_of(prose_numbers(F.coalesce("text", F.lit("")), none, none))
    astray = (F.size("citations") == 0) | ~within(F.col("citations"), listed("admitted")) | ~within(F.col("citations"), cited) | ~within(cited, F.col("citations"))
    own = all_failures(
        ("claim_missing", F.coalesce("_claims", F.lit(0)) == 0), ("claim_id_duplicate", F.col("_claims") > F.col("_ids")), ("top_level_citations_mismatch", astray),
        ("prose_number_unlisted", ~within(F.array_compact(numbers), F.coalesce("_numbers", none))),
    )
    return met.select(*answers.columns, F.array_distinct(F.concat(F.coalesce("_of_claims", none), own)).alias("reasons"))
