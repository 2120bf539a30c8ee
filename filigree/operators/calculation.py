"""Exact-decimal calculations over facts."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An operand holds 22 digits before the point and six after it; a result has six places, rounded once, half away from zero.
OPERAND = "decimal(28,6)"
RESULT = "decimal(38,6)"
#: Operations on (base, subject); beside them ``lookup`` takes one operand and ``sum`` any number from one.
OPERATIONS = ("sum", "difference", "ratio", "percentage_ratio", "growth_rate")


def money(x: str) -> Column:
    return F.col(x).cast("decimal(18,2)")


def calculate(operation: str, *operands: Column) -> Column:
    """struct(value decimal(38,6), reason) of numbers or texts of numbers, in exact decimals.

    Reasons, in order: ``missing_operand`` (null), ``not_exact`` (no number, or one beyond the digits of an
    operand), ``zero_base``, ``out_of_range`` (the result has too many digits). With a reason there is no value.
    Spark gives a quotient of these widths six places in one rounding, so no value passes through a double.
    """
    least, most = {"lookup": (1, 1), "sum": (1, len(operands))}.get(operation, (2, 2))
    if operation not in (*OPERATIONS, "lookup"):
        raise ValueError(f"operation must be lookup, {', '.join(OPERATIONS)}")
    if not least <= len(operands) <= most:
        raise ValueError(f"{operation} does not take {len(operands)} operands")
    exact = [x.try_cast(OPERAND) for x in operands]
    inexact = reduce(or_, [~F.coalesce(d == x.try_cast("decimal(38,16)"), F.lit(False)) for d, x in zip(exact, operands, strict=True)])
    base, subject = exact[0], exact[-1]
    zero = F.lit(False)
    if operation in ("lookup", "sum"):
        value = reduce(F.try_add, exact)
    elif operation == "difference":
        value = F.try_subtract(subject, base)
    else:
        zero = base == 0
        over = {"ratio": lambda: subject.cast("decimal(32,6)"), "percentage_ratio": lambda: subject * F.lit(Decimal(100)), "growth_rate": lambda: (subject - base) * F.lit(Decimal(100))}[operation]
        value = F.try_divide(over(), base)
    value = value.try_cast(RESULT)
    missing = reduce(or_, [x.isNull() for x in operands])
    reason = F.when(missing, "missing_operand").when(inexact, "not_exact").when(zero, "zero_base").when(value.isNull(), "out_of_range")
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def extremes(rows: DataFrame, key: list[str], who: str, value: str) -> DataFrame:
    """Per key the largest value, who has it, and whether it is a tie."""
    top = rows.groupBy(*key).agg(F.max(value).alias("_top"))
    return rows.join(top, key).filter(F.col(value) == F.col("_top")).groupBy(*key).agg(
        F.max(value).alias("top_value"), F.min(who).alias("winner"), (F.count("*") > 1).alias("tie")
    )


def compare_axes(facts: DataFrame, axes: list[str], value: str, required: dict[str, list[str]] | None = None) -> DataFrame:
    """X17 along every axis at once: facts that agree in all axes but one are compared along that one.

    Each row of the result has ``compared`` (the axis), the other axes (the compared one is null), ``members``
    (distinct ones with one value), ``missing`` (members that ``required`` lists for the axis and that have no one
    value, in order, comma-joined), ``ambiguous`` (members with several different values; a value that is null is
    none), ``top_value``, ``tie``, ``status`` and ``winner``. The status is ``incomplete`` if a member is missing
    or ambiguous, else ``single`` for fewer than two, else ``complete``; only a complete comparison without a tie
    has a winner. Axes become text; a null one is the empty text.

    Each fact becomes one row per axis and all axes are aggregated together: one shuffle of partial results beyond
    that of the facts, no join, nothing collected but members that ``required`` lists.
    """
    lists = {a: sorted(set(v)) for a, v in (required or {}).items()}
    if unknown := sorted(set(lists) - set(axes)):
        raise ValueError(f"no such axis: {', '.join(unknown)}")
    text = facts.select(*[F.coalesce(F.col(a).cast("string"), F.lit("")).alias(a) for a in axes], F.col(value).alias("_v"))
    grain = text.groupBy(*axes).agg(F.min("_v").alias("_v"), (F.min("_v") < F.max("_v")).alias("_several"))
    some = F.lit(None).cast("string")
    along = [F.struct(F.lit(a).alias("compared"), F.col(a).alias("_member"), *[(some if b == a else F.col(b)).alias(b) for b in axes]) for a in axes]
    each = grain.select(F.explode(F.array(*along)).alias("_a"), "_v", F.coalesce("_several", F.lit(False)).alias("_several")).select("_a.*", "_several", F.when(~F.col("_several"), F.col("_v")).alias("_v"))
    asked = reduce(lambda c, a: c.when(F.col("compared") == a, F.array(*[F.lit(m) for m in lists[a]])), lists, F.when(F.lit(False), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    there, who = F.col("_v").isNotNull(), F.col("_member")
    found = each.groupBy("compared", *axes).agg(
        F.count("_v").alias("members"), F.sum(F.col("_several").cast("long")).alias("ambiguous"), F.max("_v").alias("top_value"),
        F.min_by(who, F.when(there, F.struct(-F.col("_v"), who))).alias("_first"), F.max_by(who, F.when(there, F.struct(F.col("_v"), who))).alias("_last"),
        F.collect_set(F.when(there & F.array_contains(asked, who), who)).alias("_held"),
    )
    done = found.withColumns({"missing": F.array_join(F.array_except(asked, F.col("_held")), ","), "tie": F.coalesce(F.col("_first") != F.col("_last"), F.lit(False))})
    open_ = (F.col("missing") != "") | (F.col("ambiguous") > 0)
    done = done.withColumn("status", F.when(open_, "incomplete").when(F.col("members") < 2, "single").otherwise("complete"))
    return done.withColumn("winner", F.when((F.col("status") == "complete") & ~F.col("tie"), F.col("_first"))).drop("_first", "_last", "_held")


def identity_gap(rows: DataFrame, key: list[str], account: str, value: str, whole: str, parts: list[str]) -> DataFrame:
    """Whole minus its parts per key; null where an account is missing."""
    one = lambda name: F.sum(F.when(F.col(account) == name, F.col(value)))
    gap = one(whole)
    for p in parts:
        gap = gap - one(p)
    return rows.groupBy(*key).agg(gap.alias("gap"))


def same_grain(rows: DataFrame, group: str, grain: list[str]) -> DataFrame:
    """Whether all facts of a group share company, scope and period."""
    return rows.groupBy(group).agg((F.countDistinct(F.struct(*grain)) == 1).alias("same_grain"))


def premise_check(claimed: Column, before: Column, after: Column) -> Column:
    """Does the claimed direction (-1, 0, 1) hold?"""
    return F.signum(after - before) == claimed
