"""Joins, aggregates, windows and top-k forms that the engine's queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- joins --------------------------------------------------------------------------------


def following_pairs(left: DataFrame, right: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Distinct pairs of the same keys whose right place comes after the left."""
    r = right.select(*keys, F.col(place).alias(f"{place}_after"), *[F.col(c).alias(f"{c}_after") for c in right.columns if c not in [*keys, place]])
    return left.join(r, keys).filter(F.col(f"{place}_after") > F.col(place)).distinct()


def band_join(left: DataFrame, right: DataFrame, key: str, place: str, before: int, after: int) -> DataFrame:
    """Right rows of the same key whose place lies in [place - before, place + after] of the left.

    Places are cut in cells of the band's width, so the join is one of equality on (key, cell)
    and a row meets three cells at most.
    """
    width = before + after + 1
    cell = F.floor(F.col(place) / width)
    near = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    r = right.select(F.col(key).alias("_key"), F.col(place).alias(f"{place}_near"), *[F.col(c).alias(f"{c}_near") for c in right.columns if c not in (key, place)])
    r = r.withColumn("_cell_near", F.floor(F.col(f"{place}_near") / width))
    met = near.join(r, (near[key] == r["_key"]) & (near["_cell"] == r["_cell_near"]))
    return met.filter(F.col(f"{place}_near").between(F.col(place) - before, F.col(place) + after)).drop("_cell", "_cell_near", "_key")


def missing_grains(keys: DataFrame, grains: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Every (key, grain) that should be there and is not; ``grains`` is a short list of constants."""
    return keys.crossJoin(F.broadcast(grains)).join(actual.select(*on).distinct(), on, "left_anti")


def exactly_one(requirements: DataFrame, facts: DataFrame, on: list[str], value: str) -> DataFrame:
    """Per requirement its value where exactly one fact matches, else the reason."""
    found = facts.groupBy(*on).agg(F.count("*").alias("_n"), F.min(value).alias(value))
    n = F.coalesce("_n", F.lit(0))
    return requirements.join(found, on, "left").select(
        *requirements.columns,
        F.when(n == 1, F.col(value)).alias(value),
        F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("ok").alias("match_status"),
    )


def merge_sides(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer merge of two streams by key; a side that is missing counts as empty."""
    return a.join(b, on, "full")


# ---- aggregates ---------------------------------------------------------------------------

BUCKETS = {"day": "day", "week": "week", "month": "month"}


def time_buckets(rows: DataFrame, at: str, bucket: str) -> DataFrame:
    """A2: rows per day, week from Monday, or month."""
    return rows.groupBy(F.date_trunc(BUCKETS[bucket], F.col(at)).cast("date").alias("bucket")).agg(F.count("*").alias("n"))


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """A10: the first row per key in the given order."""
    return top_per_key(rows, key, order, 1)


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key (a partial limit runs before the shuffle)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def ranked_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Every row with its number within its key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def reject_conflicts(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of keys on whose values all rows agree; the others go as a whole."""
    agreed = rows.groupBy(*key).agg(F.countDistinct(F.struct(*values)).alias("_kinds")).filter("_kinds = 1").drop("_kinds")
    return rows.join(agreed, key, "left_semi")


def reject_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    single = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(single, key, "left_semi")


def resolve_by_priority(rows: DataFrame, key: list[str], priority: str, value: str) -> DataFrame:
    """Per key the value at the smallest priority if it is one value, else the reason."""
    lowest = rows.groupBy(*key).agg(F.min(priority).alias(priority))
    best = rows.join(lowest, [*key, priority])
    return best.groupBy(*key).agg(
        F.min(priority).alias(priority),
        F.when(F.countDistinct(value) == 1, F.min(value)).alias(value),
        F.when(F.countDistinct(value) > 1, "conflict").when(F.count("*") > 1, "duplicate").otherwise("unique").alias("resolution"),
    )


def coverage(keys: DataFrame, accounts: DataFrame, actual: DataFrame, key: str, account: str) -> DataFrame:
    """Per key how many accounts it has, which it lacks, and whether it is complete."""
    have = actual.select(key, account).distinct().withColumn("_there", F.lit(True))
    grid = keys.crossJoin(F.broadcast(accounts)).join(have, [key, account], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    return grid.groupBy(key).agg(
        F.sum(F.col("_there").cast("int")).alias("present"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("_there"), F.col(account)))), ",").alias("missing"),
        F.bool_and("_there").alias("complete"),
    )


def percentile_linear(x: str, q: float) -> Column:
    """Linear interpolation, empty counts as 0."""
    return F.coalesce(F.percentile(x, q), F.lit(0.0))


def percentile_nearest(x: str, q: float) -> Column:
    """Nearest rank, the smallest value that at least the share ``q`` does not exceed."""
    return F.expr(f"percentile_disc({q}) within group (order by `{x}`)")


def percentile_by_index(x: str, q: float) -> Column:
    """The value at zero-based position int(q n), for bounded groups."""
    values = F.array_sort(F.collect_list(x))
    return F.coalesce(F.element_at(values, F.least(F.floor(F.size(values) * q) + 1, F.size(values)).cast("int")), F.lit(0.0))


def value_by_index(rows: DataFrame, group: str, x: str, q: float) -> DataFrame:
    """A18 for groups of any size: per group the value at zero-based position int(q n), by counting equal values.

    Equal values become one row in each task, so what a group's running count sorts is its different values.
    """
    counts = rows.filter(F.col(x).isNotNull()).groupBy(group, x).agg(F.count("*").alias("_n"))
    total = counts.groupBy(group).agg(F.sum("_n").alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    place = F.least(F.floor(F.col("_total") * q) + 1, F.col("_total"))
    met = counts.withColumn("_upto", upto).join(total, group).filter(F.col("_upto") >= place)
    return met.groupBy(group).agg(F.min(x).alias("value"))


def percentile_nearest_rounded(x: str, q: float, places: int) -> Column:
    """Nearest rank, rounded; null where there is nothing."""
    return F.round(percentile_nearest(x, q), places)


def percentile_mixed(x: str, q: float) -> Column:
    """Nearest rank from 0.95 on, below it linear and rounded to two places; null where there is nothing."""
    return percentile_nearest(x, q) if q >= 0.95 else F.round(F.percentile(x, q), 2)


def equal_multisets(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """U5 for keys of any size: whether two columns hold the same values equally often per key, by counts that cancel."""
    both = rows.select(key, F.explode(F.array(F.struct(a.alias("v"), F.lit(1).alias("n")), F.struct(b.alias("v"), F.lit(-1).alias("n")))).alias("e"))
    left = both.groupBy(key, "e.v").agg(F.sum("e.n").alias("n"))
    return left.groupBy(key).agg(F.bool_and(F.col("n") == 0).alias("equal"))


def disagreeing_groups(rows: DataFrame, group: str, signature: str) -> DataFrame:
    """Groups whose members do not share one signature."""
    return rows.groupBy(group).agg(F.count("*").alias("members"), F.countDistinct(signature).alias("signatures")).filter("signatures > 1")


# ---- windows ------------------------------------------------------------------------------


def stratified_sample(rows: DataFrame, strata: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every stratum."""
    return top_per_key(rows, strata, order, k)


def change_over_periods(rows: DataFrame, key: list[str], period: str, value: str) -> DataFrame:
    """Difference to the period before, and growth in percent of it (null for a zero base)."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(period))
    return rows.withColumn("previous", before).withColumns(
        {"difference": F.col(value) - F.col("previous"), "growth": F.when(F.col("previous") != 0, F.round((F.col(value) - F.col("previous")) / F.col("previous") * 100, 4))}
    )


def term_years(rows: DataFrame, key: str, term: str, year: str) -> DataFrame:
    """The calendar year of a column by its term: year - (largest term of the table - term)."""
    return rows.withColumn("term_year", F.col(year) - (F.max(term).over(Window.partitionBy(key)) - F.col(term)))


def bounded_context(rows: DataFrame, key: str, order: list[Column], text: str, most: int) -> DataFrame:
    """The texts of a key in order up to ``most`` characters, the last one cut."""
    before = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < most)
    return kept.withColumn("excerpt", F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("_before")).cast("int"))).drop("_before")
