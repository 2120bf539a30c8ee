"""Version lineage: chains, validity intervals, policies, as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("current", "original", "corrected", "both")


def version_chain(rows: DataFrame, event: str, at: str, key: str) -> DataFrame:
    """Number the versions of each event and give each its half-open validity interval."""
    order = Window.partitionBy(event).orderBy(at, key)
    return rows.withColumns(
        {
            "version_no": F.row_number().over(order),
            "parent_id": F.lag(key).over(order),
            "effective_from": F.col(at),
            "effective_to": F.lead(at).over(order),
            "is_current": F.lead(key).over(order).isNull(),
        }
    )


def in_force(as_of: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Start <= as_of < end, an open end never passing."""
    return (F.col(start) <= as_of) & (F.col(end).isNull() | (as_of < F.col(end)))


def version_predicate(policy: str = "current", as_of: Column | None = None, upper_bound_for_both: bool = False) -> Column:
    """rows a correction policy admits, over version_no, is_current and the interval."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    lower = F.lit(True) if as_of is None else F.col("effective_from") <= as_of
    interval = F.col("is_current") if as_of is None else in_force(as_of)
    if policy == "original":
        return (F.col("version_no") == 1) & (F.lit(True) if as_of is None else in_force(as_of))
    if policy == "corrected":
        return interval & (F.col("version_no") > 1)
    if policy == "both":
        return in_force(as_of) if as_of is not None and upper_bound_for_both else lower
    return interval


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, at: str) -> DataFrame:
    """J12 over a table of dates: each fact with the version in force at its date, or none.

    An equality join on the key with the interval as residual condition: no cross product.
    """
    return facts.join(versions, (facts[key] == versions[key]) & (versions["effective_from"] <= facts[at]) & (versions["effective_to"].isNull() | (facts[at] < versions["effective_to"])), "left")


def unique_original(corrections: DataFrame, originals: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Link a correction to its original only where exactly one original matches."""
    found = originals.groupBy(*keys).agg(F.count("*").alias("matches"), F.min(id_column).alias("original_id"))
    joined = corrections.join(found, keys, "left")
    status = F.when(F.coalesce("matches", F.lit(0)) == 1, "resolved").when(F.col("matches") > 1, "unresolved").otherwise("missing_original")
    return joined.withColumns({"lineage_status": status, "original_id": F.when(F.col("matches") == 1, F.col("original_id"))}).drop("matches")


def lineage_summary(chain: DataFrame, event: str, at: str, key: str) -> DataFrame:
    """Per event its versions, its first and current row and its span."""
    return chain.groupBy(event).agg(
        F.count("*").alias("versions"),
        F.min_by(key, "version_no").alias("root_id"),
        F.max_by(key, "version_no").alias("current_id"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
    )


def largest_event(chain: DataFrame, owner: str, event: str) -> DataFrame:
    """Per owner the event with most versions, ties to the largest event id."""
    sizes = chain.groupBy(owner, event).agg(F.count("*").alias("versions"))
    return sizes.groupBy(owner).agg(F.max(F.struct("versions", event)).alias("top")).select(owner, f"top.{event}", "top.versions")


def all_of(conditions: list[Column | None]) -> Column:
    """F8: AND of the filters that are given."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def any_equal(value: Column, *columns: str) -> Column:
    """value equals one of several alias columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == value, F.lit(False)) for c in columns])


def has_any_term(terms: list[str], *columns: str) -> Column:
    """a term occurs in a column, ASCII case ignored."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(t.lower()), F.lit(False)) for t in terms for c in columns])
