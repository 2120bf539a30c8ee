"""Quality assertions: each is a frame of issues (rule_id, severity, entity_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, rule: str, severity: str, entity: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), entity.cast("string").alias("entity_id"))


def violates(rows: DataFrame, rule: str, severity: str, entity: str, condition: Column) -> DataFrame:
    """Q2, Q3, Q4: rows for which the condition holds."""
    return issues(rows.filter(condition), rule, severity, F.col(entity))


def orphans(rows: DataFrame, parents: DataFrame, rule: str, entity: str, on: Column) -> DataFrame:
    """Rows without a parent."""
    return issues(rows.join(parents, on, "left_anti"), rule, "error", F.col(entity))


def not_exactly_one(rows: DataFrame, rule: str, key: str, condition: Column) -> DataFrame:
    """Q6: keys for which the condition does not hold exactly once."""
    return issues(rows.groupBy(key).agg(F.sum(condition.cast("int")).alias("_n")).filter("_n <> 1"), rule, "error", F.col(key))


def collisions(grains: list[DataFrame], rule: str, key: str) -> DataFrame:
    """Q7: keys that occur more than once over several grains."""
    both = reduce(DataFrame.unionAll, [g.select(key) for g in grains])
    return issues(both.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1"), rule, "error", F.col(key))


def report(parts: list[DataFrame]) -> DataFrame:
    """All issues with a stable id."""
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("issue_id", F.substring(F.sha2(F.concat_ws("\x1f", "rule_id", "entity_id").cast("binary"), 256), 1, 24))


def leaks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Q12: keys that two splits share."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
