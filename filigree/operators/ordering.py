"""Global order without a global sort task: row numbers and neighbours over ranges of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import materialize


def in_ranges(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` with the range number ``_range``, as a written table.

    The ranges are sampled by Spark; equal keys share a range, so ``order`` should end in a
    column that tells rows apart if a key may repeat without bound.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """``rows`` with their number from 0 in the order: a number within the range and the rows of the ranges before.

    Only the row counts of the ranges, one per shuffle partition, reach the driver.
    """
    dealt = in_ranges(rows, order, parts)
    before, total = [], 0
    for r in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        before.append((r["_range"], total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(before or [(0, 0)], "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def with_previous(rows: DataFrame, order: list[str], name: str = "previous", parts: int | None = None) -> DataFrame:
    """``rows`` with the struct of the row before in the order; the first row gets the last one's.

    The last row of every range, one per shuffle partition, passes the driver.
    """
    dealt = in_ranges(rows, order, parts)
    columns = rows.columns
    one = F.struct(*columns)
    lasts = dealt.groupBy("_range").agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("last")).orderBy("_range").collect()
    entry = [(r["_range"], *(lasts[k - 1]["last"][c] for c in columns)) for k, r in enumerate(lasts)]
    schema = dealt.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_last_{c}") for c in columns]).schema
    starts = rows.sparkSession.createDataFrame(entry, schema)
    lag = F.lag(one).over(Window.partitionBy("_range").orderBy(*order))
    met = dealt.withColumn("_lag", lag).join(F.broadcast(starts), F.col("_range") == F.col("_at"))
    return met.withColumn(name, F.coalesce("_lag", F.struct(*[F.col(f"_last_{c}").alias(c) for c in columns]))).select(*columns, name)
