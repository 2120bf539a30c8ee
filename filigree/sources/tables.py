"""Manifests, file discovery, verified and resumable sinks, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields that every manifest row must have.
MANIFEST = (
    "doc_id string, corp_code string, corp_name string, listed_name string, stock_code string, industry string, sector string, "
    "doc_group string, doc_subtype string, report_nm string, is_correction boolean, rcept_no string, rcept_dt string, "
    "flr_nm string, base_year int, base_month int, file_path string, file_format string, n_files int"
)
REQUIRED = ["doc_id", "corp_code", "doc_group", "report_nm", "rcept_no", "rcept_dt", "file_path", "n_files"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; missing fields or repeated keys raise."""
    rows = spark.read.schema(MANIFEST).json(path)
    lacking = rows.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in REQUIRED]).first()
    if bad := [c for c in REQUIRED if lacking[c]]:
        raise ValueError(f"manifest rows lack {', '.join(bad)}")
    for key in ("doc_id", "rcept_no"):
        if rows.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"manifest repeats a {key}")
    return rows


def discover_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, size, time and SHA-256 of the files that match."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def file_count_mismatches(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Documents whose number of files is not the declared one."""
    found = files.groupBy(key).agg(F.count("*").alias("found"))
    return manifest.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found <> n_files")


def replace_table(df: DataFrame, path: str) -> int:
    """Write beside the target, verify the count, then swap; the former version stays as .previous."""
    spark = df.sparkSession
    temp, previous = f"{path}.writing", f"{path}.previous"
    df.write.mode("overwrite").parquet(temp)
    rows = spark.read.parquet(temp).count()
    if rows != df.count():
        raise RuntimeError("the written table does not have the rows of its source")
    jvm = spark.sparkContext._jvm
    as_path = jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(as_path(path)):
        fs.delete(as_path(previous), True)
        fs.rename(as_path(path), as_path(previous))
    if not fs.rename(as_path(temp), as_path(path)):
        raise RuntimeError(f"could not move the new table to {path}")
    return rows


def export_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Ordered JSON lines (ranges of the order, one file each)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def compare_counts(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows per key before and after a migration, where they differ."""
    a, b = (d.groupBy(*key).agg(F.count("*").alias(n)) for d, n in ((before, "before"), (after, "after")))
    both = a.join(b, key, "full").na.fill(0, ["before", "after"])
    return both.filter("before <> after")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions of ``by`` that ``df`` has; running the job again gives the same table."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_missing(df: DataFrame, path: str, key: str, done: DataFrame | None = None) -> DataFrame:
    """Append the rows whose key the table lacks, one per key, and return the table.

    ``done`` is the table as it stands (None where there is none yet). A run that failed leaves
    no half-written rows, because the append commits as a whole; the next run adds the rest.
    """
    new = df.dropDuplicates([key])
    if done is not None:
        new = new.join(done.select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
