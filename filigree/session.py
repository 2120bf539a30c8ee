"""Session factory, table loading and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

#: Own setting for the folder of intermediate tables, used where spark.checkpoint.dir is unset.
TABLES_DIR = "filigree.tables.dir"


def build_session(app: str = "filigree", cpus: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE and skew-join handling on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Only Spark's reader opens the path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [load_table(spark, sf_dir, n) for n in names]


def tables_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else ``filigree.tables.dir``.

    Where neither is set a temporary folder serves a local master; on a cluster that would be
    one machine's disk, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(TABLES_DIR, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set spark.checkpoint.dir or {TABLES_DIR} to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set(TABLES_DIR, root)
    return root


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation, and
    a value that must not change between uses (a row id) is fixed.
    """
    path = f"{tables_root(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table that ``materialize`` returned and that nothing reads any more."""
    path = getattr(df, "_table_path", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first of wanted_1, wanted_2, … that ``df`` has no column of (case ignored)."""
    taken = {c.lower() for c in df.columns}
    names = [wanted, *(f"{wanted}_{k}" for k in range(1, len(taken) + 2))]
    return next(n for n in names if n.lower() not in taken)
