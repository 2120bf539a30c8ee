"""Compare a Spark result with its SQL on DuckDB, as sets of rows with columns in name order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

from filigree.session import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(round(x, 4)) + 0.0
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs."""
    spark_side = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    other = rows_of([c[0] for c in cur.description], cur.fetchall())
    if spark_side[0] != other[0]:
        return f"columns {spark_side[0]} and {other[0]}"
    if len(spark_side[1]) != len(other[1]):
        return f"{len(spark_side[1])} and {len(other[1])} rows"
    bad = [(a, b) for a, b in zip(spark_side[1], other[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
