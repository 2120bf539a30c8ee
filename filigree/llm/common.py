"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a class of a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """True for rows that nothing may be learned from: those of the remainder, and those without an id."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(True))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows, never more: those with the smallest hash of ``key``, which tells rows apart.

    The hash border is set from the row count first, so that no task hands on more than its
    share; a plain top-k would send ``most`` rows of every task to one place. A key that repeats
    would make the border miss: few values may all lie above it.
    """
    n = rows.count()
    cell = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    if n > most:
        rows = rows.filter(cell < int((1 << 30) * most / n))
    return rows.orderBy(cell, key).limit(most)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(column: pa.Array) -> Iterator[str]:
    """The values of an Arrow string column, one at a time, null as the empty text."""
    for x in column:
        yield x.as_py() or ""


def small_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = size = 0
        for i, x in enumerate(batch.column(batch.schema.get_field_index(text))):
            n = len(x.as_buffer()) if x.is_valid else 0
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
