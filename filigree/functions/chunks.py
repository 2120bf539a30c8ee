"""Tokens, prefixes, packed chunks of long texts and of tables, and their quality."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
TARGET, MOST, OVERLAP = 450, 700, 80
SCHEMA = "doc long, ordinal int, first_token int, n_tokens int, chunk_id string, text string"


def tokens(text: str) -> Column:
    """Runs of word characters, and other characters one by one."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])"))


def prefix(section: Column, caption: Column | None = None, header: Column | None = None, unit: Column | None = None) -> Column:
    """The lines before a chunk: its section, and for tables caption, header and unit."""
    named = lambda name, x, none: F.concat(F.lit(f"{name}: "), F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(x))
    lines = [named("Section", F.array_join(section, " > "), "<root>")]
    if caption is not None:
        lines += [named("Caption", caption, "<none>"), named("Header", header, "<none>"), named("Unit", unit, "<none>")]
    return F.concat_ws("\n", *lines)


def quality(kind: Column, source_status: Column, table_status: Column | None = None) -> Column:
    """Verified unless the source is a PDF or a parse did not succeed."""
    good = (kind != "pdf") & (source_status == "success")
    if table_status is not None:
        good &= table_status == "success"
    return F.when(F.coalesce(good, F.lit(False)), "verified").otherwise("unverified")


def table_units(grid: DataFrame) -> DataFrame:
    """C4: (page_id, table_no, header, row_index, text): the header is the distinct texts of the rows before the first with
    data, the body the joined texts of every row from there on; tables without data have no row."""
    key = ["page_id", "table_no"]
    filled = grid.filter("text <> ''")
    first = filled.filter("cell_kind = 'data'").groupBy(*key).agg(F.min("row_index").alias("first_row"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"])
    place = F.struct("row_index", "column_index", "text")
    met = filled.join(first, key)
    header = met.filter("row_index < first_row").groupBy(*key).agg(F.array_join(F.array_distinct(ordered(place)), " | ").alias("header"))
    body = met.filter("row_index >= first_row").groupBy(*key, "row_index").agg(F.array_join(ordered(F.struct("column_index", "text")), " | ").alias("text"))
    return body.join(header, key, "left").select(*key, F.coalesce("header", F.lit("")).alias("header"), "row_index", "text")


def cut(units: list[int], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, before: int = 0) -> list[tuple[int, int]]:
    """(first token, end) of chunks over units of the given token counts; ``before`` tokens of prefix count in every chunk.

    Whole units are added while the chunk stays within the target; the unit that passes it still belongs to
    the chunk if it fits the limit, else as much of it as fits, and the chunk ends. The next one starts
    ``overlap`` tokens back.
    """
    ends = list(accumulate(units))
    total = ends[-1] if ends else 0
    limit = most - before
    if limit <= 0:
        raise ValueError("the prefix leaves no room")
    goal = min(limit, target - before) if target > before else limit
    overlap = min(overlap, max(0, goal - 1))
    out, start, at = [], 0, 0
    while at < total:
        passing = bisect_right(ends, start + goal)  # the first unit that ends beyond the target
        stop = min(ends[passing] if passing < len(ends) else total, start + limit, total)
        out.append((start, stop))
        at = stop
        start = stop - overlap
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every document; lines are the units. Documents are cut one at a time, in place."""
    config = hashlib.sha256(f"{target}/{most}/{overlap}".encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans, units = [], []
                at = 0
                for line in (body or "").split("\n"):
                    found = [(at + m.start(), at + m.end()) for m in TOKEN.finditer(line)]
                    spans += found
                    units.append(len(found))
                    at += len(line) + 1
                for n, (a, b) in enumerate(cut(units, target, most, overlap)):
                    part = body[spans[a][0] : spans[b - 1][1]]
                    digest = hashlib.sha256(f"{config}\x1f{doc}\x1f{n}\x1f{part}".encode()).hexdigest()[:32]
                    for column, value in zip(rows, (doc, n, a, b - a, f"chk_{digest}", part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=names)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, SCHEMA)
