"""Markup pages to narrative fragments, table cells and key-value facts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.text import BLANKS, first_date

HEADINGS = {"title", "h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "li", "td", "th", "pre", "blockquote", "caption"}
SILENT = {"script", "style", "noscript"}


class Page(HTMLParser):
    """Fragments and table cells of one page, in document order; malformed markup is read as far as it goes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.fragments: list[tuple[str, str, str]] = []
        self.cells: list[tuple[int, int, int, str, int, int, str]] = []
        self.path: list[str] = []
        self.open: list[tuple[str, list[str], dict]] = []
        self.silent = self.tables = 0
        self.stack: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag == "table":  # ends a paragraph or item whose end tag is left out
            while self.open and self.open[-1][0] in ("p", "li"):
                self.end_block()
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.stack.append({"no": self.tables, "row": -1, "taken": []})
            self.tables += 1
        elif tag == "tr" and self.stack:
            self.stack[-1]["row"] += 1
        elif tag in BLOCKS:
            self.open.append((tag, [], dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.stack:
            self.stack.pop()
        elif any(tag == t for t, _, _ in self.open):
            while self.open and self.end_block() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent and self.open:
            self.open[-1][1].append(data)

    def finish(self) -> None:
        """End of input: what is still open ends here."""
        super().close()
        while self.open:
            self.end_block()

    def end_block(self) -> str:
        tag, parts, attrs = self.open.pop()
        text = " ".join("".join(parts).split())
        if tag in ("td", "th") and self.stack:
            self.place(tag, text, attrs)
        elif text:
            if tag in HEADINGS:
                level = int(tag[1]) if tag[1:].isdigit() else 1
                self.path = [*self.path[: level - 1], text]
                self.fragments.append(("heading", " > ".join(self.path), text))
            else:
                self.fragments.append(("paragraph", " > ".join(self.path), text))
        return tag

    def place(self, tag: str, text: str, attrs: dict) -> None:
        """The first free column of the row, and the places that the spans take, as (column, end column, end row)."""
        table = self.stack[-1]
        table["row"] = max(0, table["row"])
        down, across = span(attrs.get("rowspan")), span(attrs.get("colspan"))
        row, col = table["row"], 0
        table["taken"] = sorted(t for t in table["taken"] if t[2] > row)
        for first, end, _ in table["taken"]:
            if first <= col < end:
                col = end
        table["taken"].append((col, col + across, row + down))
        self.cells.append((table["no"], row, col, "header" if tag == "th" else "data", down, across, text))


def span(value: str | None) -> int:
    """A span as a whole number from 1 on; anything else counts as 1."""
    bare = (value or "").strip()
    return max(1, int(bare)) if bare.isascii() and bare.isdigit() and len(bare) < 10 else 1


FRAGMENT = "page_id long, sequence_no int, fragment_type string, section_path string, text string"
CELL = "page_id long, table_no int, row_index int, column_index int, cell_kind string, rowspan int, colspan int, text string"


def _parsed(pages: DataFrame, what: str, schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page()
                page.feed(html or "")
                page.finish()
                found = [(n, *f) for n, f in enumerate(page.fragments)] if what == "fragments" else page.cells
                for values in found:
                    for column, value in zip(rows, (page_id, *values)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, kinds[k]) for r, (_, k) in zip(rows, fields)], names=[n for n, _ in fields])

    return pages.select("page_id", "html").mapInArrow(run, schema)


def fragments(pages: DataFrame) -> DataFrame:
    """Headings and paragraphs with their section path."""
    return _parsed(pages, "fragments", FRAGMENT)


def cells(pages: DataFrame) -> DataFrame:
    """Table cells at their grid places."""
    return _parsed(pages, "cells", CELL)


def header_paths(grid: DataFrame) -> DataFrame:
    """Per data cell the header texts above it and to its left, nearest last."""
    key = ["page_id", "table_no"]
    heads = grid.filter("cell_kind = 'header' and text <> ''").select(
        *key, F.col("row_index").alias("hr"), F.col("column_index").alias("hc"), F.col("rowspan").alias("hd"), F.col("colspan").alias("ha"), F.col("text").alias("head")
    )
    data = grid.filter("cell_kind = 'data'")
    met = data.join(heads, key, "left")
    above = (F.col("hr") < F.col("row_index")) & (F.col("column_index") >= F.col("hc")) & (F.col("column_index") < F.col("hc") + F.col("ha"))
    left = (F.col("hc") < F.col("column_index")) & (F.col("row_index") >= F.col("hr")) & (F.col("row_index") < F.col("hr") + F.col("hd"))

    def path(condition: Column, place: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(place, "head")))), lambda x: x["head"]))

    return met.groupBy(*key, "row_index", "column_index", "text").agg(path(above, "hr").alias("column_path"), path(left, "hc").alias("row_path"))


def key_value_facts(grid: DataFrame, least: int = 2, most: int = 6, longest: int = 120) -> DataFrame:
    """Rows of two to six non-empty cells as (predicate, joined values); the predicate has 120 characters at most and is not the value."""
    rows = grid.filter("text <> ''").groupBy("page_id", "table_no", "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "text"))).alias("c"))
    rows = rows.filter(F.size("c").between(least, most)).withColumn("t", F.transform("c", lambda x: x["text"]))
    facts = rows.select("page_id", "table_no", "row_index", F.element_at("t", 1).alias("predicate"), F.array_join(F.slice("t", 2, most), " | ").alias("value"))
    return facts.filter((F.length("predicate") <= longest) & (F.col("value") != "") & (F.col("predicate") != F.col("value")))


def promote_labels(grid: DataFrame, periodic: bool = False) -> DataFrame:
    """In documents that are not periodic the first filled cell of a row becomes its header, if it stands in column 0 and has
    no digit, the row has two filled cells or more, and none of them is a header already."""
    if periodic:
        return grid
    row = Window.partitionBy("page_id", "table_no", "row_index")
    filled = F.col("text") != ""
    first = F.min(F.when(filled, F.col("column_index"))).over(row) == F.col("column_index")
    plain = (F.count_if(filled).over(row) >= 2) & ~F.coalesce(F.bool_or(filled & (F.col("cell_kind") == "header")).over(row), F.lit(False))
    label = filled & first & (F.col("column_index") == 0) & plain & ~F.col("text").rlike(r"\p{Nd}")
    return grid.withColumn("cell_kind", F.when(label, "header").otherwise(F.col("cell_kind")))


# The sign of a unit, what may part it from the unit, what ends one.
UNIT_SIGN, UNIT_PARTS, UNIT_ENDS = "단위", ":：", "()[],"


def named_unit(text: Column, most: int = 20) -> Column:
    """The unit that follows its sign, behind a colon or an opening bracket, of ``most`` characters; of several signs the first with a unit."""
    behind = F.slice(F.split(text, UNIT_SIGN, -1), 2, 1 << 20)
    behind = F.transform(behind, lambda x: F.ltrim(F.ltrim(x, F.lit(BLANKS + UNIT_PARTS)), F.lit("(")))
    units = F.transform(behind, lambda x: F.trim(F.substring(F.split(x, f"[{re.escape(UNIT_ENDS)}]", 2)[0], 1, most)))
    return F.get(F.filter(units, lambda x: x != ""), F.lit(0))


def unit_and_caption(blocks: DataFrame) -> DataFrame:
    """(page_id, table_no, unit, caption) of tables. ``blocks`` (page_id, sequence_no, kind, table_no, declared_unit, text) are a page's
    blocks in order; a table's unit is its own declared one, else named by one of the four blocks before it; its caption is the nearest of
    the three before it that has text and is a paragraph or title. What holds a date or says as of when (현재, 기준) is no unit; the next is tried."""
    w = Window.partitionBy("page_id").orderBy("sequence_no")
    usable = lambda u: F.when((u != "") & ~u.contains("현재") & ~u.contains("기준") & first_date(u).isNull(), u)
    named = lambda k: usable(named_unit(F.lag("text", k).over(w)))
    titled = lambda k: F.when(F.lag("kind", k).over(w).isin("paragraph", "title", "heading"), F.nullif(F.substring(F.lag("text", k).over(w), 1, 500), F.lit("")))
    made = blocks.withColumns({"unit": F.coalesce(usable(F.trim("declared_unit")), *[named(k) for k in range(1, 5)]), "caption": F.coalesce(*[titled(k) for k in range(1, 4)])})
    return made.filter("kind = 'table'").select("page_id", "table_no", "unit", "caption")


def sniff(content: Column) -> Column:
    """S3: pdf, html, xml or text by the first 8 KiB."""
    head = F.lower(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"))
    return F.when(head.startswith("%pdf"), "pdf").when(head.contains("<html"), "html").when(head.contains("<document") | head.startswith("<?xml"), "xml").otherwise("text")


def source_role(name: Column) -> Column:
    """The role of a file by its name."""
    low = F.lower(name)
    return F.when(low.contains("audit"), "audit").when(low.contains("toc"), "viewer_toc").when(low.contains("attach"), "attachment").otherwise("main")

