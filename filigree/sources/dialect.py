"""Filings in an XML dialect, parsed strictly first and by a recovering reader where that fails, with a row per warning.

The strict reader is expat. The recovering one scans tags itself and keeps a stack: a stray ``<`` or ``&`` is text, an
end tag that closes an outer element closes the inner ones, one that closes nothing is dropped, and what is open at the end
is closed. Every repair is reported with its line and column. Both feed the same ``Filing``, which collects narrative elements.
"""

from __future__ import annotations

import codecs
import html
import re
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.session import materialize

#: Elements that hold narrative, the table element, image elements and sections of the dialect.
NARRATIVE, TABLE, IMAGES = {"TITLE", "P", "TE", "TU"}, "TABLE", {"IMAGE", "IMG"}
SECTION = re.compile(r"SECTION-\d+")

#: Bytes of a source that tell its charset, and the charsets tried in their order.
HEAD, CHARSETS = 8192, ("utf-8", "cp949")

#: Warnings kept per document and phase, as a report.
WARNINGS = 100

PARSED = "page_id long, what string, n int, kind string, tag string, path array<string>, text string, line int, col int"


def charset(content: bytes) -> str | None:
    """S3: the first charset that decodes the first ``HEAD`` bytes; a character that the border cuts is no error, unless the source ends there."""
    for name in CHARSETS:
        try:
            codecs.getincrementaldecoder(name)("strict").decode(content[:HEAD], final=len(content) <= HEAD)
            return name
        except UnicodeDecodeError:
            pass
    return None


@F.pandas_udf(T.StructType([T.StructField("charset", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """S3: a source's charset and its whole text; bytes that the charset does not know become U+FFFD, and a source of neither charset has no text."""
    for column in contents:
        names = [None if x is None else charset(x) for x in column]
        yield pd.DataFrame({"charset": pd.Series(names, dtype=object), "text": pd.Series([None if n is None else x.decode(n, errors="replace") for n, x in zip(names, column)], dtype=object)})


class Filing:
    """The narrative elements of one document, in the order of their starts."""

    def __init__(self) -> None:
        self.stack: list[dict] = []
        self.buffer: list[str] = []  # all character data; an element keeps where its own begins and ends
        self.elements: list[dict] = []
        self.images = 0

    def start(self, name: str) -> None:
        tag = name.rpartition(":")[2].upper()
        above = self.stack[-1] if self.stack else None
        self.data(" ")  # words on both sides of a tag are apart
        one = {"tag": tag, "above": above, "in_table": bool(above and (above["in_table"] or above["tag"] == TABLE)), "begin": len(self.buffer), "titles": []}
        self.images += tag in IMAGES
        self.stack.append(one)
        if tag in NARRATIVE:
            self.elements.append(one)
            if tag == "TITLE" and above:
                above["titles"].append(one)

    def end(self) -> None:
        self.stack.pop()["end"] = len(self.buffer)
        self.data(" ")

    def data(self, text: str) -> None:
        self.buffer.append(text)

    def plain(self, one: dict) -> str:
        """The text of an element and all that it holds."""
        return " ".join("".join(self.buffer[one["begin"] : one["end"]]).split())

    def path(self, one: dict) -> list[str]:
        """The titles of the sections above, outermost first; a section without a title gives its own name."""
        out, up = [], one
        while up:
            if SECTION.fullmatch(up["tag"]):
                out.append(next((t for x in up["titles"] if (t := self.plain(x))), up["tag"]))
            up = up["above"]
        return out[::-1]

    def fragments(self) -> list[tuple[str, str, list[str], str]]:
        """(kind, tag, section path, text) of what has text and stands in no table."""
        return [("heading" if one["tag"] == "TITLE" else "paragraph", one["tag"], self.path(one), text) for one in self.elements if not one["in_table"] and (text := self.plain(one))]


def strict(text: str) -> tuple[Filing | None, list[tuple]]:
    """The filing if the text is well formed, else the error (level, message, line, column)."""
    filing, parser = Filing(), expat.ParserCreate()
    parser.StartElementHandler = lambda name, attributes: filing.start(name)
    parser.EndElementHandler = lambda name: filing.end()
    parser.CharacterDataHandler = filing.data
    parser.buffer_text = True
    try:
        # the text is decoded already, whatever the declaration says
        parser.Parse(re.sub(r"^(﻿?\s*<\?xml[^>]*?)\s+encoding\s*=\s*(?:\"[^\"]*\"|'[^']*')", r"\1", text, count=1), True)
        return filing, []
    except expat.ExpatError as error:
        return None, [("FATAL", expat.errors.messages[error.code], error.lineno, error.offset + 1)]


TAG = re.compile(r"<(?P<end>/?)(?P<name>[^\W\d][\w:.-]*)(?P<rest>(?:\s(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)?/?)>")
SKIPPED = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">"))
ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def recovered(text: str) -> tuple[Filing, list[tuple]]:
    """The filing of any text, and what was repaired (level, message, line, column)."""
    filing, warnings, open_tags, counts = Filing(), [], [], Counter()
    line, line_at, at, n = 1, 0, 0, len(text)

    def warn(level: str, message: str, place: int) -> None:
        nonlocal line, line_at
        # places only grow, so the lines between are counted once
        line += text.count("\n", line_at, place)
        line_at = place
        if len(warnings) < WARNINGS:
            warnings.append((level, message, line, place - text.rfind("\n", 0, place)))

    def characters(start: int, stop: int) -> None:
        part, done = text[start:stop], 0
        amp = part.find("&")
        out = []
        while amp >= 0:
            out.append(part[done:amp])
            m = ENTITY.match(part, amp)
            known = html.unescape(m[0]) if m else ""
            if m and known != m[0]:
                out.append(known)
                done = m.end()
            else:
                warn("ERROR", "unescaped &" if not m else f"unknown entity {m[0]}", start + amp)
                out.append("&")
                done = amp + 1
            amp = part.find("&", done)
        out.append(part[done:])
        filing.data("".join(out))

    while at < n:
        less = text.find("<", at)
        if less < 0:
            characters(at, n)
            break
        if less > at:
            characters(at, less)
        skipped = next(((a, b) for a, b in SKIPPED if text.startswith(a, less)), None)
        if skipped:
            stop = text.find(skipped[1], less + len(skipped[0]))
            if skipped[0] == "<![CDATA[":
                filing.data(text[less + 9 : stop if stop >= 0 else n])
            if stop < 0:
                warn("ERROR", f"unfinished {skipped[0]}", less)
                break
            at = stop + len(skipped[1])
            continue
        m = TAG.match(text, less)
        if not m:
            warn("ERROR", "unescaped <", less)
            filing.data("<")
            at = less + 1
            continue
        name, at = m["name"], m.end()
        if not m["end"]:
            filing.start(name)
            if m["rest"].endswith("/"):
                filing.end()
            else:
                open_tags.append(name)
                counts[name] += 1
        elif counts[name]:
            while open_tags[-1] != name:
                counts[open_tags[-1]] -= 1
                warn("ERROR", f"unclosed {open_tags.pop()}", less)
                filing.end()
            counts[open_tags.pop()] -= 1
            filing.end()
        else:
            warn("ERROR", f"end tag without start {name}", less)
    while open_tags:
        warn("ERROR", f"unclosed {open_tags.pop()}", n)
        filing.end()
    return filing, warnings


def parsed(pages: DataFrame) -> DataFrame:
    """``PARSED`` rows of ``pages`` (page_id, body): a status row per page, its warnings, its fragments; each page is read once.

    A status is success, recovered or failed (nothing but white space); its n is the number of images.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("what", pa.string()), ("n", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("path", pa.list_(pa.string())), ("text", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
        for batch in batches:
            for page_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = body.as_py() or ""
                filing, errors = strict(text) if text.strip() else (Filing(), [])
                found = [("strict", *e) for e in errors]
                status = "success" if text.strip() else "failed"
                if filing is None:
                    filing, repairs = recovered(text)
                    found += [("recovery", *e) for e in repairs]
                    status = "recovered"
                rows = [(page_id, "status", filing.images, status, None, None, None, None, None)]
                rows += [(page_id, "warning", k, level, phase, None, message, line, col) for k, (phase, level, message, line, col) in enumerate(found)]
                rows += [(page_id, "fragment", k, kind, tag, path, words, None, None) for k, (kind, tag, path, words) in enumerate(filing.fragments())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pages.select("page_id", "body").mapInArrow(run, PARSED)


def read_filings(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statuses, warnings, fragments) of one reading of the pages, kept as a table."""
    rows = materialize(parsed(pages), "filings")
    statuses = rows.filter("what = 'status'").select("page_id", F.col("kind").alias("status"), F.col("n").alias("images"))
    warnings = rows.filter("what = 'warning'").select("page_id", "n", F.col("tag").alias("phase"), F.col("kind").alias("level"), F.col("text").alias("message"), "line", "col")
    return statuses, warnings, rows.filter("what = 'fragment'").select("page_id", F.col("n").alias("sequence_no"), "kind", "tag", F.col("path").alias("section_path"), "text")
