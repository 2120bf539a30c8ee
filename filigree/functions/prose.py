"""The numbers that a text claims, as exact decimals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units after a number, Korean digits and magnitudes, what a number may touch.
SCALES = {"조원": 10**12, "억원": 10**8, "백만원": 10**6, "천원": 10**3, "원": 1, "%": 1}
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
SMALL = {"십": 10, "백": 100, "천": 1000}
LARGE = {"만": 10**4, "억": 10**8, "조": 10**12}
NUMERALS = set(DIGITS) | set(SMALL) | set(LARGE)
RECEIPT = "접수번호"

SECTION = re.compile(r"([영공일이삼사오육칠팔구십백천]*)([만억조]?)")
PART = re.compile(r"([영공일이삼사오육칠팔구]*)([십백천]?)")
EXACT = Context(prec=100_000, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[])


def words_value(words: str) -> int:
    """The value of Korean number words: sections of up to four places before each large unit.

    Of digits in a row the last counts; a unit without a digit counts once.
    """
    total = 0
    for section, large in SECTION.findall(words):
        value = 0
        for digits, small in PART.findall(section):
            if digits or small:
                value += (DIGITS[digits[-1]] if digits else 1) * SMALL.get(small, 1)
        total += (value or 1) * LARGE[large] if large else value
    return total


def plain(value: Decimal) -> str:
    """One spelling per value: without trailing zeros, and without exponent unless it is far from the point."""
    value = EXACT.normalize(value)
    if not value:
        return "0"
    return format(value, "f") if abs(value.adjusted()) <= 60 else str(value)


def run_end(text: str, at: int, allowed: str) -> int:
    """Where the run of the allowed characters that begins at ``at`` ends."""
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def unit_at(text: str, at: int, units: Iterable[str] = SCALES) -> str | None:
    """The unit that begins at ``at``, blanks before it aside."""
    while text[at : at + 1].isspace():
        at += 1
    return next((u for u in units if text.startswith(u, at)), None)


def apart(text: str, at: int) -> bool:
    """Whether the character at ``at`` may touch a number: no letter, digit, underscore or dot of ASCII."""
    return not (0 <= at < len(text)) or not (text[at] in "_." or text[at].isascii() and text[at].isalnum())


def decimal_ends(text: str, at: int) -> list[int]:
    """Ends of the decimal numbers that begin at the digit at ``at``, the preferred first.

    Digits in groups of three behind commas before plain digits, more groups before fewer; each with fraction and
    exponent, with one of them, with none.
    """
    whole = run_end(text, at, "0123456789")
    grouped, end = [], whole
    while whole - at <= 3 and end < len(text) and text[end] == "," and run_end(text, end + 1, "0123456789") >= end + 4:
        end += 4
        grouped.insert(0, end)
    out = []
    for end in [*grouped, whole]:
        fraction = run_end(text, end + 1, "0123456789") if end < len(text) and text[end] == "." else end
        fraction = end if fraction == end + 1 else fraction
        for stop in dict.fromkeys((fraction, end)):
            sign = stop + 1 + (text[stop + 1 : stop + 2] in ("+", "-"))
            power = run_end(text, sign, "0123456789") if text[stop : stop + 1] in ("e", "E") else sign
            out += [power, stop] if power > sign else [stop]
    return out


def number_at(text: str, at: int) -> tuple[int, str] | None:
    """(end, kind) of the number that begins at ``at``: hex, decimal, or number words before a unit."""
    if text[at] in NUMERALS:
        end = at
        while end < len(text) and text[end] in NUMERALS:
            end += 1
        # words give places back until a unit follows
        return next(((e, "words") for e in range(end, at, -1) if unit_at(text, e, "원%")), None)
    start = at + (text[at] in "+-")
    if text[start : start + 2] in ("0x", "0X"):
        end = run_end(text, start + 2, "0123456789abcdefABCDEF")
        return (end, "hex") if end > start + 2 and apart(text, end) else None
    if start < len(text) and text[start] in "0123456789":
        return next(((e, "decimal") for e in decimal_ends(text, start) if apart(text, e)), None)
    return None


def numbers_in(text: str, years: set[str] = frozenset(), receipts: set[str] = frozenset()) -> list[str]:
    """Distinct numbers of the text, scaled by the unit that follows, in order of first appearance.

    A declared year before 년 and a declared receipt number soon after its label are no claims. A unit
    such as 천원 that a space parts from its number scales it and reads as number words besides.
    """
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if not unicodedata.category(c).startswith("C"))
    out: dict[str, None] = {}
    at = 0
    while at < len(text):
        found = number_at(text, at) if apart(text, at - 1) else None
        if found is None:
            at += 1
            continue
        start, (at, kind) = at, found
        token = text[start:at]
        bare = token.replace(",", "").lstrip("+")
        if kind == "hex":
            value = Decimal(int(token, 16))
        elif kind == "words":
            value = Decimal(words_value(token))
        elif (bare in years and text.startswith("년", at)) or (bare in receipts and RECEIPT in text[max(0, start - 12) : start]):
            continue
        else:
            try:
                value = Decimal(bare)
            except InvalidOperation:
                continue
        if unit := unit_at(text, at):
            value = EXACT.multiply(value, Decimal(SCALES[unit]))
        if value.is_finite():
            out[plain(value)] = None
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def prose_numbers(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Numbers of (text, declared years, declared receipt numbers); a null text has none."""
    for text, years, receipts in batches:
        known = lambda x: set() if x is None else set(x)
        yield pd.Series([[] if t is None else numbers_in(t, known(y), known(r)) for t, y, r in zip(text, years, receipts, strict=True)])
