"""G-span, spaced names and typo repair: catalogue names in texts of any number, without comparing every name with every text.

A catalogue's surfaces become one automaton that goes to every task; a catalogue above ``BLOCK`` characters
is cut in blocks by hash, each with a pass of its own. What the automaton finds is rows, and windows and joins decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of surfaces in one automaton (some tens of bytes each), which bounds what is broadcast.
BLOCK = 1 << 21

FOUND = "start int, stop int, name_id {kind}, surface string, priority int"


def blocks_of(names: DataFrame, limit: int = BLOCK) -> Iterator[list]:
    """The catalogue in lists of about ``limit`` characters."""
    total = names.agg(F.coalesce(F.sum(F.length("surface")), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    for b in range(n):
        rows = names.filter(F.pmod(F.xxhash64("surface"), F.lit(n)) == b).collect()
        if rows:
            yield rows


def is_word(surface: str) -> bool:
    return surface.isascii() and any(c.isalnum() for c in surface)


def bounded(text: str, start: int, stop: int, surface: str, tails: tuple[str, ...] | None) -> bool:
    """Whether a place is a name's: a Latin name stands between borders of words; another name ends the text, or a digit or one of ``tails`` follows."""
    inside = lambda c: c.isascii() and c.isalnum()
    if is_word(surface):
        return not (start and inside(text[start - 1])) and not (stop < len(text) and inside(text[stop]))
    return tails is None or stop == len(text) or text[stop].isdigit() or text.startswith(tails, stop)


def occurrences(texts: DataFrame, key: str, text: str, names: DataFrame, tails: tuple[str, ...] | None = None, limit: int = BLOCK) -> DataFrame:
    """(key, start, stop, name_id, surface, priority): every place of every surface of ``names`` (name_id, surface, priority), overlaps included.

    Places count code points. ``tails``: what may follow a name that is not Latin (particles); None: anything.
    """
    spark, kind = texts.sparkSession, names.schema["name_id"].dataType
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, {FOUND.format(kind=kind.simpleString())}"
    out = None
    for rows in blocks_of(names.select("name_id", "surface", "priority").filter("surface <> ''"), limit):
        by: dict[str, list[tuple]] = {}
        for r in rows:
            by.setdefault(r["surface"], []).append((r["name_id"], r["priority"]))
        shared = spark.sparkContext.broadcast(by)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            known = shared.value
            automaton = ahocorasick.Automaton()
            for surface in known:
                automaton.add_word(surface, surface)
            automaton.make_automaton()
            for batch in batches:
                at, cells = [], ([], [], [], [], [])
                for row, value in enumerate(batch.column(1)):
                    body = value.as_py() or ""
                    for last, surface in automaton.iter(body):
                        start, stop = last + 1 - len(surface), last + 1
                        if bounded(body, start, stop, surface, tails):
                            for name_id, priority in known[surface]:
                                at.append(row)
                                for column, x in zip(cells, (start, stop, name_id, surface, priority)):
                                    column.append(x)
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                rest = [pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), None, pa.string(), pa.int32()))]
                if at:
                    yield pa.RecordBatch.from_arrays([keys, *rest], [key, "start", "stop", "name_id", "surface", "priority"])

        found = texts.select(key, text).mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_shadowed(found: DataFrame, key: str) -> DataFrame:
    """The places that no longer place covers, and of one place the names of the least priority number.

    A place is covered if an earlier place of the order (start, then longest) ends as late: a running maximum.
    """
    spans = found.groupBy(key, "start", "stop").agg(F.min("priority").alias("priority"))
    before = Window.partitionBy(key).orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    free = spans.withColumn("furthest", F.max("stop").over(before)).filter("furthest is null or furthest < stop").drop("furthest")
    return found.join(free, [key, "start", "stop", "priority"])


def name_spans(texts: DataFrame, key: str, text: str, names: DataFrame, tails: tuple[str, ...] | None = None) -> DataFrame:
    """G-span: the catalogue names of each text, shadowed ones removed."""
    return without_shadowed(occurrences(texts, key, text, names, tails), key)


# ---- names with blanks inside -------------------------------------------------------------


def spaced_names(texts: DataFrame, key: str, text: str, names: DataFrame, least: int = 3, limit: int = BLOCK) -> DataFrame:
    """(key, start, stop, observed, surface): names of ``least`` letters or more that are written with blanks or tabs inside.

    The text without its blanks is searched, and a place counts if blanks stood inside it; a name that the text also
    has as it is needs no repair. Of overlapping places the longest name's stays, then the first; of a name the first place.
    """
    spark = texts.sparkSession
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, start int, stop int, observed string, surface string"
    out = None
    for rows in blocks_of(names.select("surface").distinct().filter(F.length(F.replace("surface", F.lit(" "), F.lit(""))) >= least), limit):
        shared = spark.sparkContext.broadcast([r["surface"] for r in rows])

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            whole: dict[str, list[str]] = {}
            for surface in shared.value:
                whole.setdefault(surface.replace(" ", ""), []).append(surface)
            for bare in whole:
                automaton.add_word(bare, bare)
            automaton.make_automaton()
            for batch in batches:
                made: list[tuple] = []
                for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    body = value.as_py() or ""
                    places = [i for i, c in enumerate(body) if c not in " \t"]
                    met = set()
                    for last, bare in automaton.iter("".join(body[i] for i in places)):
                        start, stop = places[last + 1 - len(bare)], places[last] + 1
                        observed = body[start:stop]
                        for surface in whole[bare]:
                            if surface not in met and observed != surface and (" " in observed or "\t" in observed) and surface not in body:
                                met.add(surface)
                                made.append((k, start, stop, observed, surface))
                if made:
                    columns = list(zip(*made))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.string(), pa.string()))]], [key, "start", "stop", "observed", "surface"])

        found = texts.select(key, text).mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    # the longest name first: a place goes if one of a longer name, or an earlier one of the same length, overlaps it
    place = F.struct((-F.length("surface")).alias("l"), "start", "stop", "surface", "observed")
    taken = F.aggregate(
        F.array_sort(F.collect_list(place)), F.array().cast("array<struct<l:int,start:int,stop:int,surface:string,observed:string>>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return out.groupBy(key).agg(taken.alias("t")).select(key, F.explode("t").alias("x")).select(key, "x.start", "x.stop", "x.observed", "x.surface")


# ---- one edit away ------------------------------------------------------------------------


def deletions(word: Column) -> Column:
    """The word and all its forms with one character left out: two words within one edit share one of them."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def near_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """(core, surface) of words (core) and names (surface) that are exactly one edit apart.

    Both sides meet under a form with one character left out, never word by name; the edit distance decides.
    """
    left = words.select("core").distinct().select("core", F.explode(deletions(F.col("core"))).alias("form"))
    right = names.select("surface").distinct().select("surface", F.explode(deletions(F.col("surface"))).alias("form"))
    return left.join(right, "form").select("core", "surface").distinct().filter(F.levenshtein("core", "surface", 1) == 1)


def typo_repairs(texts: DataFrame, key: str, words: Column, names: DataFrame, least: int = 4) -> DataFrame:
    """(key, core, replacement): the one repair of each text that has exactly one.

    ``words``: an array column of a text's words without particles; ``names`` (surface, identity, replacement).
    A word that is a registered surface is right as it stands. If the words near a name name two identities, or two
    words or replacements are possible, nothing is repaired.
    """
    tokens = texts.select(key, F.explode(F.array_distinct(words)).alias("core")).filter(F.length("core") >= least)
    tokens = tokens.join(names.select(F.col("surface").alias("core")).distinct(), "core", "left_anti")
    near = near_names(tokens, names).join(names, "surface").select("core", "identity", "replacement").distinct()
    met = tokens.join(near, "core").groupBy(key).agg(
        F.countDistinct("identity").alias("identities"), F.countDistinct("core", "replacement").alias("repairs"), F.min("core").alias("core"), F.min("replacement").alias("replacement")
    )
    return met.filter("identities = 1 and repairs = 1").select(key, "core", "replacement")


def repaired(text: Column, core: Column, replacement: Column) -> Column:
    """The text with the first occurrence of ``core`` replaced; without one, as it is."""
    at = F.instr(text, core)
    return F.when(core.isNull() | (at == 0), text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), replacement, F.substring(text, at + F.length(core), F.length(text))))
