"""Conversation structure repair: a fold over sorted turns with native higher-order functions (operator 13).

Damage. Each row is hit by crc32 of ``conv_id:turn`` modulo 20 (null as one blank): 0 drops it, 1
empties its text, 2 takes out ``[.!?]``, 3 repeats it beside itself, 4 makes its role ``user``.

Faults. Rows are taken by turn (nulls first; equal turns by role, then text). A window over
(conversation, role, text) marks duplicates; blank and truncated are seen on the row itself. The
first that holds counts: blank, duplicate, truncated.

Repair. The rows kept and inserted must read ``(s?(ua)+)?`` by the first letters of their roles. ``aggregate()``
runs over the sorted turns and carries four structs (cost, audit), one per state: nothing kept yet,
after the system row, after a user, after an assistant. Each turn and each insertion takes the
``least`` struct that reaches a state, so cost comes first and the audit breaks ties. Two ways of equal
cost never have audits of which one begins the other, as the longer one would pay for its extra
insertions; so keeping the least per state is exact. Inside the fold the letters also tell the role:
J and I insert, S and R rename to user and assistant; they sort as I and R do, since one state
admits only one of each.

Large conversations. One of more than ``LONG`` rows is never one group. Its rows are numbered over ranges
of the order, first occurrences are minima with partial sums, and blocks of ``CHUNK`` turns are folded
from each of the four states into a four by four table; the tables are folded level by level.
Each block writes its own lines, and only the SHA-256, which has to read the whole text in order,
streams over a conversation's blocks in one task, holding one block at a time.

Defined cases. A null role or text is one blank; a null conv_id is a conversation of its own; null turns come
first and do not count for gaps. A role without a first letter or with one other than s, u, a
cannot be kept as it is. Rows equal in turn stay in the order of role and text. A conversation
without rows after the damage has zeros, an empty audit and the hash of the empty text. An empty table gives an empty
result; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.common import shuffle_partitions
from filigree.operators.ordering import numbered
from filigree.session import materialize

#: Rows above which a conversation is dealt in blocks, and the turns of a block.
LONG, CHUNK = 1024, 256

#: Costs of edits, and a cost that no conversation reaches.
RENAME, DELETE, INSERT, TRUNCATED, NEVER = 3, 4, 3, 3, 1 << 50

STATES = "esua"
SEEN = r"[^\x20\x09-\x0D]"
ONE_WAY, FOUR_WAYS = "struct<cost:bigint,audit:string>", f"struct<{','.join(f'{s}:struct<cost:bigint,audit:string>' for s in STATES)}>"
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text, copy): the rows after the damage; ``c`` is a key without nulls."""
    hit = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(conversation_key(), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), hit.alias("hit")).filter("hit <> 0")
    return rows.select(
        "c", "turn",
        F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("c")


def fault(again: Column) -> Column:
    """1 blank, 2 duplicate, 3 truncated, 0 none; ``again`` tells a row whose role and text came earlier."""
    blank = ~F.col("text").rlike(SEEN)
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)  # the last visible character, found from the end
    return F.when(blank, 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


# ---- the fold -----------------------------------------------------------------------------


def way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def after(one: Column, cost: Column, letter: Column) -> Column:
    return way(one["cost"] + cost, F.concat(one["audit"], letter))


def four(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def with_insertions(ways: Column) -> Column:
    """The four states after free insertions: a user where none is open, an assistant after a user."""
    price = F.lit(INSERT)

    def user_first(w: Column) -> Column:
        user = F.least(w["u"], after(F.least(w["e"], w["s"], w["a"]), price, F.lit("J")))
        return let(user, lambda u: four(w["e"], w["s"], u, F.least(w["a"], after(u, price, F.lit("I")))))

    return let(ways, user_first)


def start_of(state: str) -> Column:
    """The fold's beginning in a state."""
    ways = [way(F.lit(0 if s == state else NEVER), F.lit("")) for s in STATES]
    return with_insertions(four(*ways)).cast(FOUR_WAYS)


def turn_step(w: Column, t: Column) -> Column:
    """One turn: delete it, keep it, or give it the role that the state asks for."""
    first, stays = F.substring(t["role"], 1, 1), F.when(t["fault"].isin(1, 2), F.lit(NEVER)).when(t["fault"] == 3, F.lit(TRUNCATED)).otherwise(F.lit(0))
    gone = lambda x: after(x, F.lit(DELETE), F.lit("D"))
    to = lambda x, letter, rename: after(x, stays + F.when(first == letter, 0).otherwise(RENAME), F.when(first == letter, F.lit("K")).otherwise(F.lit(rename)))
    system = after(w["e"], stays + F.when(first == "s", 0).otherwise(NEVER), F.lit("K"))
    return with_insertions(four(
        gone(w["e"]),
        F.least(gone(w["s"]), system),
        F.least(gone(w["u"]), to(F.least(w["e"], w["s"], w["a"]), "u", "S")),
        F.least(gone(w["a"]), to(w["u"], "a", "R")),
    )).cast(FOUR_WAYS)


def fold_turns(turns: Column, state: str) -> Column:
    return F.aggregate(turns, start_of(state), turn_step)


def joined(w: Column, block: Column) -> Column:
    """Four ways on through a block's four by four table."""
    def to(state: str) -> Column:
        return F.least(*[way(w[x]["cost"] + block[x][state]["cost"], F.concat(w[x]["audit"], block[x][state]["audit"])) for x in STATES])

    return four(*[to(s) for s in STATES]).cast(FOUR_WAYS)


def best(ways: Column) -> Column:
    """The end of the fold: nothing kept, or the last row is an assistant's."""
    return F.least(ways["e"], ways["a"])


def lines(turns: Column, edits: Column) -> Column:
    """The repaired ``role:text`` of sorted turns and their edits (one string each: insertions, then the turn's own letter)."""
    def inserted(edit: Column) -> Column:
        marks = F.regexp_extract_all(edit, F.lit("[IJ]"), 0)
        return F.transform(marks, lambda x: F.when(x == "J", F.lit("user:")).otherwise(F.lit("assistant:")))

    def of(t: Column, edit: Column) -> Column:
        role = F.when(edit.endswith("S"), F.lit("user")).when(edit.endswith("R"), F.lit("assistant")).otherwise(t["role"])
        own = F.when(edit.endswith("D") | t.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), t["text"])))
        return F.concat(inserted(edit), own)

    return F.flatten(F.zip_with(turns, edits, of))


def edits_of(audit: Column) -> Column:
    """An audit of the fold as one string per turn, with a last one for insertions at the end if there are any."""
    return F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]|[IJ]+$"), 0)


def public(audit: Column) -> Column:
    """The letters as the audit shows them."""
    return F.translate(audit, "JS", "IR")


# ---- one conversation, one row --------------------------------------------------------------

TURN = ["pos", "turn", "role", "text", "fault"]


def facts(turns: Column) -> list[Column]:
    """Of sorted turns: their number, faults, illegal neighbours, changes of turn, and both ends."""
    size = F.size(turns)
    ahead = F.slice(turns, 2, F.greatest(size - 1, F.lit(0)))
    initial = lambda t: F.substring(t["role"], 1, 1)
    legal = F.array(*map(F.lit, ("su", "ua", "au")))
    steps = F.zip_with(F.slice(turns, 1, F.greatest(size - 1, F.lit(0))), ahead, lambda x, y: F.struct(
        (~F.array_contains(legal, F.concat(initial(x), initial(y)))).alias("illegal"), (x["turn"].isNotNull() & (x["turn"] != y["turn"])).alias("moved")))
    count = lambda k: F.size(F.filter(turns, lambda t: t["fault"] == k)).cast("long")
    known = F.filter(turns, lambda t: t["turn"].isNotNull())
    return [
        count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"),
        F.size(F.filter(steps, lambda x: x["illegal"])).cast("long").alias("illegal"),
        F.size(F.filter(steps, lambda x: x["moved"])).cast("long").alias("moved"),
        initial(turns[0]).alias("first"), initial(F.element_at(turns, -1)).alias("last"),
        turns[0]["turn"].alias("first_turn"), F.element_at(turns, -1)["turn"].alias("last_turn"),
        F.get(known, F.lit(0))["turn"].alias("low"),
    ]


def small_repaired(rows: DataFrame) -> DataFrame:
    """Conversations of up to ``LONG`` rows: one shuffle by conversation serves windows, collection and fold."""
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    placed = rows.withColumn("pos", F.row_number().over(order))
    again = F.row_number().over(Window.partitionBy("c", "role", "text").orderBy("pos")) > 1
    flagged = placed.select("c", "pos", "turn", "role", "text", again.alias("again")).withColumn("fault", fault(F.col("again")))
    one = flagged.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns"))
    one = one.select("c", "turns", *facts(F.col("turns")), best(fold_turns(F.col("turns"), "e")).alias("best"))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("last_turn") - F.col("low") - F.col("moved"))
    text = F.array_join(lines(F.col("turns"), edits_of(F.col("best.audit"))), "\n")
    return one.select(
        "c", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), public(F.col("best.audit")).alias("audit"), F.sha2(text.cast("binary"), 256).alias("repaired_sha256")
    )


# ---- large conversations --------------------------------------------------------------------


def large_blocks(rows: DataFrame, chunk: int) -> DataFrame:
    """(c, block, turns) of conversations of any size: numbered over ranges, first occurrences by partial minima."""
    kept = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "turns")
    parts = max(shuffle_partitions(rows), kept.count() // 100_000 + 1)
    at = materialize(numbered(kept, ["c", "turn", "role", "text", "rid"], "row_no", parts), "turn-numbers")
    starts = at.groupBy("c").agg(F.min("row_no").alias("start"))
    firsts = at.groupBy("c", "role", "text").agg(F.min("row_no").alias("first_no"))
    flagged = at.join(firsts, ["c", "role", "text"]).join(starts, "c").withColumn("fault", fault(F.col("row_no") > F.col("first_no")))
    flagged = flagged.withColumn("pos", F.col("row_no") - F.col("start"))
    blocks = flagged.groupBy("c", (F.col("pos") / chunk).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns"))
    return materialize(blocks, "turn-blocks")


def table_of(turns: Column) -> Column:
    return F.struct(*[fold_turns(turns, s).alias(s) for s in STATES])


def identity_table() -> Column:
    return F.struct(*[four(*[way(F.lit(0 if s == x else NEVER), F.lit("")) for s in STATES]).cast(FOUR_WAYS).alias(x) for x in STATES])


def tables_joined(tables: Column) -> Column:
    """Sorted tables of neighbouring blocks as one."""
    def from_state(x: str) -> Column:
        begin = four(*[way(F.lit(0 if s == x else NEVER), F.lit("")) for s in STATES]).cast(FOUR_WAYS)
        return F.aggregate(tables, begin, lambda w, b: joined(w, b["table"]))

    return F.struct(*[from_state(x).alias(x) for x in STATES])


def large_audits(blocks: DataFrame, chunk: int) -> DataFrame:
    """(c, cost, audit): block tables folded level by level, ``chunk`` of them at a time."""
    tables = materialize(blocks.select("c", "block", table_of(F.col("turns")).alias("table")), "turn-tables")
    while (tables.agg(F.max("block")).first()[0] or 0) > 0:
        next_level = tables.groupBy("c", (F.col("block") / chunk).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "table"))).alias("tables"))
        tables = materialize(next_level.select("c", F.col("up").alias("block"), tables_joined(F.col("tables")).alias("table")), "turn-tables")
    return tables.select("c", best(F.col("table.e")).alias("best")).select("c", "best.cost", "best.audit")


def streamed_hashes(texts: DataFrame) -> DataFrame:
    """(c, repaired_sha256): SHA-256 over a conversation's blocks of lines in order, one block held at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, h, begun = None, None, False
        for batch in batches:
            for c, n, text in zip(*(batch.column(k) for k in range(3))):
                c = c.as_py()
                if c != one:
                    if h is not None:
                        yield pa.RecordBatch.from_pydict({"c": [one], "repaired_sha256": [h.hexdigest()]})
                    one, h, begun = c, hashlib.sha256(), False
                if n.as_py():
                    if begun:
                        h.update(b"\n")
                    h.update(text.as_buffer())
                    begun = True
        if h is not None:
            yield pa.RecordBatch.from_pydict({"c": [one], "repaired_sha256": [h.hexdigest()]})

    ordered = texts.repartition("c").sortWithinPartitions("c", "block").select("c", "n", "text")
    return ordered.mapInArrow(digest, "c string, repaired_sha256 string")


def large_repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations above ``LONG`` rows, block by block."""
    blocks = large_blocks(rows, chunk)
    audits = materialize(large_audits(blocks, chunk), "audits")
    known = blocks.select("c", "block", *facts(F.col("turns")))
    before = Window.partitionBy("c").orderBy("block")  # a row per block
    seam = F.concat(F.lag("last").over(before), F.col("first"))
    known = known.withColumns({
        "illegal": F.col("illegal") + F.when(seam.isNull() | seam.isin("su", "ua", "au"), 0).otherwise(1),
        "moved": F.col("moved") + F.when(F.lag("last_turn").over(before) != F.col("first_turn"), 1).otherwise(0),
    })
    gaps = F.coalesce(F.max("last_turn") - F.min("low") - F.sum("moved"), F.lit(0)).cast("long")
    sums = known.groupBy("c").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")])
    edits = audits.select("c", edits_of(F.col("audit")).alias("edits"))
    # every block takes its turns' edits; what is inserted after the last turn goes with the last block
    counts = edits.select("c", "edits", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size(F.filter("edits", lambda x: x.rlike("[DKRS]$"))) - 1) / chunk).cast("long"))).alias("block"))
    last = F.floor((F.size(F.filter("edits", lambda x: x.rlike("[DKRS]$"))) - 1) / chunk)
    own = counts.select("c", "block", F.slice("edits", (F.col("block") * chunk + 1).cast("int"), F.when(F.col("block") == last, F.lit(chunk + 1)).otherwise(F.lit(chunk))).alias("edits"))
    made = blocks.join(own, ["c", "block"]).select("c", "block", lines(F.col("turns"), F.col("edits")).alias("made"))
    hashes = streamed_hashes(made.select("c", "block", F.size("made").alias("n"), F.array_join("made", "\n").alias("text")))
    whole = sums.join(audits, "c").join(hashes, "c")
    return whole.select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", public(F.col("audit")).alias("audit"), "repaired_sha256")


def repair(conversations: DataFrame, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """One row per original conv_id: ``RESULT``."""
    rows = damaged(conversations)
    ids = conversations.select(conversation_key(), "conv_id").groupBy("c").agg(F.first("conv_id").alias("conv_id"))
    sizes = materialize(rows.groupBy("c").agg(F.count("*").alias("size")).filter(F.col("size") > long), "long-conversations")
    if sizes.limit(1).count():
        wide = rows.join(sizes.select("c"), "c", "left_semi")
        found = small_repaired(rows.join(sizes.select("c"), "c", "left_anti")).unionByName(large_repaired(wide, chunk))
    else:
        found = small_repaired(rows)
    whole = ids.join(found, "c", "left")
    zero = {c: F.lit(0).cast("long") for c in RESULT[1:7]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return whole.select("conv_id", *[F.coalesce(c, zero[c]).alias(c) for c in RESULT[1:]])
