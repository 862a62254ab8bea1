"""Repair of damaged conversations: the cheapest edits, and among the cheapest the first in the order of their letters.

Turns are kept (K), get another role (R), are deleted (D), and empty turns are inserted (I), so that the roles are an optional system turn
and pairs of user and assistant. A list of edits is one whole number: its high digits are the cost, its low digits are the letters of the edits
in places of fixed width, with zeros behind the last. Smaller numbers are cheaper edits, or equally cheap ones whose letters come first,
so the least number over the paths of an acyclic graph (turn, state) decides everything. Putting an edit before a list adds its cost to
the high digits and moves the low digits on by one place.

A conversation of any length is cut into segments of ``SEGMENT`` turns. Each has a table of least numbers from state to state; up to ``FAN``
neighbouring tables are combined into one, level by level, until a conversation has one table; its least entry fixes the states at the ends, and the way
back down fixes those at all borders. Segments then edit their turns on their own. Two lists of equal cost between two states never continue one
another (a repeated state costs four more), so combining keeps the order of letters. No task holds more than a segment or FAN tables.

Faults: a turn is blank if it has no character but white space (U+0020, U+0009 to U+000D), else a duplicate if the conversation has an earlier turn of this role
and text, else truncated if its last such character is none of ``.!?``. Blank and duplicate turns must be deleted. Costs: D 3, R 2, I 2,
a truncated turn that stays 1. A role counts by its first character.

Defined results: null roles and texts are one space; null conversation ids are one conversation; turns follow by number, nulls first, those
of equal number by role and a hash of role and text; repeated rows are duplicates of the first; a turn with an empty role cannot be kept; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.columns import ASCII_SPACE, fingerprint, once

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn whose role begins with a letter, if it may come in a state.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a turn that is given a role or inserted, and that role.
GIVEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
DELETE, INSERT, KEEP, REROLE = b"D", b"I", b"K", b"R"
#: What must be inserted at the end of a conversation, by state.
CLOSING = (b"", b"II", b"I", b"")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1

SEGMENT = 200
FAN = 64


class Weights:
    """Lists of edits as whole numbers, with room for ``width`` letters."""

    def __init__(self, width: int):
        self.width, self.shift = width, 8 * width
        self.low = (1 << self.shift) - 1

    def before(self, letters: bytes, cost: int, rest: int) -> int:
        """The number of the edits ``letters``, which cost ``cost``, followed by those of ``rest``."""
        n = 8 * len(letters)
        here = int.from_bytes(letters, "big") << (self.shift - n)
        return (((rest >> self.shift) + cost) << self.shift) | here | ((rest & self.low) >> n)

    def parts(self, weight: int) -> tuple[int, bytes]:
        """The cost and the letters of a number."""
        return weight >> self.shift, (weight & self.low).to_bytes(self.width, "big").rstrip(b"\0")


#: By first state * 4 + last state: the cost and the letters of the best edits, None if there are none.
Table = list[tuple[int, bytes] | None]


def segment_table(initials: str, faults: list[int]) -> Table:
    """The least numbers of a segment's turns; inserted turns come before a turn, never behind the last."""
    weights = Weights(3 * len(initials))
    before = weights.before
    table: Table = [None] * 16
    for last in range(4):
        value: list[int | None] = [0 if s == last else None for s in range(4)]
        for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            turned: list[int | None] = []
            for state in range(4):
                options = []
                if value[state] is not None:
                    options.append(before(DELETE, DELETE_COST, value[state]))
                if fault not in (BLANK, DUPLICATE):
                    kept = KEPT.get((state, initial))
                    if kept is not None and value[kept] is not None:
                        options.append(before(KEEP, extra, value[kept]))
                    if value[GIVEN[state]] is not None:
                        options.append(before(REROLE, REROLE_COST + extra, value[GIVEN[state]]))
                turned.append(min(options, default=None))
            value = []
            for state in range(4):  # none, one or two turns inserted; a third would repeat a state
                options, to, letters = [], state, b""
                for n in range(3):
                    if turned[to] is not None:
                        options.append(before(letters, INSERT_COST * n, turned[to]))
                    to, letters = GIVEN[to], letters + INSERT
                value.append(min(options, default=None))
        for state in range(4):
            if value[state] is not None:
                table[4 * state + last] = weights.parts(value[state])
    return table


def _ahead(tables: list[Table], last: list[int | None], weights: Weights) -> list[list[int | None]]:
    """The least numbers from each border and state to the end."""
    ahead = [last]
    for table in reversed(tables):
        rest = ahead[-1]
        values: list[int | None] = []
        for state in range(4):
            options = [weights.before(e[1], e[0], rest[m]) for m in range(4) if (e := table[4 * state + m]) and rest[m] is not None]
            values.append(min(options, default=None))
        ahead.append(values)
    return ahead[::-1]


def _width(tables: list[Table]) -> Weights:
    return Weights(2 + sum(max((len(e[1]) for e in table if e), default=0) for table in tables))


def combined(tables: list[Table]) -> Table:
    """The table of consecutive segments together."""
    weights = _width(tables)
    out: Table = [None] * 16
    for last in range(4):
        first = _ahead(tables, [0 if s == last else None for s in range(4)], weights)[0]
        for state in range(4):
            if first[state] is not None:
                out[4 * state + last] = weights.parts(first[state])
    return out


def borders(tables: list[Table], begin: int, end: int) -> list[int]:
    """The states at all borders of the best edits between two states."""
    weights = _width(tables)
    ahead = _ahead(tables, [0 if s == end else None for s in range(4)], weights)
    states = [begin]
    for table, rest in zip(tables, ahead[1:], strict=True):
        row = [(weights.before(e[1], e[0], rest[m]), m) for m in range(4) if (e := table[4 * states[-1] + m]) and rest[m] is not None]
        states.append(min(row)[1])
    return states


def whole(table: Table) -> tuple[int, int]:
    """The last state and the cost of the best edits of a conversation."""
    weights = _width([table])
    row = [
        (weights.before(e[1], e[0], weights.before(CLOSING[m], INSERT_COST * len(CLOSING[m]), 0)), m)
        for m in range(4) if (e := table[4 * START + m])
    ]
    weight, last = min(row)
    return last, weights.parts(weight)[0]


@dataclass
class Edited:
    """What becomes of a turn: its edits, the roles of empty turns before it, its role (None: deleted), the roles of those after it."""

    edits: str
    before: list[str]
    role: str | None
    after: list[str]


def replay(letters: bytes, initials: str, roles: list[str] | None, begin: int) -> list[Edited]:
    """The edits of a segment turn by turn. ``roles``: names of kept turns' roles (initials if not given)."""
    out, state, before, edits = [], begin, [], ""
    names = roles if roles is not None else list(initials)
    for letter in letters.decode():
        edits += letter
        if letter == "I":
            state = GIVEN[state]
            before.append(NAMES[state])
            continue
        i, role = len(out), None
        if letter == "K":
            state, role = KEPT[state, initials[i]], names[i]
        elif letter == "R":
            state = GIVEN[state]
            role = NAMES[state]
        out.append(Edited(edits, before, role, []))
        before, edits = [], ""
    if edits:  # what closes the conversation
        out[-1].edits += edits
        out[-1].after = before
    return out


def _cut(segment_turns: int):
    """Number the segments of sorted turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), -1
        group, place = None, 0
        for batch in batches:
            segments, places = [], []
            for own in batch["_group"].to_pylist():
                place += 1
                if own != group or place == segment_turns:
                    group, place, number = own, 0, number + 1
                segments.append((task << 32) | number)
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(segments, pa.int64()), pa.array(places, pa.int32())],
                names=[*batch.schema.names, "_segment", "_place"],
            )

    return run


_NODE = "_group string, _number long, costs array<long>, audits array<string>, initials string, illegal long"


def _packed(table: Table) -> tuple[list[int | None], list[str | None]]:
    return [e and e[0] for e in table], [e and e[1].decode() for e in table]


def _table(node: dict) -> Table:
    return [None if c is None else (c, a.encode()) for c, a in zip(node["costs"], node["audits"], strict=True)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_NODE_ARROW = pa.schema([
    ("_group", pa.string()), ("_number", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ("initials", pa.string()), ("illegal", pa.int64()),
])


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's table."""
    for batch in batches:
        rows = []
        for group, segment, turns in zip(*(batch[c].to_pylist() for c in ("_group", "_segment", "turns")), strict=True):
            initials = [t["_initial"] for t in turns]
            costs, audits = _packed(segment_table("".join(initials), [t["_fault"] for t in turns]))
            rows.append((group, segment, costs, audits, "".join(initials), _illegal(initials)))
        yield _batch(rows, _NODE_ARROW)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to FAN tables as one."""
    for batch in batches:
        rows = []
        for group, number, nodes in zip(*(batch[c].to_pylist() for c in ("_group", "_number", "nodes")), strict=True):
            costs, audits = _packed(combined([_table(n) for n in nodes]))
            ends = [(n["initials"][0], n["initials"][-1]) for n in nodes]
            between = sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
            rows.append((group, number, costs, audits, ends[0][0] + ends[-1][1], between + sum(n["illegal"] for n in nodes)))
        yield _batch(rows, _NODE_ARROW)


def _settle_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the ends of conversations, and their costs."""
    schema = pa.schema([("_group", pa.string()), ("_number", pa.int64()), ("_begin", pa.int32()), ("_end", pa.int32()),
                        ("_last", pa.bool_()), ("_cost", pa.int64()), ("_illegal", pa.int64())])
    for batch in batches:
        rows = []
        for node in batch.to_pylist():
            end, cost = whole(_table(node))
            rows.append((node["_group"], node["_number"], START, end, True, cost, node["illegal"]))
        yield _batch(rows, schema)


def _settle_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of the tables that were combined."""
    schema = pa.schema([("_group", pa.string()), ("_number", pa.int64()), ("_begin", pa.int32()), ("_end", pa.int32()), ("_last", pa.bool_())])
    for batch in batches:
        rows = []
        for node in batch.to_pylist():
            below = node["nodes"]
            states = borders([_table(n) for n in below], node["_begin"], node["_end"])
            for i, n in enumerate(below):
                rows.append((node["_group"], n["_number"], states[i], states[i + 1], node["_last"] and i + 1 == len(below)))
        yield _batch(rows, schema)


_EDIT = "_segment long, _place int, _edits string, _before array<string>, _given string, _after array<string>"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn of a segment; _given is the role of a turn that gets another."""
    schema = pa.schema([("_segment", pa.int64()), ("_place", pa.int32()), ("_edits", pa.string()), ("_before", pa.list_(pa.string())),
                        ("_given", pa.string()), ("_after", pa.list_(pa.string()))])
    for batch in batches:
        rows = []
        for s in batch.to_pylist():
            letters = s["audit"].encode() + (CLOSING[s["_end"]] if s["_last"] else b"")
            for place, e in enumerate(replay(letters, s["initials"], None, s["_begin"])):
                rows.append((s["_segment"], place, e.edits, e.before, e.role, e.after))
        yield _batch(rows, schema)


def conversation_key(column: Column) -> Column:
    """A conversation id of any type as a string that is never null."""
    return F.coalesce(F.to_json(F.struct(column.alias("c"))), F.lit("{}"))


@dataclass(frozen=True)
class Repaired:
    """``turns``: the input's rows with _group, _segment and _place (their order), _turn, _fault (blank, duplicate, truncated or null), _edits (the letters
    of empty turns before it, its own, and those that close the conversation) and _turns (role and text of all turns that come of it).
    ``conversations``: (_group, _cost, _illegal)."""

    turns: DataFrame
    conversations: DataFrame


def repair(
    turns: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", segment_turns: int = SEGMENT, fan: int = FAN,
) -> Repaired:
    columns = turns.columns
    role, text = F.coalesce(F.col(role_column), F.lit(" ")), F.coalesce(F.col(text_column), F.lit(" "))
    final = F.substring(F.rtrim(text, F.lit(ASCII_SPACE)), -1, 1)
    initial = F.substring(role, 1, 1)
    h1, h2 = fingerprint(F.to_json(F.struct(role.alias("r"), text.alias("t"))))
    named = turns.select(
        *[F.col(f"`{c}`") for c in columns], conversation_key(F.col(conversation_column)).alias("_group"), F.col(turn_column).alias("_turn"),
        role.alias("_role"), text.alias("_text"), h1.alias("_h1"), h2.alias("_h2"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("_initial"),
        F.when(final == "", BLANK).when(~final.isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("_kind"),
    )
    order = ["_group", "_turn", "_role", "_h1", "_h2"]
    extra = [T.StructField("_segment", T.LongType()), T.StructField("_place", T.IntegerType())]
    cut = once(
        named.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(segment_turns), T.StructType([*named.schema.fields, *extra])),
        "cut_turns",
    )
    here = F.struct("_segment", "_place")
    # Written, so that Spark can split the turns of a text that a conversation repeats without end.
    repeated = once(
        cut.groupBy("_group", "_h1", "_h2").agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeated"
    )
    again = cut.select("_group", "_h1", "_h2", "_segment", "_place").join(repeated, ["_group", "_h1", "_h2"]).filter(here > F.col("_first"))
    fault = F.when((F.col("_kind") != BLANK) & F.col("_again"), DUPLICATE).otherwise(F.col("_kind"))
    faults = (
        cut.select("_group", "_segment", "_place", "_initial", "_kind")
        .join(again.select("_segment", "_place", F.lit(True).alias("_again")), ["_segment", "_place"], "left")
        .withColumn("_fault", fault)
    )
    # A segment's turns: at most SEGMENT.
    gathered = faults.groupBy("_segment").agg(
        F.first("_group").alias("_group"), F.array_sort(F.collect_list(F.struct("_place", "_initial", "_fault"))).alias("turns")
    )
    segments = once(gathered.mapInArrow(_tables, _NODE).withColumnRenamed("_number", "_segment"), "segments")
    numbered, most = _numbered(segments)
    levels = [numbered]
    while most > 1:
        up = F.floor(F.col("_number") / fan)
        nodes = F.array_sort(F.collect_list(F.struct(*[c for c in ("_number", "costs", "audits", "initials", "illegal")])))
        groups = levels[-1].groupBy("_group", up.alias("_up")).agg(nodes.alias("nodes")).withColumnRenamed("_up", "_number")
        levels.append(once(groups.mapInArrow(_combine, _NODE), "combined"))
        most = -(-most // fan)
    settled = once(
        levels[-1].mapInArrow(_settle_whole, "_group string, _number long, _begin int, _end int, _last boolean, _cost long, _illegal long"), "settled"
    )
    states = settled.drop("_cost", "_illegal")
    for below in levels[-2::-1]:
        up = F.floor(F.col("_number") / fan)
        nodes = F.array_sort(F.collect_list(F.struct("_number", "costs", "audits")))
        groups = below.groupBy("_group", up.alias("_up")).agg(nodes.alias("nodes")).withColumnRenamed("_up", "_number")
        states = states.join(groups, ["_group", "_number"]).mapInArrow(
            _settle_below, "_group string, _number long, _begin int, _end int, _last boolean"
        )
    audit = F.get("audits", F.col("_begin") * 4 + F.col("_end")).alias("audit")
    edits = (
        numbered.join(states, ["_group", "_number"]).select("_segment", "initials", audit, "_begin", "_end", "_last").mapInArrow(_edit, _EDIT)
    )
    known = faults.select("_segment", "_place", "_fault")
    own = F.when(F.col("_edits").rlike("^I*[KR]"), F.array(F.struct(
        F.when(F.col("_edits").rlike("^I*K"), F.col("_role")).otherwise(F.col("_given")).alias("role"), F.col("_text").alias("text")
    ))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    empty = [F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))) for c in ("_before", "_after")]
    fault_name = F.get(F.array(*map(F.lit, ("blank", "duplicate", "truncated"))), F.col("_fault") - 1)
    done = cut.join(known, ["_segment", "_place"]).join(edits, ["_segment", "_place"]).select(
        *[F.col(f"`{c}`") for c in columns], "_group", "_segment", "_place", "_turn",
        F.when(F.col("_fault") > 0, fault_name).alias("_fault"), "_edits", F.concat(empty[0], own, empty[1]).alias("_turns"),
    )
    return Repaired(done, settled.select("_group", "_cost", "_illegal"))


def _numbered(segments: DataFrame) -> tuple[DataFrame, int]:
    """Segments with their number within the conversation, and the largest count of a conversation.

    A task numbers a conversation's segments without gaps, so counts by task are enough."""
    task, number = F.shiftright("_segment", 32), F.col("_segment").bitwiseAND(0xFFFFFFFF)
    counts = segments.groupBy("_group", task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_least"))
    earlier = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = once(counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "bases")
    most = bases.agg(F.max(F.col("_base") + F.col("_n"))).first()[0] or 0
    named = segments.withColumn("_task", task).join(bases, ["_group", "_task"])
    return named.select(*segments.columns, (F.col("_base") + number - F.col("_least")).alias("_number")), most


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns go through a hash one by one; only the letters of one conversation are held."""
    schema = pa.schema([("_group", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    group, letters, digest, lines = None, [], hashlib.sha256(), 0
    for batch in batches:
        out = []
        for own, edits, text, n in zip(*(batch[c].to_pylist() for c in ("_group", "_edits", "_lines", "_n")), strict=True):
            if own != group:
                if group is not None:
                    out.append((group, "".join(letters), digest.hexdigest()))
                group, letters, digest, lines = own, [], hashlib.sha256(), 0
            letters.append(edits)
            if n:
                digest.update((("\n" if lines else "") + text).encode())
                lines += n
        yield _batch(out, schema)
    if group is not None:
        yield _batch([(group, "".join(letters), digest.hexdigest())], schema)


def summary(repaired: Repaired) -> DataFrame:
    """For each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of the repaired lines ``role:text``.

    A SHA-256 takes its input in order, so the turns of one conversation go through one task, as a stream."""
    turns = repaired.turns

    def faults(name: str) -> Column:
        return F.count_if(F.col("_fault") == name).alias(name)

    spans = (F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")).cast("long")
    counts = turns.groupBy("_group").agg(F.coalesce(spans, F.lit(0)).cast("long").alias("gaps"), *map(faults, ("blank", "duplicate", "truncated")))
    line = F.transform("_turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    streams = turns.select(
        "_group", "_segment", "_place", "_edits", F.array_join(line, "\n").alias("_lines"), F.size("_turns").alias("_n")
    ).repartition("_group").sortWithinPartitions("_group", "_segment", "_place")
    digests = streams.mapInArrow(_digests, "_group string, audit string, repaired_sha256 string")
    return counts.join(repaired.conversations, "_group").join(digests, "_group").select(
        "_group", "gaps", "blank", "duplicate", "truncated", F.col("_illegal").alias("illegal"), F.col("_cost").alias("cost"), "audit", "repaired_sha256"
    )


def damaged(turns: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``turns`` with faults for trials, chosen by the CRC-32 of ``conversation:turn`` modulo 20: 0 drops the turn, 1 empties its text,
    2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's. Nulls of these four columns count as one space; null numbers and ids stay."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation_column, turn_column)]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    text, role = F.coalesce(F.col(text_column), F.lit(" ")), F.coalesce(F.col(role_column), F.lit(" "))
    new = {
        text_column: F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text),
        role_column: F.when(F.col("_damage") == 4, "user").otherwise(role),
    }
    copies = F.when(F.col("_damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.withColumn("_damage", kind).filter("_damage <> 0").withColumn("_copy", F.explode(copies))
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in turns.columns])
