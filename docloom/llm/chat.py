"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant. Every turn
of the input is kept, relabelled, or merged into the turn before it, and empty turns may be inserted; each has a cost. Over the four
states of the legal-turn automaton a turn's role is a table of costs from state to state, and the cheapest repair is the shortest path.

Costs of consecutive turns combine like matrices (least sum instead of sum of products), so a conversation of any length
is cut into segments: turns are range-partitioned by conversation and turn, every task sums up its segments as
4 x 4 tables, a conversation's tables give the states at all segment borders, and the segments then choose their turns on their
own. No task ever holds more than a segment of turns, even if a third of all turns are one conversation's.

The repaired turns are rendered as pieces of text: a conversation is its pieces in order, one after the other.

Defined results: a null role or one that is not known must be relabelled; null text is empty; null conversation ids are one
conversation, null turns come first; turns of equal number follow by role and text, repeated rows stay; texts cannot
forge markers (``<|`` is rendered as ``< |``); an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.columns import fingerprint, once

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
NEVER = 1 << 40
SEGMENT = 1000

Move = tuple[int, str, int, tuple[int, ...]]  # cost, what is done, the turn's new role, empty turns before it


def _insertions(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which ``role`` may follow."""
    paths: list[tuple[int, ...]] = [()]
    for _ in range(3):
        for path in paths:
            if role in NEXT[path[-1] if path else state]:
                return path
        paths = [(*path, step) for path in paths for step in NEXT[path[-1] if path else state] if step != SYSTEM]
    return None


def _moves(role: int) -> list[list[Move | None]]:
    """For an input role (0 if not known): the cheapest move from each state to each state."""
    table: list[list[Move | None]] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        options: list[Move] = []
        for new in (SYSTEM, USER, ASSISTANT):
            if (inserted := _insertions(state, new)) is not None:
                done = "keep" if new == role else "relabel"
                options.append((INSERT * len(inserted) + RELABEL * (new != role), done, new, inserted))
        if state != START:
            options.append((MERGE + RELABEL * (state != role), "merge", state, ()))
        for move in options:
            old = table[state][move[2]]
            if old is None or move[0] < old[0]:
                table[state][move[2]] = move
    return table


MOVES = [_moves(role) for role in range(4)]
COSTS = np.array([[[NEVER if m is None else m[0] for m in row] for row in table] for table in MOVES])
FINISH: list[tuple[int, ...]] = [() if s == ASSISTANT else (*(_insertions(s, ASSISTANT) or ()), ASSISTANT) for s in range(4)]
FINISH_COST = np.array([INSERT * len(f) for f in FINISH])


def role_numbers(roles: list[str | None]) -> list[int]:
    known = {r: i + 1 for i, r in enumerate(ROLES)}
    return [known.get((r or "").strip().lower(), 0) for r in roles]


def total_costs(roles: list[int]) -> np.ndarray:
    """The least cost of all given turns from each state to each state."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for role in roles:
        total = np.minimum((total[:, :, None] + COSTS[role][None]).min(1), NEVER)
    return total


def borders(tables: list[np.ndarray]) -> tuple[list[int], int]:
    """The states at the borders of a conversation's segments, and its whole cost."""
    ahead = [FINISH_COST]
    for table in reversed(tables):
        ahead.append(np.minimum((table + ahead[-1][None]).min(1), NEVER))
    ahead.reverse()
    states = [START]
    for table, rest in zip(tables, ahead[1:], strict=True):
        states.append(int((table[states[-1]] + rest).argmin()))
    return states, int(ahead[0][START])


def choose(roles: list[int], begin: int, end: int) -> list[Move]:
    """The cheapest moves of a segment between its border states."""
    ahead = [np.where(np.arange(4) == end, 0, NEVER)]
    for role in reversed(roles):
        ahead.append(np.minimum((COSTS[role] + ahead[-1][None]).min(1), NEVER))
    ahead.reverse()
    moves, state = [], begin
    for role, rest in zip(roles, ahead[1:], strict=True):
        to = int((COSTS[role][state] + rest).argmin())
        moves.append(MOVES[role][state][to])
        state = to
    return moves


def _empty(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n<|end|>\n"


def render(move: Move, state: int, text: str | None) -> str:
    """The piece of a turn; it also closes the turn before it."""
    body = (text or "").replace("<|", "< |")
    if move[1] == "merge":
        return f"\n\n{body}"
    closing = "" if state == START else "\n<|end|>\n"
    return closing + "".join(map(_empty, move[3])) + f"<|{ROLES[move[2] - 1]}|>\n{body}"


def _cut(segment_turns: int):
    """Number the segments of sorted turns; a segment's last turn carries its table of costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            group = batch["_group"].to_pylist()
            roles = role_numbers(batch["_role"].to_pylist())
            segments, places, tables, begin = [], [], [], 0
            for i in range(batch.num_rows):
                segments.append((task << 32) | number)
                places.append(i - begin)
                last = i + 1 == batch.num_rows or group[i + 1] != group[i] or i + 1 - begin >= segment_turns
                tables.append(total_costs(roles[begin : i + 1]).reshape(-1).tolist() if last else None)
                if last:
                    begin, number = i + 1, number + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(segments, pa.int64()), pa.array(places, pa.int32()), pa.array(tables, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "_segment", "_place", "_table"],
            )

    return run


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"_segment": [], "_begin": [], "_end": [], "_last": [], "_cost": []}
        for row in batch["segments"].to_pylist():
            states, cost = borders([np.array(s["_table"], np.int64).reshape(4, 4) for s in row])
            for i, s in enumerate(row):
                for column, value in zip(out.values(), (s["_segment"], states[i], states[i + 1], i + 1 == len(row), cost), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["_segment"], pa.int64()), pa.array(out["_begin"], pa.int32()), pa.array(out["_end"], pa.int32()),
             pa.array(out["_last"], pa.bool_()), pa.array(out["_cost"], pa.int64())],
            names=list(out),
        )


def _repair(kept: list[str]):
    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        begin, end, last = table["_begin"][0].as_py(), table["_end"][0].as_py(), table["_last"][0].as_py()
        moves = choose(role_numbers(table["_role"].to_pylist()), begin, end)
        pieces, state = [], begin
        for move, text in zip(moves, table["_text"].to_pylist(), strict=True):
            pieces.append(render(move, state, text))
            state = move[2]
        inserted = [len(m[3]) for m in moves]
        if last:
            pieces[-1] += "\n<|end|>\n" + "".join(map(_empty, FINISH[state]))
            inserted[-1] += len(FINISH[state])
        return pa.RecordBatch.from_arrays(
            [
                *[table[c] for c in kept], table["_segment"], table["_place"], pa.array([m[1] for m in moves]),
                pa.array([ROLES[m[2] - 1] for m in moves]), pa.array(inserted, pa.int32()), table["_cost"], pa.array(pieces, pa.string()),
            ],
            names=[*kept, "_segment", "_place", "_done", "_new_role", "_inserted", "_cost", "_piece"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # one segment at most
        current = None
        for batch in batches:
            segment = batch["_segment"].to_numpy()
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if waiting and segment[a] != current:
                    yield settle(waiting)
                    waiting = []
                current = segment[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield settle(waiting)

    return run


def repair(
    turns: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", segment_turns: int = SEGMENT,
) -> DataFrame:
    """The rows of ``turns`` with _segment and _place (their order), _done (keep, relabel or merge), _new_role, _inserted (empty turns
    added with it), _cost (of the whole conversation) and _piece (its part of the rendered text)."""
    columns = turns.columns
    named = turns.select(
        *[F.col(c) for c in columns], F.coalesce(F.to_json(F.struct(F.col(conversation_column).alias("c"))), F.lit("{}")).alias("_group"),
        F.col(role_column).alias("_role"), F.col(text_column).alias("_text"), fingerprint(F.coalesce(F.col(text_column), F.lit("")))[0].alias("_hash"),
    )
    order = ["_group", turn_column, "_role", "_hash"]
    sorted_turns = named.repartitionByRange(*order).sortWithinPartitions(*order)
    extra = [T.StructField("_segment", T.LongType()), T.StructField("_place", T.IntegerType()), T.StructField("_table", T.ArrayType(T.LongType()))]
    cut = once(sorted_turns.mapInArrow(_cut(segment_turns), T.StructType([*named.schema.fields, *extra])), "turns")
    # A conversation's tables, one for each thousand turns; sorted by task and number, and so by turn.
    per_conversation = cut.filter("_table IS NOT NULL").groupBy("_group").agg(
        F.array_sort(F.collect_list(F.struct("_segment", "_table"))).alias("segments")
    )
    plan = per_conversation.select("segments").mapInArrow(_plan, "_segment long, _begin int, _end int, _last boolean, _cost long")
    # A segment may lie in several splits of what was written: its turns must meet again.
    ready = cut.drop("_table").join(plan, "_segment").repartition("_segment").sortWithinPartitions("_segment", "_place")
    result = [T.StructField("_done", T.StringType()), T.StructField("_new_role", T.StringType()), T.StructField("_inserted", T.IntegerType()),
              T.StructField("_cost", T.LongType()), T.StructField("_piece", T.StringType())]
    return ready.mapInArrow(_repair(columns), T.StructType([*turns.schema.fields, *extra[:2], *result]))
