"""Packing by cutting stock: documents' tokens into sequences of fixed length with little padding.

Every document becomes its ids and an end id, cut into full sequences and one rest. Rests are rounded up to one of a few
hundred lengths, and counted: the histogram is all that the driver sees. A linear program chooses how often to use which pattern of
lengths; its columns are generated by pricing with a knapsack over the capacity, until no pattern improves
the bound any more. The patterns' counts are rounded down, what is left is filled in by decreasing length. Patterns then
stand for blocks of sequence ids. Every piece gets its rank among the pieces of its length (a running count
within its task, plus the counts of earlier tasks), and the rank names its pattern, its sequence and its place in
it by arithmetic; the offset in the sequence is the sum of the true lengths before it.

Nothing is gathered by length: a length that a third of all documents share only has larger counts. Defined results: a null or
empty text is the end id alone; repeated rows are packed as documents of their own; an empty table gives an empty result; columns other
than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import vocab
from docloom.llm.columns import once
from docloom.llm.textscan import slices

LENGTH = 4096
END = 2
#: Lengths are rounded up to a multiple of this for the program; the difference is padding.
GRAIN = 16
#: The program ends when its bound is this near; more pivots only save padding.
GAP = 2e-4
PIVOTS = 4000


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sorted_sizes = sizes[order]
    for room in range(int(sorted_sizes[0]), capacity + 1):
        fits = order[: np.searchsorted(sorted_sizes, room, "right")]
        totals = best[room - sizes[fits]] + values[fits]
        k = int(totals.argmax())
        if totals[k] > best[room - 1] + 1e-15:
            best[room], choice[room] = totals[k], fits[k]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), pattern


def _program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, in fractions, so that the demand is met exactly."""
    m = len(sizes)
    fill = capacity // sizes
    patterns = np.diag(fill).astype(np.int64)
    inverse = np.diag(1.0 / fill)
    uses = demand / fill
    for _ in range(PIVOTS):
        prices = inverse.sum(0)
        value, pattern = _knapsack(prices, sizes, capacity)
        # The prices divided by the value of the best pattern are feasible for the dual: a lower bound.
        if value <= 1 + 1e-9 or uses.sum() * (1 - 1 / value) <= max(0.5, GAP * uses.sum()):
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        ratios = np.full(m, np.inf)
        ratios[up] = uses[up] / direction[up]
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        uses = np.maximum(uses - step * direction, 0)
        uses[leaving] = step
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        patterns[:, leaving] = pattern
    return patterns, uses


def cutting_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): patterns that hold exactly ``demand`` pieces of each size, in few sequences."""
    plan, left = [], demand.astype(np.int64).copy()
    if not len(sizes):
        return plan
    patterns, uses = _program(sizes, demand.astype(float), capacity)
    for k in np.flatnonzero(uses >= 1 - 1e-6):
        pattern = patterns[:, k]
        held = pattern > 0
        times = min(int(uses[k] + 1e-6), int((left[held] // pattern[held]).min()))
        if times:
            plan.append((pattern.copy(), times))
            left -= times * pattern
    # What rounding left: fill sequence after sequence by decreasing size.
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for k in np.argsort(-sizes):
            pattern[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(pattern[k] * sizes[k])
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


@dataclass(frozen=True)
class Slots:
    """For each size: where its pieces of a rank go. Blocks of ranks, each with its pieces per sequence and first sequence."""

    begins: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    first: dict[int, np.ndarray]

    @classmethod
    def of(cls, sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> Slots:
        rows: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
        taken, sequence = dict.fromkeys(rows, 0), 0
        for pattern, times in plan:
            for k in np.flatnonzero(pattern):
                size, each = int(sizes[k]), int(pattern[k])
                rows[size].append((taken[size], each, sequence))
                taken[size] += each * times
            sequence += times
        tables = {s: np.array(r, np.int64).reshape(-1, 3) for s, r in rows.items()}
        return cls(*({s: t[:, i] for s, t in tables.items()} for i in range(3)))

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and order within it of pieces of the given sizes and ranks."""
        sequence, order = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            block = np.searchsorted(self.begins[size], ranks[at], "right") - 1
            inside = ranks[at] - self.begins[size][block]
            each = self.each[size][block]
            sequence[at] = self.first[size][block] + inside // each
            order[at] = (LENGTH - size) * 65536 + inside % each
        return sequence, order


def pieces(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
    length: int = LENGTH, grain: int = GRAIN, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, size, task, local): every piece, its rounded length and its running
    number among those in its task; with ``with_ids`` the ids too, as little-endian unsigned 32-bit integers."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = vocab.remembered("word_bpe", path, vocab.word_bpe)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                ids, at = vocab.encode_caseless(data, offsets, memory)
                out: dict[str, list] = {c: [] for c in ("row", "start", "length", "ids_crc32", "doc_tokens", "size", "local", "ids")}
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    raw = np.append(ids[a:b], np.uint16(end)).astype("<u4")
                    for start in range(0, len(raw), length):
                        piece = raw[start : start + length].tobytes()
                        n = len(piece) // 4
                        size = -(-n // grain)
                        local = seen.get(size, 0)
                        seen[size] = local + 1
                        values = (i, start, n, zlib.crc32(piece), len(raw), size, local, piece if with_ids else None)
                        for values_of, value in zip(out.values(), values, strict=True):
                            values_of.append(value)
                columns = [
                    rows["id"].take(pa.array(out["row"], pa.int64())),
                    *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")],
                    pa.array(out["size"], pa.int32()), pa.array([task] * len(out["row"]), pa.int32()), pa.array(out["local"], pa.int64()),
                ]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "size", "task", "local"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    longs = ("start", "length", "ids_crc32", "doc_tokens")
    schema = [T.StructField("id", source.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in longs]]
    schema += [T.StructField("size", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("local", T.LongType())]
    if with_ids:
        schema.append(T.StructField("ids", T.BinaryType()))
    return source.mapInArrow(run, T.StructType(schema))


def place(cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """``cut`` (written, as it is read several times) with sequence_id and offset instead of size, task and local."""
    counts = cut.groupBy("task", "size").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # As many rows as there are rounded lengths.
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    slots = Slots.of(sizes, cutting_plan(sizes, demand, length // grain))
    columns = [c for c in cut.columns if c not in ("size", "task", "local")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, order = slots.place(batch["size"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in columns], pa.array(sequence), pa.array(order)], names=[*columns, "sequence_id", "_order"]
            )

    ranked = cut.join(bases, ["task", "size"]).select(*columns, "size", (F.col("base") + F.col("local")).alias("rank"))
    fields = [*[cut.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("_order", T.LongType())]
    before = Window.partitionBy("sequence_id").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(run, T.StructType(fields)).select(
        *columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    )


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    return place(once(pieces(docs, id_column, text_column, with_ids=with_ids), "pieces")).withColumnRenamed("id", id_column)
