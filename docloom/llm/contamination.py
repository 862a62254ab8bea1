"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

An item is cut into units: windows of ``window`` words, or the whole item if it is shorter or no window is given. A unit
is the set of its word shingles. A document holds a unit if some stretch of the document as long as the unit has at least the
share ``containment`` of these shingles; at 1.0 and one occurrence each, that is the unit word by word.

The shingles of all units are counted in the corpus and ordered by rarity. A unit of ``m`` shingles of which ``o`` are
needed must share one of its ``m - o + 1`` rarest with the document: only these are looked up at the positions of a
document. A hit's position bounds where the unit can lie; lengths rule out documents that are too short; what is left is
verified, word by word at 1.0, else by counting shingles in every stretch that the bounds allow.

Documents stay where they are. Items come to them in blocks of bounded size, each broadcast once, whatever the
length of the benchmark; with several blocks a document's hits are carried along its row and merged.

Defined results: null and blank texts have no words and no hits; items without words or id match nothing; an item that
repeats counts once by its id; repeated document rows are judged alike, one row each; empty tables are fine; other columns pass
through, whatever their names: the findings travel in one struct column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.columns import once, text_hash, without_rows
from docloom.llm.textscan import LOWER, runs, slices

WINDOW = 10
SHINGLE = 5
#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 8 << 20

#: Letters, digits and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
FILTER_BITS = 22
PIECE = 1 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),  # start, end, start, end, ... of merged stretches of hit words
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a polynomial of its bytes; worked in pieces of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    up = down = np.empty(0, np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        a, b = int(starts[at]), int(ends[last - 1])
        if b - a > len(up):
            size = max(b - a, min(PIECE, int(ends[-1])))
            up, down = _powers(BASE, size), _powers(BASE_INVERSE, size)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[at:last] - a, ends[at:last] - a
        out[at:last] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = last
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, not minding where texts end."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[k : k + n]
    return _mixed(out + np.uint64(size))


@dataclass
class Text:
    """The words of some texts: lower-case bytes, places, hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray) -> Text:
        low = LOWER[data]
        starts, ends, first = runs(WORD[low], offsets)
        return cls(low, starts, ends, first, word_hashes(low, starts, ends))

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


@dataclass
class Unit:
    words: tuple[bytes, ...]
    items: list[str]
    size: int  # of its shingles
    shingles: np.ndarray


@dataclass
class Block:
    """Units, and by shingle size the prefix shingles with the (unit, place) pairs that they stand for."""

    units: list[Unit]
    containment: float
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def index(self, counts: dict[int, int]) -> None:
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for u, unit in enumerate(self.units):
            distinct = list(dict.fromkeys(unit.shingles.tolist()))
            need = self.need(len(distinct))
            rare = sorted(distinct, key=lambda h: (counts.get(h, 0), h))[: len(distinct) - need + 1]
            for h in rare:
                for place in np.flatnonzero(unit.shingles == np.uint64(h)).tolist()[: 1 if self.containment == 1 else None]:
                    entries.setdefault(unit.size, []).append((h, u, place))
        for size, rows in entries.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            keys, begins = np.unique(hashes, return_index=True)
            marks = np.zeros(1 << FILTER_BITS, bool)
            marks[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.tables[size] = (
                marks, keys, np.append(begins, len(rows)),
                np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64),
            )

    def need(self, distinct: int) -> int:
        return max(1, math.ceil(self.containment * distinct - 1e-9))

    def find(self, text: Text) -> Iterator[tuple[int, int, int]]:
        """(unit, first word, end word) of every place that holds a unit; places count through all texts."""
        texts = len(text.first) - 1
        owner = np.repeat(np.arange(texts), np.diff(text.first))
        for size, (marks, keys, begins, units, places) in self.tables.items():
            hashes = shingle_hashes(text.hashes, size)
            at = np.flatnonzero(marks[hashes >> np.uint64(64 - FILTER_BITS)])
            at = at[owner[at] == owner[at + size - 1]]
            slot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            same = keys[slot] == hashes[at]
            for p, k in zip(at[same].tolist(), slot[same].tolist(), strict=True):
                low, high = int(text.first[owner[p]]), int(text.first[owner[p] + 1])
                for e in range(int(begins[k]), int(begins[k + 1])):
                    unit = self.units[units[e]]
                    if self.containment == 1:
                        a = p - int(places[e])
                        b = a + len(unit.words)
                        if a >= low and b <= high and tuple(text.words(a, b)) == unit.words:
                            yield int(units[e]), a, b
                    else:
                        yield from self._verify(text, int(units[e]), p, low, high)

    def _verify(self, text: Text, u: int, p: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Stretches as long as the unit around shingle ``p`` that hold enough of its shingles."""
        unit = self.units[u]
        wanted = {}
        for i in range(len(unit.words) - unit.size + 1):
            wanted[unit.words[i : i + unit.size]] = None
        need, span = self.need(len(wanted)), len(unit.words)
        begin, end = max(low, p - (span - unit.size)), min(high, p + span)
        words = text.words(begin, end)
        here = [tuple(words[i : i + unit.size]) for i in range(len(words) - unit.size + 1)]
        here = [h if h in wanted else None for h in here]
        wide = min(span, len(words)) - unit.size + 1
        for i in range(max(1, len(here) - wide + 1)):
            part = here[i : i + wide]
            if len(set(part) - {None}) >= need:
                yield u, begin + i, begin + i + min(span, len(words))


def read_items(ids: list[str], texts: list[str | None], window: int | None, shingle: int, containment: float) -> Block:
    table = pa.array(texts, pa.large_string()).fill_null("")
    offsets = np.frombuffer(table.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(table.buffers()[2], np.uint8) if table.buffers()[2] is not None else np.empty(0, np.uint8)
    text = Text.read(data[: offsets[-1]], offsets)
    units: dict[tuple[bytes, ...], Unit] = {}
    for i, item in enumerate(ids):
        a, b = int(text.first[i]), int(text.first[i + 1])
        words, hashes = text.words(a, b), text.hashes[a:b]
        wide = min(window or len(words), len(words))
        for k in range(len(words) - wide + 1 if words else 0):
            key = tuple(words[k : k + wide])
            if key not in units:
                size = min(shingle, wide)
                units[key] = Unit(key, [], size, shingle_hashes(hashes[k : k + wide], size))
            if item not in units[key].items[-1:]:
                units[key].items.append(item)
    return Block(list(units.values()), containment)


def blocks_of(items: DataFrame, id_column: str, text_column: str, window: int | None, shingle: int, containment: float,
              block_bytes: int) -> Iterator[Block]:
    """The items in blocks, one in the driver's memory at a time."""
    ids, texts, held = [], [], 0
    rows = items.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).alias("t")).filter(
        F.col("i").isNotNull() & (F.length("t") > 0)
    )
    for row in rows.toLocalIterator():
        if texts and held + len(row.t) > block_bytes:
            yield read_items(ids, texts, window, shingle, containment)
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        held += len(row.t)
    if texts:
        yield read_items(ids, texts, window, shingle, containment)


def _count(shingles: dict[int, np.ndarray]):
    """Occurrences of the given shingles (sorted, by size) in all texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts = {}, {}
        for size, keys in shingles.items():
            marks[size] = np.zeros(1 << FILTER_BITS, bool)
            marks[size][keys >> np.uint64(64 - FILTER_BITS)] = True
            counts[size] = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch, "_text"):
                text = Text.read(data, offsets)
                for size, keys in shingles.items():
                    hashes = shingle_hashes(text.hashes, size)
                    hashes = hashes[marks[size][hashes >> np.uint64(64 - FILTER_BITS)]]
                    slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    counts[size] += np.bincount(slot[keys[slot] == hashes], minlength=len(keys))
        for size, keys in shingles.items():
            seen = counts[size] > 0
            yield pa.RecordBatch.from_pydict({"h": pa.array(keys[seen].view(np.int64)), "n": pa.array(counts[size][seen])})

    return run


def rarity(docs: DataFrame, text_column: str, block: Block) -> dict[int, int]:
    """How often each shingle of the block's units occurs in the corpus; as many as the block has at most."""
    by_size: dict[int, list[np.ndarray]] = {}
    for unit in block.units:
        by_size.setdefault(unit.size, []).append(unit.shingles)
    shingles = {size: np.unique(np.concatenate(parts)) for size, parts in by_size.items()}
    counted = docs.select(F.col(text_column).alias("_text")).mapInArrow(_count(shingles), "h long, n long")
    return {r.h & 0xFFFFFFFFFFFFFFFF: r.n for r in counted.groupBy("h").agg(F.sum("n").alias("n")).collect()}


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _apply(block, kept: list[str]):
    kind = pa.struct([
        pa.field("n_words", pa.int64()), pa.field("spans", pa.list_(pa.int64())), pa.field("items", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                text = Text.read(data, offsets)
                before = rows["_found"].to_pylist()
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for unit, a, b in block.value.find(text) if block is not None else ():
                    i = int(np.searchsorted(text.first, a, "right")) - 1
                    at = int(text.first[i])
                    spans.setdefault(i, []).append((a - at, b - at))
                    items.setdefault(i, set()).update(block.value.units[unit].items)
                counts = np.diff(text.first).tolist()
                found = []
                for i, old in enumerate(before):
                    pairs = old["spans"] if old else []
                    pairs = list(zip(pairs[::2], pairs[1::2], strict=True))
                    found.append({
                        "n_words": counts[i],
                        "spans": _merge(pairs + spans.get(i, [])),
                        "items": sorted(items.get(i, set()).union(old["items"] if old else ())),
                    })
                yield pa.RecordBatch.from_arrays(
                    [*[rows[c] for c in kept], pa.array(found, kind)], names=[*kept, "_found"]
                )

    return run


def with_findings(
    docs: DataFrame,
    items: DataFrame,
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    window: int | None = WINDOW,
    shingle: int = SHINGLE,
    containment: float = 1.0,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the struct _found: n_words, spans of hit words, items."""
    kept = docs.columns if keep is None else keep
    context = docs.sparkSession.sparkContext
    indexed = []
    for block in blocks_of(items, item_id_column, item_text_column, window, shingle, containment, block_bytes):
        block.index(rarity(docs, text_column, block))
        indexed.append(context.broadcast(block))
    kind = FOUND.simpleString()
    rows = docs.select(
        *[F.col(c) for c in kept], F.col(text_column).alias("_text"), F.expr(f"cast(null as {kind})").alias("_found")
    )
    fields = [docs.schema[c] for c in kept]
    found = T.StructField("_found", FOUND)
    for block in indexed[:-1]:
        rows = rows.mapInArrow(_apply(block, [*kept, "_text"]), T.StructType([*fields, T.StructField("_text", T.StringType()), found]))
    return rows.mapInArrow(_apply(indexed[-1] if indexed else None, kept), T.StructType([*fields, found]))


def n_hit(spans: Column) -> Column:
    """Number of words in the merged stretches."""
    return F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda n, x: n + x
    )


def keep_clean(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` in which no unit of an item was found."""
    keyed = docs.select(
        F.col(id_column).alias("_id"), text_hash(F.col(text_column)).alias("_h"), F.col(text_column).alias("_t")
    )
    found = with_findings(keyed, items, "_t", keep=["_id", "_h"], **options)
    leaks = once(found.filter(F.size("_found.spans") > 0).select("_id", "_h").distinct(), "leaks")
    return without_rows(docs, leaks, id_column, text_column)
