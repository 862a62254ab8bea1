"""SimHash near-duplicates: fingerprints, all pairs within a radius by tiled exact comparison, connected components.

A text's fingerprint has a bit for each of 64 positions: 1 if more than half of its word shingles' XXH64 hashes have
it; a second word of 64 bits, from the hashes mixed once more, can be added where 64 bits are too few to tell many unrelated texts
from similar ones. Equal fingerprints are one class, so copies cost nothing more. Classes are dealt to tiles by the vector of
population counts of the first word's parts (or by the count of all bits, with one lane): two fingerprints within ``radius``
bits have vectors whose absolute differences sum to at most ``radius``. Every class stays in its own tile and visits the neighbouring tiles that can hold a partner, from one side only;
tile pairs further apart are never formed. Inside a tile numpy compares all residents with each other and with the visitors
(exclusive or, bit counts), exactly and without a limit on partners.

A tile of many residents is split, and its visitors too, from counts of a grid of at most 17^4 cells. A task
reports only links that join something new within the tile, so links are fewer than the rows that it read.

Where fingerprints only propose (``keep_one``), classes are texts of equal shingle sets, fingerprints are made of the sets, and a link
joins only if the two sets have the asked Jaccard similarity, compared shingle by shingle. Such sets are of similar size, too: the
smaller has at least that share of the larger one's shingles. So these classes are dealt to tiles by the logarithms of their sizes, and sizes
further apart are never compared. A refuted link may have stood for
others of its tile; so the groups of refuted links are compared once more, and there every pair that the confirmed links do not
join already is confirmed or refuted.

Defined results: null and blank texts have fingerprint 0 and are linked like any other; repeated rows get the
same result, one row each; ``component_id`` is the smallest id that can be reached, ignoring null ids; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.columns import once, text_hash
from docloom.llm.textscan import slices

SHINGLE = 3
RADIUS = 2
SEED = 42
LANES = 4
WORDS_AT_ONCE = 500_000
TILE_ROWS = 16_384
VISITORS = 262_144
#: The pipeline's stage: texts are alike if their sets of 5-word shingles have this Jaccard similarity.
WIDE_SHINGLE = 5
SIMILAR = 0.8
#: Of 128 bits: texts of similarity 0.8 with equally many shingles are 19.4 bits apart on average, give or take 4.1, so 0.4 % of them
#: are further apart than this. Less similar ones come as near, too; the shingle sets refute them.
WIDE_RADIUS = 30
WIDE_TILE_ROWS = 65_536
WIDE_VISITORS = 65_536
#: Cells of set sizes for the factor of 1 / SIMILAR between two sizes; cells in all, enough for any set.
SIZE_STEPS = 4
SIZE_CELLS = 1024
#: Fingerprints compared at once: what lies between stays in the processor's caches.
HIGH, WIDE = 32, 1024
#: Tasks that tiles of sizes are dealt to.
MOST_TASKS = 10_000


def _hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, some at a time."""
    words = text.lower().split()
    if not words:
        return
    size = min(size, len(words))
    for first in range(0, len(words) - size + 1, WORDS_AT_ONCE):
        part = words[first : first + WORDS_AT_ONCE + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[: len(part) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _second(hashes: np.ndarray) -> np.ndarray:
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashes(text, size)]))


def fingerprint_texts(
    data: np.ndarray, offsets: np.ndarray, size: int, words: int = 1, names: np.ndarray | None = None
) -> np.ndarray:
    """(texts, words) array of 64-bit words. With ``names``, a (2, texts) array to fill with a hash and the size of each text's shingle
    set, the fingerprints are those of the sets: a shingle counts once."""
    raw, n = data.tobytes(), len(offsets) - 1
    counts, totals = np.zeros((n, 64 * words), np.int64), np.zeros(n, np.int64)
    waiting, owners, held = [], [], 0

    def settle() -> None:
        nonlocal waiting, owners, held
        if waiting:
            lengths = np.array([len(h) for h in waiting])
            hashes = np.concatenate(waiting)
            for k in range(words):
                votes = _votes(_second(hashes) if k else hashes)
                sums = np.add.reduceat(votes, np.cumsum(lengths) - lengths, axis=0, dtype=np.int32)
                np.add.at(counts[:, 64 * k : 64 * k + 64], owners, sums)
            np.add.at(totals, owners, lengths)
        waiting, owners, held = [], [], 0

    def hashed(i: int) -> Iterator[np.ndarray]:
        text = raw[offsets[i] : offsets[i + 1]]
        if names is None:
            yield from _hashes(text, size)
            return
        distinct = shingle_set(text, size)
        names[:, i] = _second(distinct).sum(dtype=np.uint64), len(distinct)
        for first in range(0, len(distinct), WORDS_AT_ONCE):
            yield distinct[first : first + WORDS_AT_ONCE]

    for i in range(n):
        for hashes in hashed(i):
            waiting.append(hashes)
            owners.append(i)
            held += len(hashes)
            if held > 200_000:
                settle()
    settle()
    return _pack(2 * counts > totals[:, None]).reshape(n, words) if n else np.empty((0, words), np.uint64)


def fp_columns(words: int) -> list[str]:
    return [f"_fp{k}" for k in range(words)]


def with_fingerprints(
    docs: DataFrame, text_column: str = "text", size: int = SHINGLE, words: int = 1, keep: list[str] | None = None, sets: bool = False
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and _fp0, _fp1, ...: the fingerprint's words as signed longs.

    With ``sets`` the fingerprints are those of the shingle sets, _set is a hash of the set and _size how many it holds."""
    kept = docs.columns if keep is None else keep
    source = docs.select(*[F.col(c) for c in kept], F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                names = np.zeros((2, len(offsets) - 1), np.uint64) if sets else None
                fps = fingerprint_texts(data, offsets, size, words, names).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(fps[:, k])) for k in range(words)]
                if sets:
                    columns += [pa.array(row.view(np.int64)) for row in names]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*kept, *new])

    new = [*fp_columns(words), *(["_set", "_size"] if sets else [])]
    added = [T.StructField(c, T.LongType()) for c in new]
    return source.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *added]))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _cell(words: int, lanes: int) -> Column:
    if lanes == 1:
        return sum((F.bit_count(c) for c in fp_columns(words)), F.lit(0))
    width, cell = 64 // lanes, F.lit(0)
    for k in range(lanes):
        part = F.shiftrightunsigned("_fp0", width * k).bitwiseAND(F.lit((1 << width) - 1))
        cell = cell * (width + 1) + F.bit_count(part)
    return cell


def _size_cell(size: Column, similar: float) -> Column:
    """Sets of the similarity lie ``SIZE_STEPS`` cells apart at most."""
    return F.least(F.floor(F.log(F.greatest(size, F.lit(1))) * (SIZE_STEPS / -math.log(similar))), F.lit(SIZE_CELLS - 1)).cast("int")


def _side(words: int, lanes: int) -> int:
    """How many population counts a lane can have."""
    return 64 * words + 1 if lanes == 1 else 64 // lanes + 1


def _neighbours(lanes: int, radius: int) -> np.ndarray:
    """Difference vectors of sum 1 to ``radius`` whose first entry that is not 0 is positive."""
    side = np.arange(-radius, radius + 1)
    grid = np.stack(np.meshgrid(*[side] * lanes, indexing="ij"), -1).reshape(-1, lanes)
    total = np.abs(grid).sum(1)
    grid = grid[(total > 0) & (total <= radius)]
    first = grid[np.arange(len(grid)), (grid != 0).argmax(1)]
    return grid[first > 0]


def _plan(counts: np.ndarray, side: int, lanes: int, radius: int, tile_rows: int, visitors: int):
    """Parts of every cell's residents and of its visitors."""
    cube = counts.reshape([side] * lanes)
    coming = np.zeros_like(cube)
    for d in _neighbours(lanes, radius):
        to = tuple(slice(max(0, -x), side - max(0, x)) for x in d)
        come = tuple(slice(max(0, x), side - max(0, -x)) for x in d)
        coming[to] += cube[come]
    parts = -(-counts // tile_rows)
    # Residents of the other parts of a cell visit, too.
    coming = coming.reshape(-1) + np.where(parts > 1, counts, 0)
    return parts, np.maximum(1, -(-coming // visitors))


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    x = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)


def _deal(parts: np.ndarray, shares: np.ndarray, side: int, carried: list[str], lanes: int, radius: int):
    """Batches of (node, cell, carried columns) to rows (cell, part, share, visits, node, carried columns)."""
    powers = side ** np.arange(lanes - 1, -1, -1)
    steps = _neighbours(lanes, radius)

    def rows(piece: pa.RecordBatch, who: np.ndarray, cell, part, share, visits: bool) -> pa.RecordBatch:
        chosen = piece.take(pa.array(who))
        place = {"cell": cell, "part": part, "share": share}
        return pa.RecordBatch.from_arrays(
            [*[pa.array(x.astype(np.int32)) for x in place.values()], pa.array(np.full(len(who), visits)), chosen["node"],
             *[chosen[c] for c in carried]],
            names=[*place, "visits", "node", *carried],
        )

    def all_parts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every entry i the numbers 0 to n[i] - 1: entries and numbers."""
        return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                piece = batch.slice(at, 20_000)
                node, cell = piece["node"].to_numpy(), piece["cell"].to_numpy().astype(np.int64)
                own = (_mix(node, 1) % parts[cell].astype(np.uint64)).astype(np.int64)
                turn = _mix(node, 2)
                who, share = all_parts(shares[cell])
                yield rows(piece, who, cell[who], own[who], share, False)
                if own.any():  # earlier parts of the own cell
                    who, part = all_parts(own)
                    yield rows(piece, who, cell[who], part, turn[who] % shares[cell[who]].astype(np.uint64), True)
                vector = cell[:, None] // powers % side
                for d in steps:
                    to = vector - d
                    inside = np.flatnonzero(((to >= 0) & (to < side)).all(1))
                    target = to[inside] @ powers
                    live = parts[target] > 0
                    inside, target = inside[live], target[live]
                    if len(target):
                        k, part = all_parts(parts[target])
                        who = inside[k]
                        yield rows(piece, who, target[k], part, turn[who] % shares[target[k]].astype(np.uint64), True)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Those of the given links that join two groups not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[ry] = rx
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


Tile = tuple[np.ndarray, list[np.ndarray]]  # nodes, and the words of their fingerprints (and their labels)


def _near(a: list[np.ndarray], b: list[np.ndarray], radius: int, room: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within ``radius`` bits; ``room`` is that of ``HIGH`` times ``WIDE`` pairs, used again and again."""
    differ, apart, more, near = (r[: len(a[0]), : len(b[0])] for r in room)
    np.bitwise_count(np.bitwise_xor(a[0][:, None], b[0], out=differ), out=apart)
    for x, y in zip(a[1:], b[1:], strict=True):
        np.bitwise_count(np.bitwise_xor(x[:, None], y, out=differ), out=more)
        np.add(apart, more, out=apart)
    return np.nonzero(np.less_equal(apart, radius, out=near)) if near.size else ((none := np.empty(0, np.int64)), none)


def _part(tile: Tile, at: slice) -> Tile:
    return tile[0][at], [w[at] for w in tile[1]]


def _joined(tiles: list[Tile]) -> Tile:
    return np.concatenate([t[0] for t in tiles]), [np.concatenate(w) for w in zip(*[t[1] for t in tiles], strict=True)]


def _compare(words: int, radius: int, labelled: bool = False):
    """Rows sorted by tile, residents first, to links; if labelled, to all pairs of unequal labels."""
    carried = [*fp_columns(words), *(["label"] if labelled else [])]

    def links(residents: Tile, others: Tile, own: bool) -> Iterator[pa.RecordBatch]:
        found: tuple[list[int], list[int]] = ([], [])
        room = [np.empty((HIGH, WIDE), kind) for kind in (np.uint64, np.uint8, np.uint8, bool)]
        for i in range(0, len(residents[0]), HIGH):
            nodes, fps = _part(residents, slice(i, i + HIGH))
            for j in range(i // WIDE * WIDE if own else 0, len(others[0]), WIDE):
                other_nodes, other_fps = _part(others, slice(j, j + WIDE))
                k, m = _near(fps[:words], other_fps[:words], radius, room)
                if not len(k):
                    continue
                if own:
                    later = i + k < j + m
                    k, m = k[later], m[later]
                if labelled:
                    apart = fps[words][k] != other_fps[words][m]
                    if apart.any():
                        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[k[apart]]), "b": pa.array(other_nodes[m[apart]])})
                else:
                    a = np.concatenate([np.array(found[0], np.int64), nodes[k]])
                    found = _forest(a, np.concatenate([np.array(found[1], np.int64), other_nodes[m]]))
        if found[0]:
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, residents, visitors = None, [], []

        def settle(ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal residents, visitors
            residents = [_joined(residents)] if residents else []
            if residents and visitors:
                yield from links(residents[0], _joined(visitors), False)
            visitors = []
            if ended and residents and place[2] == 0:
                yield from links(residents[0], residents[0], True)

        for batch in batches:
            key = [batch[c].to_numpy() for c in ("cell", "part", "share")]
            visits = batch["visits"].to_numpy(zero_copy_only=False)
            # Unsigned, as numpy counts the bits of a negative number's absolute value.
            tile = batch["node"].to_numpy(), [batch[c].to_numpy().view(np.uint64) for c in carried]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                here = (int(key[0][lo]), int(key[1][lo]), int(key[2][lo]))
                if here != place:
                    if place is not None:
                        yield from settle(True)
                    place, residents = here, []
                split = lo + int(np.searchsorted(visits[lo:hi], True))
                if split > lo:
                    residents.append(_part(tile, slice(lo, split)))
                if hi > split:
                    visitors.append(_part(tile, slice(split, hi)))
            # Visitors are met as they come; only the residents are held.
            if sum(len(v[0]) for v in visitors) > 65_536:
                yield from settle(False)
        if place is not None:
            yield from settle(True)

    return run


def links(
    classes: DataFrame, words: int = 1, radius: int = RADIUS, lanes: int = LANES, tile_rows: int = TILE_ROWS, visitors: int = VISITORS,
    labelled: bool = False, similar: float | None = None,
) -> DataFrame:
    """Links (a, b) between nodes that join all that lie within ``radius`` bits.

    The links are a part of all pairs, but connect exactly what all pairs connect. If ``labelled``, they are all
    pairs within the radius whose column label differs. With ``similar``, pairs count only if their sets' sizes (column _size) may go
    with that similarity; some that don't are linked, too."""
    carried = [*fp_columns(words), *(["label"] if labelled else [])]
    if similar is None:
        cell, side, reach = _cell(words, lanes), _side(words, lanes), radius
    else:
        cell, side, lanes, reach = _size_cell(F.col("_size"), similar), SIZE_CELLS, 1, SIZE_STEPS
    placed = classes.select("node", *carried, cell.alias("cell"))
    counts = np.zeros(side**lanes, np.int64)
    for row in placed.groupBy("cell").count().collect():  # 17^4 rows at most
        counts[row["cell"]] = row["count"]
    parts, shares = _plan(counts, side, lanes, reach, tile_rows, visitors)
    fps = ", ".join(f"{c} long" for c in carried)
    dealt = placed.mapInArrow(
        _deal(parts, shares, side, carried, lanes, reach), f"cell int, part int, share int, visits boolean, node long, {fps}"
    )
    # Tiles of sizes are few and small, but take long: as many tasks as tiles, not as few as their bytes ask for.
    n_tiles = [] if similar is None else [max(1, min(int((parts * shares).sum()), MOST_TASKS))]
    tiles = dealt.repartition(*n_tiles, "cell", "part", "share").sortWithinPartitions("cell", "part", "share", "visits")
    return tiles.mapInArrow(_compare(words, radius, labelled), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node that can be reached.

    Large stars and small stars in turn: every round hangs nodes to the smallest neighbour, and the
    number of rounds grows with the logarithm of the longest path."""
    stars = once(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    state = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v")
        stars = once(small.filter("u <> v").distinct(), "stars")
        seen = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state:
            break
        state = (seen.n, seen.h)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, _s) from (node, _text): the hashes of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                raw = data.tobytes()
                found = [shingle_set(raw[a:b], size).view(np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows["node"], pa.array(found, pa.list_(pa.int64()))], names=["node", "_s"])

    return texts.select("node", "_text").mapInArrow(run, "node long, _s array<long>")


def confirmed(
    classes: DataFrame, texts: DataFrame, size: int, similar: float, words: int, radius: int, lanes: int, **tiles: int
) -> DataFrame:
    """Links (a, b) that connect what all pairs connect that are within ``radius`` bits and whose shingle sets have the Jaccard
    similarity ``similar``. ``texts`` has (_key, _text), rows that repeat allowed; ``classes`` names a text of each node by its _key, and
    _size is that of its set."""
    proposed = once(links(classes, words, radius, lanes, similar=similar, **tiles).distinct(), "proposed")
    linked = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = texts.join(classes.join(linked, "node").select("node", "_key"), "_key").dropDuplicates(["node"])
    sets = once(with_sets(chosen, size), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("node").alias(end), F.col("_s").alias(f"_{end}")) for end in ("a", "b")]
        common = F.size(F.array_intersect("_a", "_b"))
        whole = F.size("_a") + F.size("_b") - common
        return pairs.join(sides[0], "a").join(sides[1], "b").filter(common >= whole * F.lit(similar)).select("a", "b")

    joined = once(verified(proposed), "confirmed")
    refuted = proposed.join(joined, ["a", "b"], "left_anti")
    if refuted.isEmpty():
        return joined
    around = once(components(proposed).withColumnRenamed("node", "linked"), "around")
    touched = refuted.join(around, refuted["a"] == around["linked"], "left").select(F.coalesce("root", "a").alias("whole")).distinct()
    labels = components(joined).select(F.col("node").alias("named"), F.col("root").alias("to"))
    again = (
        classes.join(around, classes["node"] == around["linked"], "left")
        .withColumn("whole", F.coalesce("root", "node"))
        .join(touched, "whole", "left_semi")
        .join(labels, F.col("node") == labels["named"], "left")
        .select("node", *fp_columns(words), "_size", F.coalesce("to", "node").alias("label"))
    )
    others = links(once(again, "again"), words, radius, lanes, labelled=True, similar=similar, **tiles)
    return joined.union(verified(once(others, "others")))


def grouped(
    rows: DataFrame, id_column: str, words: int = 1, radius: int = RADIUS, lanes: int = LANES,
    texts: DataFrame | None = None, size: int = WIDE_SHINGLE, similar: float = SIMILAR, **tiles: int,
) -> DataFrame:
    """``rows`` (written; with an id and fingerprint columns) with component_id, the smallest id that links reach, and root, which names
    the group even if no id does.

    With ``texts`` (_key, _text) links are confirmed on the shingle sets; ``rows`` then has _set, _size and _key, too."""
    key = [*fp_columns(words), *([] if texts is None else ["_set"])]
    node = F.col(key[0]) if len(key) == 1 else F.xxhash64(*key)
    named = [] if texts is None else [F.min("_key").alias("_key"), F.max("_size").alias("_size")]
    classes = once(rows.groupBy(*key).agg(F.min(id_column).alias("low"), *named).withColumn("node", node), "classes")
    if texts is None:
        edges = links(classes, words, radius, lanes, **tiles)
    else:
        edges = confirmed(classes, texts, size, similar, words, radius, lanes, **tiles)
    roots = components(edges).withColumnRenamed("node", "linked")
    # A root is its own group; so is a class without links.
    named = classes.join(roots, classes["node"] == roots["linked"], "left").select(
        *key, "low", F.coalesce("root", "node").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "root").select(*key, "component_id", "root"), key)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, radius: int = RADIUS,
) -> DataFrame:
    """(id, _fp0, component_id) for every row, with 64-bit fingerprints."""
    rows = once(with_fingerprints(docs, text_column, size, 1, [id_column]), "fingerprints")
    return grouped(rows, id_column, 1, radius).select(id_column, "_fp0", "component_id")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS,
    similar: float = SIMILAR,
) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates: the smallest id stays. Fingerprints of 128 bits
    propose links, and those join whose shingle sets have the Jaccard similarity ``similar``.

    Rows that repeat the id and the text of one that stays are repeats, too, and only one of them stays."""
    keyed = docs.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_t"), text_hash(F.col(text_column)).alias("_h")
    )
    rows = once(with_fingerprints(keyed, "_t", size, 2, ["_id", "_h"], sets=True), "fingerprints")
    # Which of a class's rows has its text read again: one by id and text, as texts alone can repeat without end.
    key = F.xxhash64(F.col("_id").isNull(), "_id", "_h").alias("_key")
    texts = keyed.select(key, F.col("_t").alias("_text"))
    found = grouped(
        rows.select("*", key), "_id", 2, radius, 1, texts, size, similar, tile_rows=WIDE_TILE_ROWS, visitors=WIDE_VISITORS
    )
    # Ids that repeat with other texts: the smallest hash stays, so that one row is left of a group.
    best = found.filter(F.col("_id").eqNullSafe(F.col("component_id")))
    stay = once(best.groupBy("root", "_id").agg(F.min("_h").alias("_h"), F.count(F.lit(1)).alias("n")), "stay")
    same = docs[id_column].eqNullSafe(stay["_id"]) & (text_hash(docs[text_column]) == stay["_h"])
    kept = docs.join(stay, same, "left_semi")
    if stay.filter("n > 1").isEmpty():
        return kept
    # One row of each id: a struct with all columns, the first in order.
    return kept.groupBy(F.col(id_column).alias("_id"), text_hash(F.col(text_column)).alias("_h")).agg(
        F.first(F.struct(*docs.columns)).alias("row")
    ).select("row.*")
