"""Exact nearest neighbours that leave most vectors unread.

Unit vectors are stored by cell: each belongs to the pivot it is nearest to, and is kept with its angle to that pivot. The angle between
directions obeys the triangle inequality, so for a query at angle t from a pivot no vector of the cell is nearer than t minus the cell's
largest angle, or its smallest angle minus t. A query reads cells in the order of this bound, some at a time; once it knows
``top_k`` vectors, cells whose bound lies beyond the last of them are never read, and within a cell the same bound leaves out vectors
by their own angles before they are compared. The result is that of comparing everything, ties included.

Pivots come from a sample of bounded size; any pivots give the right result, good ones leave more unread. Only queries, pivots and
the cells' counts and angles (a row for each cell) pass through the driver, queries in blocks; vectors are shuffled once, when they are stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.nearest import MAX_QUERIES_PER_BLOCK, OUT, Best, best_per_query, id_array, query_blocks, unit_matrix
from docloom.schemas import TOP_K
from docloom.sources.sizes import written

#: Vectors per cell that are aimed at, the most cells, and the vectors that pivots are chosen from.
CELL_VECTORS = 2_000
MAX_CELLS = 4096
SAMPLE = 20_000
#: A round reads so many times more vectors for a query than the one before.
GROWTH = 4
#: Angles are exact to about the root of a double's precision near 0 and pi; distances are rounded to nine places.
ANGLE_SLACK, DISTANCE_SLACK = 1e-7, 2e-9


@dataclass(frozen=True)
class Cells:
    """Stored vectors (cell, angle, chunk_id, file_id, embedding), and what the driver knows of them."""

    vectors: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray


@dataclass
class Reads:
    """What a search has read: (query, cell) pairs and the vectors in them, of all pairs and vectors; and the rounds it took."""

    pairs: int = 0
    vectors: int = 0
    all_pairs: int = 0
    all_vectors: int = 0
    cells: set[int] = field(default_factory=set)
    rounds: int = 0


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample that are far apart: each next one is the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = sample @ sample[0]
    for _ in range(min(n, len(sample)) - 1):
        k = int(nearest.argmin())
        if nearest[k] > 1 - 1e-12:
            break  # all that is left equals a pivot
        chosen.append(k)
        nearest = np.maximum(nearest, sample @ sample[k])
    pivots = sample[chosen]
    # A round of averaging puts pivots amid their vectors.
    owner = (sample @ pivots.T).argmax(1)
    sums = np.zeros_like(pivots)
    np.add.at(sums, owner, sample)
    norms = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), pivots)


def store(chunks: DataFrame, n_cells: int | None = None, sample_rows: int = SAMPLE) -> Cells:
    """Write the vectors of ``chunks`` (chunk_id, file_id, embedding) by cell. Missing and zero vectors take no part."""
    spark = chunks.sparkSession
    stored = chunks.select("chunk_id", "file_id", "embedding").filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    if n_cells is None:
        n_cells = max(1, min(MAX_CELLS, stored.count() // CELL_VECTORS))
    least = stored.select(F.xxhash64("chunk_id").alias("_hash"), "chunk_id", "embedding").orderBy("_hash", "chunk_id").limit(sample_rows)
    sample = least.select("embedding").toArrow()
    pivots = choose_pivots(unit_matrix(sample["embedding"]), n_cells) if sample.num_rows else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unit_matrix(batch["embedding"]) @ shared.value.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(angle), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "angle", "cell"]
                )

    schema = T.StructType([*stored.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    # A folder for each cell, of as many files as its size asks for.
    by_cell = stored.mapInArrow(assign, schema).hint("rebalance", "cell").sortWithinPartitions("cell", "angle")
    vectors = written(by_cell, "cells", ("cell",))
    known = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).toArrow()
    counts, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    cell = known["cell"].to_numpy()
    counts[cell], low[cell], high[cell] = known["n"].to_numpy(), known["least"].to_numpy(), known["most"].to_numpy()
    return Cells(vectors, pivots, counts, low, high)


def _reader(shared, k: int):
    """Compare a task's vectors with the queries that read their cells; its best k for each query.

    ``shared``: query ids, unit queries, angles of queries and pivots, which queries read which cells, and the angle that each query is limited to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, angles, reads, reach = shared.value
        best = Best(ids, queries, k)
        for batch in batches:
            cells, own = batch["cell"].to_numpy(), batch["angle"].to_numpy()
            for cell in np.unique(cells).tolist():
                asked = np.flatnonzero(reads[:, cell])
                at = np.flatnonzero(cells == cell)
                if not len(asked) or not len(at):
                    continue
                # Vectors that some query's own bound lets through: between the nearest and the farthest ring.
                low = (angles[asked, cell] - reach[asked]).min()
                high = (angles[asked, cell] + reach[asked]).max()
                at = at[(own[at] >= low) & (own[at] <= high)]
                if len(at):
                    some = batch.take(pa.array(at))
                    best.add(id_array(some["chunk_id"]), id_array(some["file_id"]), unit_matrix(some["embedding"]), asked)
        yield best.table()

    return run


def _angle_of(distance: np.ndarray) -> np.ndarray:
    """The largest angle at which a rounded distance may be no larger than the given ones."""
    cosine = np.clip(1.0 - (distance + DISTANCE_SLACK), -1.0, 1.0)
    return np.where(np.isfinite(distance), np.arccos(cosine) + ANGLE_SLACK, math.inf)


def _search_block(block: pa.Table, cells: Cells, k: int, reads: Reads) -> DataFrame | None:
    spark = cells.vectors.sparkSession
    ids, queries = id_array(block["query_id"].combine_chunks()), unit_matrix(block["embedding"])
    real = ~np.isnan(queries).any(1)
    ids, queries = ids[real], queries[real]
    if not len(ids) or not len(cells.pivots):
        return None
    angles = _angles(queries, cells.pivots)
    bound = np.maximum(np.maximum(angles - cells.most, cells.least - angles), 0.0)
    bound[:, cells.counts == 0] = math.inf
    order = np.argsort(bound, axis=1, kind="stable")
    held = np.cumsum(np.take(cells.counts, order), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    done = np.zeros(bound.shape, bool)
    limit = np.full(len(ids), math.inf)
    found: DataFrame | None = None
    budget = k
    reads.all_pairs += int(np.isfinite(bound).sum())
    reads.all_vectors += len(ids) * int(cells.counts.sum())
    while True:
        reach = _angle_of(limit)
        open_cells = ~done & np.isfinite(bound) & (bound <= reach[:, None])
        if not open_cells.any():
            return found
        # The next cells of each query, until they hold ``budget`` vectors more than the nearest could.
        enough = (held >= budget).argmax(1)
        enough[held[:, -1] < budget] = order.shape[1] - 1
        now = open_cells & (place <= enough[:, None])
        budget *= GROWTH
        if not now.any():
            continue
        done |= now
        wanted = np.flatnonzero(now.any(0))
        reads.rounds += 1
        reads.pairs += int(now.sum())
        reads.vectors += int((now * cells.counts).sum())
        reads.cells.update(wanted.tolist())
        shared = spark.sparkContext.broadcast((ids, queries, angles, now, np.where(np.isfinite(reach), reach, 4.0)))
        rows = cells.vectors.filter(F.col("cell").isin(wanted.tolist())).select("chunk_id", "file_id", "embedding", "angle", "cell")
        nearest = rows.mapInArrow(_reader(shared, k), OUT)
        together = nearest if found is None else found.unionByName(nearest)
        found = written(best_per_query(together, ["distance", "chunk_id"], k).drop("rank"), "nearest")
        # A row for each query of the block.
        known = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last")).filter(F.col("n") >= k).toArrow()
        position = {q: i for i, q in enumerate(ids.tolist())}
        for q, last in zip(known["query_id"].to_pylist(), known["last"].to_pylist(), strict=True):
            limit[position[q]] = last


def vector_topk(queries: DataFrame, cells: Cells, top_k: int = TOP_K, max_queries: int = MAX_QUERIES_PER_BLOCK, reads: Reads | None = None) -> DataFrame:
    """The ``top_k`` nearest chunks per query (query_id, embedding): as ``nearest.vector_topk`` over the stored chunks."""
    reads = Reads() if reads is None else reads
    found: DataFrame | None = None
    for block in query_blocks(queries, max_queries):
        some = _search_block(block, cells, top_k, reads)
        if some is not None:
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = cells.vectors.sparkSession.createDataFrame([], OUT)
    return best_per_query(found, ["distance", "chunk_id"], top_k)
