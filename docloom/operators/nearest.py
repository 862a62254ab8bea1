"""Exact nearest neighbours by cosine distance, for one query vector or many.

Every chunk has to be compared with every query: that is what exact search means. No pair is ever a
row, though. A task multiplies its Arrow batches with a block of query vectors and keeps the best
``top_k`` per query, and only those leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import DISTANCE_DIGITS
from docloom.schemas import TOP_K
from docloom.sources.sizes import written

# Queries held by one task: with 384 dimensions in double, 12 MB.
SALTS = 32
MAX_QUERIES_PER_BLOCK = 4096
# Distances computed at a time: 16 MB in double.
PAIRS_AT_A_TIME = 2_000_000

#: Columns of what is found.
OUT = "query_id long, chunk_id long, file_id long, distance double"


def unit_matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix of unit rows; rows of length zero become NaN."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"embeddings of different sizes: {sizes.tolist()}")
    matrix = values.reshape(len(vectors), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


class Best:
    """The ``k`` nearest chunks of each query of a block, over any number of batches."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        # Distance of the k-th nearest so far; anything farther cannot get in.
        self.limit = np.full(len(query_ids), np.inf)
        self.rows = (np.empty(0, int), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))

    def add(
        self, chunk_ids: np.ndarray, file_ids: np.ndarray, chunks: np.ndarray, only: np.ndarray | None = None
    ) -> None:
        """Compare chunks with all queries, or with those at the places ``only``."""
        queries = self.queries if only is None else self.queries[only]
        step = max(1, PAIRS_AT_A_TIME // max(1, len(queries)))
        for start in range(0, len(chunk_ids), step):
            part = slice(start, start + step)
            distance = np.round(1.0 - chunks[part] @ queries.T, DISTANCE_DIGITS)
            limit = self.limit if only is None else self.limit[only]
            near = distance <= limit
            if len(distance) > self.k and np.count_nonzero(near) > 2 * self.k * len(queries):
                # As long as there is no limit: the part's own k nearest, and their ties, are all that can get in.
                near &= distance <= np.fmin(np.partition(distance, self.k - 1, axis=0)[self.k - 1], np.inf)
            chunk, query = np.nonzero(near)
            place = query if only is None else only[query]
            self._merge(place, distance[chunk, query], chunk_ids[part][chunk], file_ids[part][chunk])

    def _merge(self, *new: np.ndarray) -> None:
        query, distance, chunk_id, file_id = (
            np.concatenate(pair) for pair in zip(self.rows, new, strict=True)
        )
        order = np.lexsort((chunk_id, distance, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = (a[place < self.k] for a in (order, query, place))
        self.rows = (query, distance[order], chunk_id[order], file_id[order])
        full = place == self.k - 1
        self.limit[query[full]] = distance[order][full]

    def table(self) -> pa.RecordBatch:
        query, distance, chunk_id, file_id = self.rows
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[query], pa.int64()),
                pa.array(chunk_id, pa.int64()),
                pa.array(file_id, pa.int64()),
                pa.array(distance, pa.float64()),
            ],
            names=["query_id", "chunk_id", "file_id", "distance"],
        )


def id_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _against_block(chunks: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """Compare all chunks with one block of queries that every task holds."""
    shared = chunks.sparkSession.sparkContext.broadcast(
        (id_array(block["query_id"].combine_chunks()), unit_matrix(block["embedding"]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(
                    id_array(batch["chunk_id"]), id_array(batch["file_id"]), unit_matrix(batch["embedding"])
                )
        yield best.table()

    return chunks.mapInArrow(run, OUT)


def query_blocks(queries: DataFrame, max_queries: int) -> Iterator[pa.Table]:
    """The queries with a vector (query_id, embedding), in blocks of about ``max_queries`` at most."""
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    # One more than a block may hold: enough to know whether all of them fit.
    first = asked.limit(max_queries + 1).toArrow()
    if first.num_rows <= max_queries:
        if first.num_rows:
            yield first
        return
    # Twice as many blocks as needed, since hashing does not fill them evenly.
    parts = -(-2 * asked.count() // max_queries)
    by_part = written(asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "query-blocks", ("_part",))
    for part in range(parts):
        block = by_part.filter(F.col("_part") == part).drop("_part").toArrow()
        if block.num_rows:
            yield block


def best_per_query(rows: DataFrame, order: list[str], top_k: int) -> DataFrame:
    """The first ``top_k`` rows of each query, with their ``rank``.

    Every task keeps ``top_k`` rows of a query; these are reduced in ``SALTS`` parts, and the parts'
    best once more, so that a query answered by a million tasks does not end in one."""
    parts = Window.partitionBy("query_id", "_part").orderBy(*order)
    some = (
        rows.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
        .withColumn("rank", F.row_number().over(parts))
        .filter(F.col("rank") <= top_k)
        .drop("_part", "rank")
    )
    whole = Window.partitionBy("query_id").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top_k)


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int = TOP_K,
    max_queries: int = MAX_QUERIES_PER_BLOCK,
) -> DataFrame:
    """The ``top_k`` nearest chunks per query: lowest distance, then lowest chunk id.

    Chunks and queries without a vector, or with a zero vector, take no part.
    """
    stored = chunks.select("chunk_id", "file_id", "embedding").filter(
        F.col("embedding").isNotNull()
    )
    nearest: DataFrame | None = None
    for block in query_blocks(queries, max_queries):
        # The vectors stay where they are: each block of queries is one more scan of them.
        found = _against_block(stored, block, top_k)
        nearest = found if nearest is None else nearest.unionByName(found)
    if nearest is None:
        nearest = chunks.sparkSession.createDataFrame([], OUT)
    return best_per_query(nearest, ["distance", "chunk_id"], top_k)
