import tracemalloc

import numpy as np
import pytest

from docloom.operators import cells, nearest

STORED = "chunk_id long, file_id long, embedding array<float>"
ASKED = "query_id long, embedding array<double>"


def clustered(seed, n=3000, dim=16, groups=25, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    vectors = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return vectors.astype(np.float32), centres


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.file_id, r.distance) for r in df.collect())


@pytest.mark.parametrize(("k", "n_cells", "max_queries"), [(1, 40, 4096), (7, 40, 4), (50, 5, 4096), (400, 40, 4096)])
def test_same_as_comparing_everything(spark, k, n_cells, max_queries):
    vectors, centres = clustered(1)
    rows = [(i, i // 3, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(10_000 + i, i, vectors[i].tolist()) for i in range(300)]  # exact copies tie
    rows += [(20_000, 1, None), (20_001, 1, [0.0] * 16)]
    chunks = spark.createDataFrame(rows, STORED).repartition(5)
    asked = [(i, c.tolist()) for i, c in enumerate(centres[:8])] + [(100 + i, vectors[i].tolist()) for i in range(5)]
    asked += [(200, None), (201, [0.0] * 16)]
    queries = spark.createDataFrame(asked, ASKED)
    reads = cells.Reads()
    got = rows_of(cells.vector_topk(queries, cells.store(chunks, n_cells), k, max_queries, reads))
    assert got == rows_of(nearest.vector_topk(queries, chunks, k))
    assert len(got) == 13 * k
    if k <= 50 and n_cells == 40:
        assert reads.vectors < 0.2 * reads.all_vectors and reads.pairs < 0.3 * reads.all_pairs


def test_cells_are_not_read(spark):
    """A query's cells are a filter on folders: the others are not opened."""
    vectors, centres = clustered(2)
    chunks = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(vectors)], STORED)
    stored = cells.store(chunks, 40)
    folders = {f.split("cell=")[1].split("/")[0] for f in stored.vectors.inputFiles()}
    assert len(folders) == int((stored.counts > 0).sum()) > 20
    reads = cells.Reads()
    cells.vector_topk(spark.createDataFrame([(1, centres[0].tolist())], ASKED), stored, 5, reads=reads).collect()
    assert 0 < len(reads.cells) <= 4 and reads.rounds <= 3
    some = stored.vectors.filter("cell IN (1, 2)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("seed", range(3))
def test_without_structure(spark, seed):
    """Directions that fill space leave little out, but the result is the same; also with near and opposite vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, 4))
    near = base[:50] * (1 + 1e-7 * rng.normal(size=(50, 4)))
    rows = [(i, i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, -base[:50]]))]
    chunks = spark.createDataFrame(rows, STORED).repartition(3)
    queries = spark.createDataFrame([(i, (base[i] if i % 2 else -base[i]).tolist()) for i in range(12)], ASKED)
    assert rows_of(cells.vector_topk(queries, cells.store(chunks, 30), 9)) == rows_of(nearest.vector_topk(queries, chunks, 9))


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], STORED)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], ASKED)
    assert cells.vector_topk(queries, cells.store(none)).count() == 0
    same = spark.createDataFrame([(i, i, [1.0, 0.0]) for i in range(5)], STORED)
    got = rows_of(cells.vector_topk(queries, cells.store(same, 4), 10))
    assert [(r[1], r[2], r[4]) for r in got] == [(i + 1, i, 0.0) for i in range(5)]
    assert cells.vector_topk(queries.limit(0), cells.store(same)).count() == 0


def test_pivots():
    vectors, _ = clustered(3, n=500)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pivots = cells.choose_pivots(unit, 25)
    assert pivots.shape == (25, 16) and np.allclose(np.linalg.norm(pivots, axis=1), 1)
    assert len(cells.choose_pivots(np.ones((9, 1)), 4)) == 1


def test_memory_of_many_queries_follows_what_is_kept():
    """The first vectors, when nothing is known to be too far yet, are not all held as candidates."""
    rng = np.random.default_rng(3)
    queries = rng.normal(size=(2048, 16))
    stored = rng.normal(size=(2000, 16))
    ids = np.arange(len(stored))
    best = nearest.Best(np.arange(len(queries)), queries, 50)
    tracemalloc.start()
    best.add(ids, ids, stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    distance = np.round(1.0 - stored @ queries[7], 9)
    order = np.lexsort((ids, distance))[:50]
    own = best.rows[0] == 7
    assert best.rows[2][own].tolist() == order.tolist()


def test_ties_and_vectors_without_direction():
    """More ties than are kept go by chunk id, and rows without a distance take no part."""
    stored = np.vstack([np.full((30, 4), np.nan), np.tile([1.0, 0, 0, 0], (400, 1)), np.tile([0, 1.0, 0, 0], (3, 1))])
    ids = np.arange(len(stored))[::-1].copy()
    best = nearest.Best(np.array([5]), np.array([[1.0, 0, 0, 0]]), 3)
    best.add(ids, ids, stored)
    assert best.rows[2].tolist() == [3, 4, 5] and best.rows[1].tolist() == [0.0] * 3
    alone = nearest.Best(np.array([5]), np.array([[1.0, 0, 0, 0]]), 7)
    few = np.vstack([stored[:30], stored[-3:]])
    alone.add(ids[:33], ids[:33], few)
    assert len(alone.rows[2]) == 3
