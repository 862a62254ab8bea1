import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectors as vec
from docloom.operators.embedding import embed, hash_draws, hash_embed
from docloom.operators import nearest

MASK = (1 << 64) - 1


def draws_by_hand(text, dim):
    state = int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")
    out = []
    for _ in range(dim):
        z = (state + 0x9E3779B97F4A7C15) & MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        state = z ^ (z >> 31)
        out.append(state & 0xFFFFFFFF)
    return out


def test_draws_follow_the_generator():
    texts = ["hello world", "", "é😀", "hello world"]
    got = hash_draws(texts, 384)
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == draws_by_hand(text, 384)


def test_hash_embed_is_normalised_and_deterministic():
    a, b = hash_embed(["x", "y"], 384), hash_embed(["y", "x"], 384)
    assert a.dtype == np.float32 and a.shape == (2, 384)
    assert np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-6)
    assert (a[0] == b[1]).all()
    raw = np.array([d / 0xFFFFFFFF * 2 - 1 for d in draws_by_hand("x", 384)], np.float32)
    assert np.allclose(a[0], raw / np.linalg.norm(raw), atol=1e-6)
    assert hash_embed([], 384).shape == (0, 384)


def test_embed_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, snippet string")
    rows = {r.id: r for r in embed(df, dim=16).collect()}
    assert np.allclose(rows[1].embedding, hash_embed(["a"], 16)[0])
    assert rows[1].embedder == "hash_embed" and rows[2].embedding is None


def test_embed_falls_back(spark):
    def broken(texts, dim):
        raise RuntimeError("no model here")

    def ones(texts, dim):
        return np.ones((len(texts), dim), np.float32) / np.sqrt(dim)

    df = spark.createDataFrame([("a",)], "snippet string")
    row = embed(df, fn=broken, dim=8).first()
    assert row.embedder == "hash_embed" and np.allclose(row.embedding, hash_embed(["a"], 8)[0])
    row = embed(df, fn=ones, dim=4).first()
    assert row.embedder == "ones" and row.embedding == [0.5] * 4
    row = embed(df, fn=lambda texts, dim: np.ones((1, 3)), dim=4).first()
    assert row.embedder == "hash_embed"


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>")
    v, z = F.col("v"), F.col("z")
    row = df.select(
        vec.l2_normalize(v).alias("n"),
        vec.l2_normalize(z).alias("nz"),
        vec.cosine_distance(v, v).alias("same"),
        vec.cosine_distance(v, z).alias("zero"),
    ).first()
    assert np.allclose(row.n, [0.6, 0.8]) and row.nz == [0.0, 0.0]
    assert row.same == 0.0 and row.zero is None
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        df.select(vec.checked_dim(v, 3)).collect()


def by_hand(queries, chunks, k):
    out = []
    for q, qv in queries:
        scored = []
        for c, cv in chunks:
            if cv is None or not np.any(cv) or not np.any(qv):
                continue
            a, b = np.array(qv, float), np.array(np.float32(cv), float)
            scored.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 9), c))
        out += [(q, c, d) for d, c in sorted(scored)[:k]]
    return sorted(out)


@pytest.mark.parametrize("max_queries", [4096, 3])
def test_topk_matches_brute_force(spark, max_queries, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)).round(2).tolist()
    chunks = [(i, v) for i, v in enumerate(vectors)]
    chunks += [(1000 + i, v) for i, v in enumerate(vectors[:100])]  # exact copies tie
    chunks += [(2000, None), (2001, [0.0] * 8)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(10)] + [(10, vectors[5])]
    monkeypatch.setattr(nearest, "PAIRS_AT_A_TIME", 500)
    stored = spark.createDataFrame(
        [(c, c, v) for c, v in chunks], "chunk_id long, file_id long, embedding array<float>"
    ).repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = nearest.vector_topk(asked, stored, 7, max_queries).collect()
    want = by_hand(queries, chunks, 7)
    assert [(q, c) for q, c, _ in sorted((r.query_id, r.chunk_id, r.distance) for r in got)] == [
        (q, c) for q, c, _ in want
    ]
    assert np.allclose(
        [d for _, _, d in sorted((r.query_id, r.chunk_id, r.distance) for r in got)],
        [d for _, _, d in want], atol=1e-8,
    )
    assert min(r.rank for r in got) == 1 and max(r.rank for r in got) == 7


def test_topk_without_query_vectors(spark):
    stored = spark.createDataFrame([(1, 1, [1.0])], "chunk_id long, file_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, None)], "query_id long, embedding array<double>")
    assert nearest.vector_topk(asked, stored).count() == 0


def test_vectors_of_different_sizes_are_refused(spark):
    stored = spark.createDataFrame(
        [(1, 1, [1.0]), (2, 2, [1.0, 2.0])], "chunk_id long, file_id long, embedding array<float>"
    ).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="different sizes"):
        nearest.vector_topk(asked, stored).collect()
