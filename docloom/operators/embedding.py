"""Snippet embeddings: a deterministic hashing embedder and a hook for any batch function.

The batch functions see whole Arrow batches of texts; only the text column crosses to Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schemas import EMBED_DIM

# texts, dim -> float32 array of shape (len(texts), dim) with unit rows
EmbedFn = Callable[[list[str], int], np.ndarray]

# Fixed values of the splitmix64 generator.
SPLITMIX_STEP = 0x9E3779B97F4A7C15
SPLITMIX_MIX_1 = 0xBF58476D1CE4E5B9
SPLITMIX_MIX_2 = 0x94D049BB133111EB


def hash_draws(texts: list[str], dim: int = EMBED_DIM) -> np.ndarray:
    """``dim`` pseudo-random 32-bit draws per text, each row seeded by the MD5 of its text.

    The generator's output is its next state, so the loop runs over the dimensions; every step
    handles all texts of the batch at once.
    """
    digests = b"".join(hashlib.md5(t.encode("utf-8")).digest()[:8] for t in texts)
    state = np.frombuffer(digests, dtype="<u8").astype(np.uint64)
    draws = np.empty((dim, len(texts)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for d in range(dim):
            mixed = state + np.uint64(SPLITMIX_STEP)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(SPLITMIX_MIX_1)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(SPLITMIX_MIX_2)
            state = mixed ^ (mixed >> np.uint64(31))
            draws[d] = state & np.uint64(0xFFFFFFFF)
    return draws.T


def hash_embed(texts: list[str], dim: int = EMBED_DIM) -> np.ndarray:
    """Unit vectors that depend on the text alone; equal texts get equal vectors."""
    vectors = (hash_draws(texts, dim) / 0xFFFFFFFF * 2.0 - 1.0).astype(np.float32)
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=vectors, where=norms > 0, casting="unsafe")


def _as_lists(vectors: np.ndarray, dim: int) -> pa.ListArray:
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * dim
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(vectors, np.float32).ravel())


def _embedded(texts: pa.Array, fn: EmbedFn, dim: int) -> pa.StructArray:
    """(embedding, embedder) of a batch of texts."""
    present = texts.fill_null("").to_pylist()
    used = getattr(fn, "__name__", "custom")
    try:
        vectors = np.asarray(fn(present, dim), dtype=np.float32)
        if vectors.shape != (len(present), dim):
            raise ValueError(f"expected {(len(present), dim)}, got {vectors.shape}")
    except Exception:
        vectors, used = hash_embed(present, dim), hash_embed.__name__
    rows = pa.StructArray.from_arrays(
        [_as_lists(vectors, dim), pa.array([used] * len(present), pa.string())],
        names=["embedding", "embedder"],
    )
    if texts.null_count:
        rows = pa.compute.if_else(texts.is_valid(), rows, pa.scalar(None, rows.type))
    return rows


def embed_rows(
    df: DataFrame, text: str = "snippet", fn: EmbedFn = hash_embed, dim: int = EMBED_DIM
) -> DataFrame:
    """The same as ``embed`` for vectors that are not stored: a condition on them does not make them twice, nor before a
    restriction of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = _embedded(batch[text], fn, dim).flatten()
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "embedding", "embedder"])

    added = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedder", T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def embed(
    df: DataFrame, text: str = "snippet", fn: EmbedFn = hash_embed, dim: int = EMBED_DIM
) -> DataFrame:
    """Add ``embedding`` and ``embedder``: the name of ``fn``, or ``hash_embed`` where it failed.

    A batch on which ``fn`` fails, or gives the wrong shape, falls back to the hashing embedder.
    A missing text gets no vector.
    """
    @F.arrow_udf(f"struct<embedding:array<float>,embedder:string>")
    def run(texts: pa.Array) -> pa.Array:
        return _embedded(texts, fn, dim)

    return (
        df.withColumn("_e", run(F.col(text)))
        .withColumn("embedding", F.col("_e.embedding"))
        .withColumn("embedder", F.col("_e.embedder"))
        .drop("_e")
    )
