"""Hybrid ranking: vector leg and keyword leg, joined by chunk with a weighted score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import keyword_score, vector_score
from docloom.operators.filters import Restriction
from docloom.operators.fulltext import Index, bm25_search
from docloom.operators.nearest import vector_topk
from docloom.schemas import KEYWORD_WEIGHT, TOP_K, VECTOR_WEIGHT
from docloom.sources.sizes import MAX_BROADCAST_ROWS, fits


def fuse(
    vector_leg: DataFrame,
    keyword_leg: DataFrame,
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
    top_k: int = TOP_K,
) -> DataFrame:
    """Union of both legs by chunk, scores added, cut to ``top_k``.

    Equal scores keep the order of the vector leg, then that of the keyword leg. Both legs hold
    ``top_k`` rows per query at most, so this is a join of two small tables.
    """
    by_vector = vector_leg.select(
        "query_id", "chunk_id", "file_id", "distance", F.col("rank").alias("vector_rank")
    )
    by_keyword = keyword_leg.select(
        "query_id",
        "chunk_id",
        F.col("file_id").alias("_file_id"),
        "bm25",
        F.col("rank").alias("keyword_rank"),
    )
    both = by_vector.join(by_keyword, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(
        vector_score(F.col("distance")) * vector_weight, F.lit(0.0)
    ) + F.coalesce(keyword_score(F.col("bm25")) * keyword_weight, F.lit(0.0))
    best_first = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(),
        F.col("vector_rank").asc_nulls_last(),
        F.col("keyword_rank").asc_nulls_last(),
        "chunk_id",
    )
    return (
        both.withColumn("file_id", F.coalesce("file_id", "_file_id"))
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= top_k)
        .select("query_id", "rank", "chunk_id", "file_id", "score", "distance", "bm25")
    )


def describe_hits(
    hits: DataFrame, queries: DataFrame, chunks: DataFrame, files: DataFrame, top_k: int
) -> DataFrame:
    """Add snippet and file attributes to hits.

    There are at most ``top_k`` hits per query, so counting the queries bounds them: they are sent
    to the big tables, which stay where they are.
    """
    small = fits(queries, MAX_BROADCAST_ROWS // top_k)
    hint = F.broadcast if small else (lambda df: df)
    snippets = chunks.select("chunk_id", "snippet", "chunk_type", "position_meta")
    attributes = files.select("file_id", "path", "file_type", "mtime", "gist")
    return attributes.join(hint(snippets.join(hint(hits), "chunk_id")), "file_id").select(
        "query_id", "rank", "chunk_id", "file_id", "path", "file_type", "snippet", "mtime",
        "score", "gist", "chunk_type", "position_meta", "distance", "bm25",
    )


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    index: Index,
    *,
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
    top_k: int = TOP_K,
    restrict: Restriction = lambda rows: rows,
    add_vectors: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Many queries (query_id, text, embedding) against the index, ``top_k`` hits each.

    Restrictions apply inside each leg, before its own cut. A query without a vector is answered
    by keywords alone, one without words by its vector alone. Chunks that are kept without vectors get them from ``add_vectors``
    behind the restriction, in the scan that compares them; each further block of queries makes them anew.
    """
    found = restrict(chunks)
    vector_leg = vector_topk(queries, found if add_vectors is None else add_vectors(found), top_k)
    keyword_leg = bm25_search(queries, index, top_k, restrict)
    hits = fuse(vector_leg, keyword_leg, vector_weight, keyword_weight, top_k)
    return describe_hits(hits, queries, chunks, files, top_k)
