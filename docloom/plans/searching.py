"""Search strings to hits, with the scope that locations and categories set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docloom.operators.embedding import EmbedFn, embed, embed_rows, hash_embed
from docloom.operators.filters import asked, flag_files, restriction
from docloom.operators.fulltext import Index
from docloom.operators.hybrid import hybrid_search
from docloom.schemas import EMBED_DIM, KEYWORD_WEIGHT, TOP_K, VECTOR_WEIGHT


def search(
    queries: DataFrame,
    files: DataFrame,
    chunks: DataFrame,
    index: Index,
    locations: DataFrame,
    settings: DataFrame,
    *,
    top_k: int | None = None,
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
    embed_fn: EmbedFn = hash_embed,
    dim: int = EMBED_DIM,
) -> DataFrame:
    """Hits for queries (query_id, text) in enabled locations and categories.

    Blank queries have no hits; ``top_k`` 0 or None means the default. Where ``chunks`` have no column of vectors, they are embedded as
    the queries are, while they are compared; nothing of the size of the vectors is then written or shuffled.
    """
    ready = embed(asked(queries), "text", embed_fn, dim)
    stored = "embedding" in chunks.columns
    flagged = flag_files(files, locations=locations, settings=settings)
    return hybrid_search(
        ready,
        chunks,
        files,
        index,
        vector_weight=vector_weight,
        keyword_weight=keyword_weight,
        top_k=top_k or TOP_K,
        restrict=restriction(flagged),
        add_vectors=None if stored else lambda rows: embed_rows(rows.select("chunk_id", "file_id", "snippet"), "snippet", embed_fn, dim),
    )
