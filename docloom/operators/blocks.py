"""The best chunks of many keyword queries, without scoring every match.

Postings are stored in blocks: all occurrences of a term in a few hundred neighbouring chunks are one row, whose short head holds their number, the
largest count and the shortest chunk. A chunk of the block can score no better than these two allow, so the heads of a query's terms bound
what any of its matches in a block can reach, before a posting is read; a block that lacks one of the terms has no match
at all. Each query reads its blocks in the order of this bound, some at first; once ``top_k`` matches are known, blocks whose bound lies
behind the last of them are never read. The result is that of ``fulltext.bm25_search``, ties included.

A block's row is bounded by its chunks, so a word of every chunk only has more rows, spread over as many files as they need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.fulltext import SCORE_DIGITS, Index, phrase_share, query_terms, term_bucket, terms_in, top_matches
from docloom.operators.nearest import best_per_query
from docloom.schemas import CHUNK_ID_STRIDE, TOP_K
from docloom.sources.sizes import written

#: Chunks that are aimed at in a block.
BLOCK_CHUNKS = 256
#: Chunks of a part of the corpus: a word of all chunks has so many postings in a task.
PART_CHUNKS = 1_000_000
#: The second round reads so many times more than the first; a third reads all that is left.
GROWTH = 8
ROUNDS = 3
#: Scores are rounded to nine places before they are compared.
SLACK = 2e-9


@dataclass(frozen=True)
class BlockIndex:
    """Blocks (term_bucket, term, block, n, most_tf, least_len, entries), with the vocabulary and statistics of the index."""

    blocks: DataFrame
    index: Index


@dataclass
class Reads:
    """Postings read by a search, and those of its queries' terms altogether."""

    read: int = 0
    of: int = 0
    rounds: int = 0


def block_of(chunk_id: Column, files_per_block: int, block_chunks: int = BLOCK_CHUNKS) -> Column:
    """Chunks of neighbouring files; a file of more chunks than a block has blocks of its own."""
    place = F.pmod(chunk_id, F.lit(CHUNK_ID_STRIDE))
    file_id = F.call_function("div", chunk_id - place, F.lit(CHUNK_ID_STRIDE))
    files = F.call_function("div", file_id, F.lit(files_per_block))
    return F.struct(files.alias("files"), F.call_function("div", place, F.lit(block_chunks)).alias("part"))


def store(index: Index, n_files: int, block_chunks: int = BLOCK_CHUNKS) -> BlockIndex:
    """Write the postings of an index in blocks. ``n_files``: how many files the chunks come from; it only sets the size of blocks."""
    n_chunks = index.stats.select("n_chunks").first()[0]
    files_per_block = max(1, block_chunks * max(n_files, 1) // max(n_chunks, 1))
    entry = F.struct("chunk_id", "file_id", "chunk_len", "tf")
    # Dealt once: by folder and by so many parts of the corpus that no task holds a frequent word of all chunks. A block is whole within its part.
    parts = 1 + n_chunks // PART_CHUNKS
    blocks = (
        index.postings.withColumn("term_bucket", term_bucket(F.col("term")))
        .withColumn("block", block_of(F.col("chunk_id"), files_per_block, block_chunks))
        .withColumn("_part", F.pmod(F.xxhash64("block"), F.lit(parts)))
        .repartition("term_bucket", "_part")
        .groupBy("term_bucket", "_part", "term", "block")
        .agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("chunk_len").alias("least_len"),
            F.collect_list(entry).alias("entries"),
        )
        .drop("_part")
        .sortWithinPartitions("term_bucket", "term")
    )
    return BlockIndex(written(blocks, "blocks", ("term_bucket",)), index)


def _bounds(terms: DataFrame, blocks: BlockIndex, share: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, block, bound, before): the blocks that can hold matches of each query, best first.

    ``before`` counts the matches that the better blocks of the query can have at most. Only the heads of blocks are read."""
    heads = terms_in(blocks.index, blocks.blocks.select("term_bucket", "term", "block", "n", "most_tf", "least_len"), terms)
    per_block = (
        heads.withColumn("best", share(F.col("most_tf"), F.col("least_len")))
        .groupBy("query_id", "block")
        .agg(F.count(F.lit(1)).alias("found"), F.first("n_terms").alias("n_terms"), F.sum("best").alias("bound"), F.min("n").alias("most"))
        .filter(F.col("found") == F.col("n_terms"))
    )
    in_order = Window.partitionBy("query_id").orderBy("bound", "block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select("query_id", "block", "bound", F.coalesce(F.sum("most").over(in_order), F.lit(0)).alias("before"))


def _matches(terms: DataFrame, chosen: DataFrame, blocks: BlockIndex, share: Callable[[Column, Column], Column]) -> DataFrame:
    """The matches of queries in their chosen blocks (query_id, block), scored."""
    wanted = terms.join(chosen.select("query_id", "block"), "query_id")
    rows = terms_in(blocks.index, blocks.blocks.select("term_bucket", "term", "block", "entries"), wanted, "block")
    entries = rows.select("query_id", "n_terms", "n_times", "df", F.inline("entries"))
    return (
        entries.withColumn("share", share(F.col("tf"), F.col("chunk_len")))
        .groupBy("query_id", "chunk_id", "file_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("found"), F.round(F.sum("share"), SCORE_DIGITS).alias("bm25"))
        .filter(F.col("found") == F.col("n_terms"))
        .select("query_id", "chunk_id", "file_id", "bm25")
    )


def search(
    queries: DataFrame,
    blocks: BlockIndex,
    top_k: int = TOP_K,
    restrict: Callable[[DataFrame], DataFrame] | None = None,
    reads: Reads | None = None,
) -> DataFrame:
    """Query strings (query_id, text) to their best chunks: every token must occur, ranked by BM25."""
    asked = query_terms(queries).withColumnRenamed("phrase", "term")
    known = terms_in(blocks.index, blocks.index.vocabulary.select("term_bucket", "term", "df"), asked)
    of_query = Window.partitionBy("query_id")
    counted = asked.select("query_id", F.count(F.lit(1)).over(of_query).alias("n_terms")).distinct()
    # A query with a term that occurs nowhere has no matches.
    terms = written(
        known.join(counted, "query_id").withColumn("n_known", F.count(F.lit(1)).over(of_query)).filter(F.col("n_known") == F.col("n_terms")).drop("n_known"),
        "block-terms",
    )
    weigh = phrase_share(blocks.index.stats)

    def share(tf: Column, length: Column) -> Column:
        return weigh(F.col("n_times"), F.col("df"), tf, length)

    bounds = written(_bounds(terms, blocks, share), "block-bounds")
    if reads is not None:
        reads.of += terms.agg(F.sum("df")).first()[0] or 0
    found: DataFrame | None = None
    left, budget = bounds, top_k
    for turn in range(ROUNDS):
        last = turn + 1 == ROUNDS
        chosen = written(left if last else left.filter(F.col("before") < budget), "chosen-blocks")
        if reads is not None:
            pairs = terms.join(chosen, "query_id").select("term", "block").distinct()
            reads.read += blocks.blocks.join(pairs, ["term", "block"]).agg(F.sum("n")).first()[0] or 0
            reads.rounds += 1
        matches = _matches(terms, chosen, blocks, share)
        if restrict is not None:
            matches = restrict(matches)
        together = matches if found is None else found.unionByName(matches)
        found = written(best_per_query(together, ["bm25", "chunk_id"], top_k).drop("rank"), "block-matches")
        if last:
            break
        limits = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("bm25").alias("worst")).filter(F.col("n") >= top_k)
        beyond = left.filter(F.col("before") >= budget).join(limits.drop("n"), "query_id", "left")
        left = written(
            beyond.filter(F.col("worst").isNull() | (F.col("bound") <= F.col("worst") + SLACK)).drop("worst"), "blocks-left"
        )
        if left.isEmpty():
            break
        budget *= GROWTH
    return top_matches(found, top_k)
