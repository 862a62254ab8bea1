"""Ranked lexical search, term at a time, with a limited number of accumulators.

Documents stay in their partitions; the queries come to them in blocks of bounded size. A first pass counts terms: how many documents
there are, how long they are, and in how many each term of the block occurs. In a second pass every task builds, for a slice of its
documents, the postings of the block's terms and their largest impacts, and answers the block's queries on the slice: terms come rarest first,
each adds its scores to the accumulators of its documents, and once the largest scores that the remaining terms could add up to cannot reach the kth
score any more, no new accumulator is opened: the remaining terms only update those that are there, exactly. The score
to reach is the kth partial score of the slice or the kth score of the task's earlier slices, whichever is higher; it is at
most the kth of all documents, and an accumulator that is not opened could only have stayed below it. So the result is that of scoring everything.

Tasks return k documents a query, ranked in two steps, so that the hits of one query never meet from all tasks at once.
Memory is a slice and its postings. A word that most documents hold only makes longer postings; no row is made for a pair of query and document.

Scores are whole numbers, see ``weights`` and ``impacts``. Defined results: null and empty texts have no terms, and no
hits as queries; repeated rows are documents, or queries, of their own; a null id of a document comes after all
others among equal scores; documents without a term of the query are no hits; an empty table on either side gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.columns import once
from docloom.llm.textscan import LOWER, coded, compact, runs, slices, text_bytes

TOP = 10
#: Bytes of queries' texts that are sent to every task at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of documents that are scored together.
SLICE_BYTES = 8 << 20

#: Bytes of terms: 0-9, A-Z, a-z and all beyond ASCII.
TERM = np.ones(256, bool)
TERM[0x00:0x30] = TERM[0x3A:0x41] = TERM[0x5B:0x61] = TERM[0x7B:0x80] = False


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The code of every term, the distinct terms, and the first term of each text (one more for the end)."""
    member = TERM[data]
    starts, ends, first = runs(member, offsets)
    codes, distinct = coded(compact(LOWER[data], member, starts, ends))
    return codes, distinct, first


@dataclass(frozen=True)
class Block:
    """Queries as numbers of the block's terms, with the times that each occurs in a query."""

    terms: dict[bytes, int]
    queries: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        codes, distinct, first = terms_of(data, offsets)
        queries = [np.unique(codes[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        return cls({t: i for i, t in enumerate(distinct)}, queries)

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """The block's number of each term, -1 if no query has it."""
        return np.fromiter((self.terms.get(t, -1) for t in distinct), np.int64, len(distinct))


@dataclass(frozen=True)
class Counts:
    """Over all documents: those with a term, all terms, and the documents that hold each term of a block."""

    documents: int
    terms: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(f) + 1))) for f in self.frequency], np.int64)

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What an occurrence count contributes for each unit of weight, in a document of so many terms."""
        scaled = 25 + (75 * length * self.documents) // max(self.terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * scaled)


@dataclass(frozen=True)
class Postings:
    """A slice of documents: for each term of the block its documents, in order, and their impacts."""

    n: int
    begins: np.ndarray
    documents: np.ndarray
    impacts: np.ndarray
    largest: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, block: Block, counts: Counts) -> Postings:
        term, document, tf, length = occurrences(data, offsets, block)
        impacts = counts.impacts(tf, length[document])
        begins = np.searchsorted(term, np.arange(len(block.terms) + 1))
        largest = np.zeros(len(block.terms), np.int64)
        held = np.flatnonzero(np.diff(begins))
        if len(held):
            largest[held] = np.maximum.reduceat(impacts, begins[held])
        return cls(len(length), begins, document, impacts, largest)


def occurrences(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By term and document: the block's term, the document, its occurrences there; and the number of terms of every document."""
    codes, distinct, first = terms_of(data, offsets)
    length = np.diff(first)
    known = block.numbers(distinct)[codes] if len(codes) else codes
    at = np.flatnonzero(known >= 0)
    document = np.repeat(np.arange(len(length)), length)[at]
    pairs, tf = np.unique(known[at] * max(len(length), 1) + document, return_counts=True)
    return pairs // max(len(length), 1), pairs % max(len(length), 1), tf, length


def best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above zero; equal ones by id, nulls last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], null[at], -scores[at]))][:k]


@dataclass
class Work:
    """What answering has cost so far: accumulators opened, postings read, and those that opened one."""

    opened: int = 0
    read: int = 0
    updates: int = 0


def accumulate(
    postings: Postings, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, frequency: np.ndarray, k: int, least: int, work: Work | None = None,
) -> np.ndarray:
    """The scores of a slice's documents for one query: exact for every document that can be among the k best of all, given
    that k documents elsewhere score ``least`` or more (0: nothing is known)."""
    order = np.lexsort((terms, frequency[terms]))
    terms, worth = terms[order], (times * weights[terms])[order]
    # What this term and all later ones can add at most.
    ahead = np.append(np.cumsum((worth * postings.largest[terms])[::-1])[::-1], 0)
    scores = np.zeros(postings.n, np.int64)
    opened = np.zeros(postings.n, bool)
    n_open, more, highest = 0, True, 0
    for i, term in enumerate(terms.tolist()):
        a, b = postings.begins[term], postings.begins[term + 1]
        if a == b or not worth[i]:
            continue
        if more and ahead[i] <= max(highest, least):
            reach = least
            if n_open >= k:
                reach = max(reach, int(np.partition(scores[opened], n_open - k)[n_open - k]))
            # A document that only reaches the kth score may still come before it by its id.
            more = ahead[i] >= reach
        documents, added = postings.documents[a:b], worth[i] * postings.impacts[a:b]
        if not more:
            survive = opened[documents]
            documents, added = documents[survive], added[survive]
        scores[documents] += added  # a term has a document once
        if more:
            opened[documents] = True
            n_open = int(np.count_nonzero(opened))
        if len(documents):
            highest = max(highest, int(scores[documents].max()))
        if work is not None:
            work.read, work.updates = work.read + int(b - a), work.updates + len(documents)
    if work is not None:
        work.opened += n_open
    return scores


def _counted(block_of, column: str):
    """Per task: documents with a term and all terms (number -1), and documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of()
        frequency, documents, words = np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for _, data, offsets in slices(batch, column, SLICE_BYTES):
                term, _, _, length = occurrences(data, offsets, block)
                frequency += np.bincount(term, minlength=len(frequency))
                documents += int(np.count_nonzero(length))
                words += int(length.sum())
        held = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(frequency[held], documents)), pa.array(np.append(held * 0, words))],
            names=["number", "documents", "terms"],
        )

    return run


def _answered(block_of, counts: Counts, k: int):
    """Per task: the k best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = block_of(), counts.weights()
        task = TaskContext.get().partitionId()
        none = np.empty(0, np.int64)
        held = [(none, none, none.astype(bool))] * len(block.queries)
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text", SLICE_BYTES):
                postings = Postings.of(data, offsets, block, counts)
                null = rows["_id"].is_null().to_numpy(zero_copy_only=False)
                ids = rows["_id"].fill_null(0).to_numpy()
                for q, (terms, times) in enumerate(block.queries):
                    scores, own, nulls = held[q]
                    least = int(scores[-1]) if len(scores) == k else 0
                    found = accumulate(postings, terms, times, weights, counts.frequency, k, least)
                    at = np.flatnonzero(found >= max(least, 1))
                    if not len(at):
                        continue
                    scores, own, nulls = (np.concatenate(x) for x in ((scores, found[at]), (own, ids[at]), (nulls, null[at])))
                    keep = best(scores, own, nulls, k)
                    held[q] = scores[keep], own[keep], nulls[keep]
        sizes = [len(h[0]) for h in held]
        if sum(sizes):
            scores, ids, nulls = (np.concatenate([h[i] for h in held]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(held)), sizes)), pa.array(np.full(len(ids), task)), pa.array(ids, mask=nulls), pa.array(scores)],
                names=["_query", "_task", "_id", "_score"],
            )

    return run


def _blocks(queries: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[DataFrame]:
    """The queries in parts of about ``block_bytes``, or one longer text."""
    named = queries.select(F.col(id_column).alias("_item"), F.col(text_column).alias("_text")).filter("_text IS NOT NULL")
    total = named.agg(F.sum(F.octet_length("_text").cast("long") + 16)).first()[0] or 0
    parts = -(-total // block_bytes)
    if parts > 1:
        named = once(named.withColumn("_part", F.pmod(F.xxhash64("_item", "_text"), F.lit(parts))), "queries")
    for part in range(parts):
        yield named.filter(F.col("_part") == part).drop("_part") if parts > 1 else named


def search(
    docs: DataFrame, queries: DataFrame, id_column: str = "doc_id", text_column: str = "text", query_column: str = "item_id",
    query_text_column: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query id, rank, document id, score): the k best documents for each query."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    kind = queries.schema[query_column].dataType
    results: list[DataFrame] = []
    for part in _blocks(queries, query_column, query_text_column, block_bytes):
        rows = part.toArrow()  # a block
        sent = spark.sparkContext.broadcast(Block.of(rows["_text"].to_pylist()))

        def block_of(sent=sent):
            return sent.value

        n = len(sent.value.terms)
        partial = named.select("_text").mapInArrow(_counted(block_of, "_text"), "number long, documents long, terms long")
        total = partial.groupBy("number").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).toArrow()
        numbers, documents = total["number"].to_numpy(), total["documents"].to_numpy()
        frequency = np.zeros(n, np.int64)
        frequency[numbers[numbers >= 0]] = documents[numbers >= 0]
        counts = Counts(int(documents[numbers < 0].sum()), int(total["terms"].to_numpy()[numbers < 0].sum()), frequency)
        hits = named.mapInArrow(_answered(block_of, counts, k), "_query long, _task long, _id long, _score long")
        items = spark.createDataFrame(
            pa.table({"_query": pa.array(range(rows.num_rows), pa.int64()), "_item": rows["_item"]}),
            T.StructType([T.StructField("_query", T.LongType()), T.StructField("_item", kind)]),
        )
        results.append(_ranked(hits, k).join(F.broadcast(items), "_query"))
    if not results:
        empty = T.StructType([T.StructField(query_column, kind), *[T.StructField(c, t) for c, t in (("rank", T.IntegerType()), (id_column, T.LongType()), ("score", T.LongType()))]])
        return spark.createDataFrame([], empty)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.select(F.col("_item").alias(query_column), "rank", F.col("_id").alias(id_column), F.col("_score").alias("score"))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query: of groups of a thousand tasks first, then of these."""
    order = (F.col("_score").desc(), F.col("_id").asc_nulls_last())
    group = F.floor(F.col("_task") / 1000)
    first = F.row_number().over(Window.partitionBy("_query", group).orderBy(*order))
    some = hits.withColumn("_rank", first).filter(F.col("_rank") <= k).drop("_rank")
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(*order))
    return some.withColumn("rank", rank).filter(F.col("rank") <= k)
