"""Inverted index, matching and BM25 ranking for many queries at once.

Queries are relations, not strings: a row (query_id, phrase, n_times) per distinct phrase of a
query, a phrase being its tokens joined by single spaces. Every matching operator produces *hits*,
one row (phrase, chunk_id, file_id, chunk_len, starts, tf) per phrase and chunk it occurs in.
Conjunctions start from the rarest phrase of each query and look the others up by (phrase,
chunk_id): a frequent word is never multiplied by the number of queries that use it, and no key
gathers more than one chunk's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.tokens import tokenize
from docloom.operators.nearest import best_per_query
from docloom.operators.prefixes import in_intervals, prefix_pairs
from docloom.schemas import TOP_K
from docloom.sources.sizes import MAX_BROADCAST_ROWS, Settled, settled, written

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6

# Scores are rounded before ranking so that equal sums tie whatever order they are added in.
SCORE_DIGITS = 9

# Postings are kept in this many folders by term, so that a search reads those of its terms only.
TERM_BUCKETS = 64

# Up to so many terms are part of the filter on the postings.
MAX_TERMS_PUSHED = 1000


@dataclass(frozen=True)
class Index:
    """What a keyword search reads: postings, document frequencies and corpus statistics."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    term_buckets: int = TERM_BUCKETS
    #: The vocabulary once more, in files by ranges of terms; without it, prefixes are looked up in all buckets.
    terms: DataFrame | None = None


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


_POSTING = "term string, chunk_id long, file_id long, chunk_len int, positions array<int>, tf int"


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their tokens to postings: all tokens of a batch are ordered by (token, chunk) once, so that what a chunk costs follows its length.

    Postings leave in the order of their terms: what sorts them by term later merges runs."""
    for batch in batches:
        lengths = batch["tokens"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = batch["tokens"].flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by_term = pc.array_sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = rank[code] * len(lengths) + chunk
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(begins, len(order)).astype(np.int32)
        first = order[begins]
        of_chunk = pa.array(chunk[first])
        columns = {
            "term": words.dictionary.take(pa.array(code[first])),
            "chunk_id": batch["chunk_id"].take(of_chunk),
            "file_id": batch["file_id"].take(of_chunk),
            "chunk_len": pa.array(lengths[chunk[first]], pa.int32()),
            "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order], pa.int32())),
            "tf": pa.array(np.diff(ends), pa.int32()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def postings(chunks: DataFrame, snippet: str = "snippet") -> DataFrame:
    """Inverted index of the snippets: term, chunk, positions. Built inside each batch of chunks, no shuffle."""
    tokens = chunks.select(
        F.col("chunk_id").cast("long"), F.col("file_id").cast("long"), tokenize(F.col(snippet)).alias("tokens")
    )
    return tokens.mapInArrow(_inverted, _POSTING)


def corpus_counts(snippet: str = "snippet") -> list[Column]:
    """Aggregates: number of chunks and of tokens."""
    n_tokens = F.coalesce(F.sum(F.size(tokenize(F.col(snippet))).cast("long")), F.lit(0))
    return [F.count(F.lit(1)).alias("n_chunks"), n_tokens.alias("n_tokens")]


def corpus_stats(chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row: number of chunks, of tokens, and the average chunk length, over all chunks. With the postings of the chunks
    as ``index`` their tokens are summed up there, instead of being cut once more."""
    average = F.col("n_tokens") / F.nullif(F.col("n_chunks"), F.lit(0))
    if index is None:
        return chunks.agg(*corpus_counts()).withColumn("avg_len", average)
    n_tokens = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("n_tokens"))
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(F.broadcast(n_tokens)).withColumn("avg_len", average)


def term_stats(index: DataFrame) -> DataFrame:
    """Document frequency and occurrences per term."""
    return index.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf")
    )


def build_index(chunks: DataFrame) -> Index:
    """The index of a chunk table; write its tables before searching more than once."""
    rows = postings(chunks)
    return Index(rows, term_stats(rows), corpus_stats(chunks))


def in_folders(table: DataFrame) -> DataFrame:
    """Rows by term, ready to be written in folders by term bucket.

    Rebalancing splits the bucket of a frequent word over as many files as its size asks for.
    """
    return (
        table.withColumn("term_bucket", term_bucket(F.col("term")))
        .hint("rebalance", "term_bucket")
        .sortWithinPartitions("term_bucket", "term")
    )


def written_index(chunks: DataFrame) -> Index:
    """The index of a chunk table, written to the shared folder."""
    folders = ("term_bucket",)
    rows = written(in_folders(postings(chunks)), "postings", folders, compression="zstd")
    vocabulary = written(in_folders(term_stats(rows)), "vocabulary", folders)
    return Index(
        rows,
        vocabulary,
        written(corpus_stats(chunks, rows), "stats"),
        terms=written(in_ranges(vocabulary), "terms"),
    )


def in_ranges(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary in files by ranges of terms, so that the terms of a prefix lie in one file, or a few."""
    return vocabulary.select("term", "df").repartitionByRange("term").sortWithinPartitions("term")


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """Query strings to single-token phrases, all of which must match. Blank queries give none."""
    return (
        queries.select("query_id", F.explode(tokenize(F.col(text))).alias("phrase"))
        .groupBy("query_id", "phrase")
        .agg(F.count(F.lit(1)).cast("int").alias("n_times"))
    )


def query_phrase(queries: DataFrame, text: str = "text") -> DataFrame:
    """Query strings to one phrase each, its tokens adjacent and in order."""
    return queries.select(
        "query_id",
        F.array_join(tokenize(F.col(text)), " ").alias("phrase"),
        F.lit(1).alias("n_times"),
    ).filter(F.col("phrase") != "")


def _by_term(index: Index, table: DataFrame, wanted: Settled, rows: DataFrame) -> DataFrame:
    """``table`` joined with ``rows``, no more than ``wanted`` has, on term.

    Where the table is kept in folders by term, only the folders of the wanted terms are read, and as files are
    sorted by term, a short list of terms skips what lies between them.
    """
    terms = wanted.distinct("term")
    if terms is not None and len(terms) <= MAX_TERMS_PUSHED:
        table = table.filter(F.col("term").isin(*terms) if terms else F.lit(False))
    if "term_bucket" not in table.columns:
        return table.join(wanted.hint(rows), "term")
    folders = wanted.distinct("term_bucket")
    if folders is not None:
        table = table.filter(F.col("term_bucket").isin(*folders) if folders else F.lit(False))
    rows = rows.withColumn("term_bucket", term_bucket(F.col("term"), index.term_buckets))
    return table.join(wanted.hint(rows), ["term_bucket", "term"]).drop("term_bucket")


def _wanted_terms(index: Index, terms: DataFrame, name: str) -> Settled:
    bucket = term_bucket(F.col("term"), index.term_buckets)
    return settled(terms.withColumn("term_bucket", bucket), name)


def terms_in(index: Index, table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``table`` (term_bucket, term, ...) joined with ``rows`` on term and further keys; if the rows are few, only the folders of their terms are read."""
    wanted = _wanted_terms(index, rows, "wanted-terms")
    if wanted.small:
        folders, terms = wanted.distinct("term_bucket"), wanted.distinct("term")
        table = table.filter(F.col("term_bucket").isin(*folders) if folders else F.lit(False))
        if len(terms) <= MAX_TERMS_PUSHED:
            table = table.filter(F.col("term").isin(*terms) if terms else F.lit(False))
    return table.join(wanted.hint(wanted.df), ["term_bucket", "term", *keys]).drop("term_bucket")


_HIT = ["phrase", "chunk_id", "file_id", "chunk_len", "starts", "tf"]


def term_hits(phrases: DataFrame, index: Index) -> DataFrame:
    """Hits of single-token phrases."""
    wanted = _wanted_terms(index, phrases.select(F.col("phrase").alias("term")).distinct(), "terms")
    return (
        _by_term(index, index.postings, wanted, wanted.df.select("term"))
        .withColumnRenamed("term", "phrase")
        .withColumnRenamed("positions", "starts")
        .select(*_HIT)
    )


def _streamed(
    table: DataFrame, places: DataFrame, keys: list[str], bound: float
) -> DataFrame:
    """Join open places with the postings or hits that may confirm them.

    The rarest phrase or token proposed the places, so its frequency bounds their number before
    anything is read. Few places are broadcast, and the long lists of frequent words are read past
    them without a shuffle; otherwise both sides are shuffled by phrase or term *and* chunk.
    """
    if bound <= MAX_BROADCAST_ROWS:
        places = F.broadcast(places)
    return table.join(places, keys)


def phrase_hits(phrases: DataFrame, index: Index) -> DataFrame:
    """Hits of phrases of any length: adjacent tokens in order.

    The rarest token of a phrase proposes the places, the other tokens must confirm them.
    """
    split = F.split("phrase", " ")
    tokens = _wanted_terms(
        index,
        phrases.select("phrase")
        .distinct()
        .select("phrase", F.size(split).alias("n"), F.posexplode(split).alias("i", "term")),
        "phrase-tokens",
    )
    # A token that occurs nowhere is missing from the vocabulary, and its phrases with it.
    known = _by_term(index, index.vocabulary, tokens, tokens.df.select("phrase", "n", "i", "term"))
    per_phrase = known.groupBy("phrase", "n").agg(
        F.min(F.struct("df", "i", "term")).alias("rarest"),
        F.count(F.lit(1)).alias("known"),
    )
    pivots = settled(
        per_phrase.filter(F.col("known") == F.col("n")).select(
            "phrase",
            "n",
            F.col("rarest.i").alias("pivot_i"),
            F.col("rarest.term").alias("term"),
            term_bucket(F.col("rarest.term"), index.term_buckets).alias("term_bucket"),
            (F.col("rarest.df") * (F.col("n") - 1)).alias("n_open"),
        ),
        "phrase-pivots",
    )
    places = _by_term(
        index, index.postings, pivots, pivots.df.drop("term_bucket", "n_open")
    ).select(
        "phrase",
        "n",
        "pivot_i",
        "chunk_id",
        "file_id",
        "chunk_len",
        F.filter(
            F.transform("positions", lambda p: p - F.col("pivot_i")), lambda s: s >= 0
        ).alias("starts"),
    )
    single = places.filter(F.col("n") == 1).withColumn("tf", F.size("starts"))
    others = (
        places.filter((F.col("n") > 1) & (F.size("starts") > 0))
        .join(tokens.hint(tokens.df.select("phrase", "i", "term")), "phrase")
        .filter(F.col("i") != F.col("pivot_i"))
    )
    other_terms = tokens.df.filter(F.col("n") > 1).select("term").distinct()
    other_postings = _by_term(index, index.postings, tokens, other_terms)
    confirmed = (
        _streamed(
            other_postings.select("term", "chunk_id", "positions"),
            others,
            ["term", "chunk_id"],
            pivots.bound("n_open"),
        )
        .withColumn(
            "kept",
            F.filter("starts", lambda s: F.array_contains(F.col("positions"), s + F.col("i"))),
        )
        .groupBy("phrase", "n", "chunk_id", "file_id", "chunk_len", "starts")
        .agg(F.collect_list("kept").alias("kept"))
        .filter(F.size("kept") == F.col("n") - 1)
        .withColumn(
            "starts",
            F.aggregate("kept", F.col("starts"), lambda left, kept: F.array_intersect(left, kept)),
        )
        .filter(F.size("starts") > 0)
        .withColumn("tf", F.size("starts"))
    )
    return single.select(*_HIT).unionByName(confirmed.select(*_HIT))


def prefix_terms(prefixes: Settled, index: Index) -> DataFrame:
    """(phrase, term): the terms that start with each prefix.

    They are an interval of the vocabulary in its order. The intervals are a filter on the vocabulary, which skips the files and row
    groups between them, and terms meet the prefixes in one pass over both in order."""
    vocabulary = index.vocabulary if index.terms is None else index.terms
    wanted = prefixes.distinct("phrase")
    if wanted is not None and len(wanted) <= MAX_TERMS_PUSHED:
        vocabulary = vocabulary.filter(in_intervals(F.col("term"), wanted))
    pairs = prefix_pairs(
        vocabulary.select(F.col("term").alias("_key"), F.col("term").alias("_string")),
        prefixes.df.select(F.col("phrase").alias("_key"), F.col("phrase").alias("_string")),
    )
    return pairs.select(F.col("_prefix").alias("phrase"), F.col("_key").alias("term"))


def prefix_hits(phrases: DataFrame, index: Index) -> DataFrame:
    """Hits of token prefixes: the occurrences of every term that starts with one."""
    wanted = settled(phrases.select("phrase").distinct(), "prefixes")
    matching = _wanted_terms(index, prefix_terms(wanted, index), "prefix-terms")
    return (
        _by_term(index, index.postings, matching, matching.df.select("phrase", "term"))
        .groupBy("phrase", "chunk_id", "file_id", "chunk_len")
        .agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("starts"))
        .withColumn("tf", F.size("starts"))
        .select(*_HIT)
    )


def first_token_hits(hits: DataFrame) -> DataFrame:
    """Of phrase hits, those that start a chunk; only that one occurrence counts."""
    return (
        hits.filter(F.array_contains("starts", 0))
        .withColumn("starts", F.array(F.lit(0)))
        .withColumn("tf", F.lit(1))
    )


def near_sweep(starts: list[list[int]], lengths: list[int], distance: int) -> list[list[int]]:
    """Of each phrase, the starts that take part in a clump: all phrases occur, and at most ``distance`` tokens lie between the end
    of each and the start of the last.

    One pass over the sorted starts: the phrase that lags too far behind the foremost moves on; when all are within reach they
    are a clump, and the phrase whose next start is the smallest moves on."""
    n = len(starts)
    at, kept = [0] * n, [[] for _ in range(n)]
    if not all(starts):
        return kept
    while True:
        front, settled_ = starts[0][at[0]], False
        while not settled_:
            settled_ = True
            for i in range(n):
                reach = front - lengths[i] - distance
                if not reach <= starts[i][at[i]] <= front:
                    settled_ = False
                    while starts[i][at[i]] < reach:
                        at[i] += 1
                        if at[i] == len(starts[i]):
                            return kept
                    front = max(front, starts[i][at[i]])
        for i in range(n):
            if not kept[i] or kept[i][-1] != starts[i][at[i]]:
                kept[i].append(starts[i][at[i]])
        ahead = [starts[i][at[i] + 1] if at[i] + 1 < len(starts[i]) else None for i in range(n)]
        following = [(p, i) for i, p in enumerate(ahead) if p is not None]
        if not following:
            return kept
        at[min(following)[1]] += 1


_GROUP_HIT = "query_id long, chunk_id long, file_id long, chunk_len int, phrase string, starts array<int>"


def _within_reach(phrases: pa.ListArray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of a batch, whether it may hold a clump, and whether each phrase occurs once, so that this is already certain.

    A clump ends at or behind the first start of every phrase, and no phrase's last start lies too far before its end."""
    members = phrases.flatten()
    starts = members.field("starts")
    sizes = phrases.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    times = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.append(starts.flatten().to_numpy(zero_copy_only=False), 0).astype(np.int64)
    end = np.cumsum(times)
    group = np.repeat(np.arange(len(sizes)), sizes)
    lengths = pc.count_substring(members.field("phrase"), " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1
    begins = np.cumsum(sizes) - sizes
    front = np.maximum.reduceat(places[end - times], begins)
    reach = np.minimum.reduceat(places[np.maximum(end - 1, 0)] + lengths + distance[group], begins)
    least, most = np.minimum.reduceat(times, begins), np.maximum.reduceat(times, begins)
    return (least > 0) & (front <= reach), most == 1


def _sweep_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each phrase of a group and chunk in which the group matches.

    Only groups within reach leave their columns, and of these only those with a repeated phrase are swept."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
    names = ["query_id", "chunk_id", "file_id", "chunk_len", "phrase", "starts"]
    for batch in batches:
        if not batch.num_rows:
            continue
        may, certain = _within_reach(batch["phrases"], batch["distance"].to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[list] = [[] for _ in range(6)]
        for row, once in zip(batch.filter(pa.array(may)).to_pylist(), certain[may].tolist(), strict=True):
            phrases, starts = ([p[k] for p in row["phrases"]] for k in ("phrase", "starts"))
            kept = starts if once else near_sweep(starts, [p.count(" ") + 1 for p in phrases], row["distance"])
            if kept[0]:
                for phrase, own in zip(phrases, kept, strict=True):
                    values = (row["query_id"], row["chunk_id"], row["file_id"], row["chunk_len"], phrase, own)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def near_group_hits(groups: DataFrame, hits: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """NEAR of any number of phrases: ``groups`` has (query_id, phrases, distance).

    A row per phrase of a group and chunk where all of them are near each other, with the starts that take part. The rarest
    phrase of each group proposes the chunks; the others are looked up there by phrase and chunk."""
    frequency = document_frequency(hits) if frequency is None else frequency
    of_query = Window.partitionBy("query_id")
    members = groups.select("query_id", "distance", F.size("phrases").alias("n"), F.posexplode("phrases").alias("i", "phrase"))
    known = members.join(frequency, "phrase").withColumn("known", F.count(F.lit(1)).over(of_query)).filter(F.col("known") == F.col("n"))
    turn = F.row_number().over(of_query.orderBy("df", "i"))
    first = F.when(F.col("turn") == 1, F.col("df") * (F.col("n") - 1)).otherwise(0)
    wanted = settled(known.withColumn("turn", turn).withColumn("n_open", first).drop("known"), "near-groups")
    phrases = wanted.df.select("query_id", "distance", "n", "i", "phrase", "turn")
    one = F.struct("i", "phrase", "starts")
    place = ["query_id", "distance", "n", "chunk_id", "file_id", "chunk_len"]
    opened = hits.join(wanted.hint(phrases.filter("turn = 1")), "phrase").select(*place, one.alias("own"))
    asked = opened.select("query_id", "chunk_id").join(wanted.hint(phrases.filter("turn > 1")), "query_id")
    found = _streamed(hits, asked, ["phrase", "chunk_id"], wanted.bound("n_open")).select(*place, one.alias("own"))
    whole = (
        opened.unionByName(found).groupBy(*place).agg(F.array_sort(F.collect_list("own")).alias("phrases"))
        .filter(F.size("phrases") == F.col("n"))
    )
    near = whole.select("query_id", "chunk_id", "file_id", "chunk_len", "distance", "phrases").mapInArrow(_sweep_groups, _GROUP_HIT)
    return near.withColumn("tf", F.size("starts"))


def document_frequency(hits: DataFrame) -> DataFrame:
    """Number of chunks each phrase occurs in; the partial count runs before the shuffle."""
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))


def phrase_share(stats: DataFrame) -> Callable[[Column, Column, Column, Column], Column]:
    """A phrase's share of BM25: a function of how often it is asked, its document frequency, its occurrences and the chunk's length."""
    corpus = stats.select("n_chunks", "avg_len").first()
    average = F.lit(corpus.avg_len).cast("double")

    def share(n_times: Column, df: Column, tf: Column, chunk_len: Column) -> Column:
        idf = F.log((corpus.n_chunks - df + 0.5) / (df + 0.5))
        weight = F.when(idf > 0, idf).otherwise(F.lit(MIN_IDF))
        norm = K1 * ((1 - B) + B * chunk_len / average)
        return -n_times * weight * tf * (K1 + 1) / (tf + norm)

    return share


def _phrase_score(stats: DataFrame) -> Column:
    """A phrase's share of BM25, from columns n_times, df, tf and chunk_len."""
    return phrase_share(stats)(*map(F.col, ("n_times", "df", "tf", "chunk_len")))


_MATCH = ["query_id", "chunk_id", "file_id", "chunk_len", "n_times", "df", "tf"]


def _scored(matches: DataFrame, stats: DataFrame) -> DataFrame:
    return (
        matches.withColumn("share", _phrase_score(stats))
        .groupBy("query_id", "chunk_id", "file_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_matched"),
            F.round(F.sum("share"), SCORE_DIGITS).alias("bm25"),
        )
    )


def match_any(
    terms: DataFrame, hits: DataFrame, stats: DataFrame, frequency: DataFrame | None = None
) -> DataFrame:
    """OR: chunks with at least one phrase of the query, scored by those they have."""
    frequency = document_frequency(hits) if frequency is None else frequency
    wanted = settled(terms.join(frequency, "phrase"), "any-terms")
    return _scored(hits.join(wanted.hint(wanted.df), "phrase").select(*_MATCH), stats)


def _all_matched(places: DataFrame) -> DataFrame:
    return places.select(
        "query_id",
        "chunk_id",
        "file_id",
        F.col("n").alias("n_matched"),
        F.round("score", SCORE_DIGITS).alias("bm25"),
    )


def match_all(
    terms: DataFrame,
    hits: DataFrame,
    stats: DataFrame,
    restrict: Callable[[DataFrame], DataFrame] | None = None,
    frequency: DataFrame | None = None,
) -> DataFrame:
    """AND: chunks with every phrase of the query.

    ``restrict`` keeps the rows whose file may be found; frequencies stay those of the whole
    corpus.
    """
    frequency = document_frequency(hits) if frequency is None else frequency
    of_query = Window.partitionBy("query_id")
    known = terms.join(frequency, "phrase", "left").select(
        *terms.columns,
        "df",
        F.count(F.lit(1)).over(of_query).cast("int").alias("n"),
        F.count("df").over(of_query).alias("n_known"),
        F.row_number().over(of_query.orderBy("df", "phrase")).alias("turn"),
    )
    # At most a row per phrase of a query; a query with a phrase found nowhere has no matches.
    first_turn = F.col("turn") == 1
    wanted = settled(
        known.filter(F.col("n") == F.col("n_known"))
        .withColumn("n_second", F.when(first_turn & (F.col("n") > 1), F.col("df")).otherwise(0))
        .withColumn("n_rest", F.when(first_turn & (F.col("n") > 2), F.col("df") * (F.col("n") - 2)).otherwise(0)),
        "all-terms",
    )
    phrases = wanted.df.select("query_id", "phrase", "n_times", "df", "n", "turn")
    share = _phrase_score(stats)
    occurrences = hits.select("phrase", "chunk_id", "file_id", "chunk_len", "tf")

    def confirmed(places: DataFrame, turns: Column, bound: float) -> DataFrame:
        """Places joined with the occurrences of the phrases whose turn it is."""
        these = phrases.filter(turns).drop("n", "turn")
        looked_up = occurrences.drop("file_id").join(
            wanted.hint(these.select("phrase").distinct()), "phrase", "left_semi"
        )
        asked = places.join(wanted.hint(these), "query_id")
        return _streamed(looked_up, asked, ["phrase", "chunk_id"], bound)

    place = ["query_id", "chunk_id", "file_id", "n", "score"]
    first = (
        occurrences.join(wanted.hint(phrases.filter(first_turn)), "phrase")
        .withColumn("score", share)
        .select(*place)
    )
    if restrict is not None:
        first = restrict(first)
    longest = wanted.most("n")
    if longest <= 1:
        return _all_matched(first)
    # Each turn continues from the places that the one before has left, which are written once.
    first = written(first, "first-places")
    # The second rarest phrase leaves few of the places; only those are asked for the others.
    second = (
        confirmed(first.filter(F.col("n") > 1), F.col("turn") == 2, wanted.bound("n_second"))
        .withColumn("score", F.col("score") + share)
        .select(*place)
    )
    complete = first.filter(F.col("n") == 1).unionByName(second.filter(F.col("n") == 2))
    if longest <= 2:
        return _all_matched(complete)
    second = written(second, "second-places")
    rest = (
        confirmed(second.filter(F.col("n") > 2), F.col("turn") > 2, wanted.bound("n_rest"))
        .withColumn("share", share)
        .groupBy(*place)
        .agg(F.count(F.lit(1)).alias("n_more"), F.sum("share").alias("more"))
        .filter(F.col("n_more") == F.col("n") - 2)
        .withColumn("score", F.col("score") + F.col("more"))
        .select(*place)
    )
    complete = first.filter(F.col("n") == 1).unionByName(second.filter(F.col("n") == 2))
    return _all_matched(complete.unionByName(rest))


def match_not(matches: DataFrame, excluded: DataFrame) -> DataFrame:
    """NOT: matches of a query without the chunks that the same query excludes."""
    return matches.join(
        excluded.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti"
    )


def match_near(pairs: DataFrame, hits: DataFrame, stats: DataFrame) -> DataFrame:
    """Chunks where both phrases of a pair (query_id, left, right, distance) stand near each other, scored by BM25."""
    return match_near_group(pairs.select("query_id", F.array("left", "right").alias("phrases"), "distance"), hits, stats)


def match_near_group(groups: DataFrame, hits: DataFrame, stats: DataFrame) -> DataFrame:
    """Chunks where all phrases of a group (query_id, phrases, distance) stand near each other, scored by BM25.

    Occurrences taking part are counted, but a phrase is as frequent as it is on its own.
    """
    frequency = settled(document_frequency(hits), "near-frequency")
    near = near_group_hits(groups, hits, frequency.df).withColumn("n_times", F.lit(1))
    return _scored(near.join(frequency.hint(frequency.df), "phrase").select(*_MATCH), stats)


def top_matches(matches: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The best ``top_k`` matches per query: lowest bm25, then lowest chunk id.

    The limit on the row number runs in every task before the shuffle, so a query that matches a
    third of the corpus moves ``top_k`` rows per task.
    """
    return best_per_query(matches, ["bm25", "chunk_id"], top_k)


def bm25_search(
    queries: DataFrame,
    index: Index,
    top_k: int = TOP_K,
    restrict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Query strings to their best chunks: every token must occur, ranked by BM25.

    Queries with the same tokens are matched once, so that repeating a query of frequent words
    costs nothing but its own answer.
    """
    sets = (
        query_terms(queries)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("phrase", "n_times"))).alias("terms"))
    )
    leads = sets.groupBy("terms").agg(F.min("query_id").alias("lead"))
    is_lead = F.col("query_id") == F.col("lead")
    asked = settled(
        sets.join(leads, "terms").select(
            "query_id", "lead", F.when(is_lead, F.col("terms")).alias("terms")
        ),
        "queries",
    )
    terms = asked.df.filter(is_lead).select("query_id", F.inline("terms"))
    wanted = _wanted_terms(index, terms.withColumnRenamed("phrase", "term"), "query-terms")
    frequency = _by_term(index, index.vocabulary, wanted, wanted.df.select("term").distinct()).select(
        F.col("term").alias("phrase"), "df"
    )
    terms = wanted.df.withColumnRenamed("term", "phrase").drop("term_bucket")
    matches = match_all(terms, term_hits(terms, index), index.stats, restrict, frequency)
    best = top_matches(matches, top_k).withColumnRenamed("query_id", "lead")
    every_query = asked.hint(asked.df.select("lead", "query_id"))
    return best.join(every_query, "lead").select(
        "query_id", "chunk_id", "file_id", "bm25", "rank"
    )
