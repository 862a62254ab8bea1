import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import filters, fulltext, hybrid
from docloom.operators.embedding import embed, hash_embed
from docloom.plans.searching import search
from docloom.schemas import FILE_TYPE_SETTINGS, LOCATIONS
from docloom.sources.seeds import file_type_settings

FILES = "file_id long, path string, location_id long, file_type string, mtime double, gist string, status string"


def corpus(spark, rows):
    """rows: (path, location, category, snippets)."""
    files = spark.createDataFrame(
        [(i, path, loc, cat, 1.0, "g", "indexed") for i, (path, loc, cat, _) in enumerate(rows)], FILES
    )
    chunks = spark.createDataFrame(
        [(i * 1000 + n, i, "text", s, '{"paragraph":0}') for i, r in enumerate(rows) for n, s in enumerate(r[3])],
        "chunk_id long, file_id long, chunk_type string, snippet string, position_meta string",
    )
    return files, embed(chunks)


def ask(spark, rows, text, vector_text=None, files=None, chunks=None, **options):
    made_files, made_chunks = corpus(spark, rows)
    files, chunks = files or made_files, chunks or made_chunks
    vector = hash_embed([vector_text], 384)[0].tolist() if vector_text is not None else None
    queries = spark.createDataFrame([(1, text, vector)], "query_id long, text string, embedding array<float>")
    flagged = filters.flag_files(files, **{k: options.pop(k) for k in list(options) if k in ("location_ids", "categories", "settings", "locations")})
    hits = hybrid.hybrid_search(
        queries, chunks, files, fulltext.build_index(chunks),
        restrict=filters.restriction(flagged), **options,
    )
    return hits.orderBy("rank").collect()


ONE = [("/docs/a.md", 1, "text", ["semantic search engine", "vector database", "machine learning"])]


def test_vector_search_finds_the_same_text_first(spark):
    hits = ask(spark, ONE, "", "semantic search engine", top_k=10)
    assert len(hits) == 3 and hits[0].snippet == "semantic search engine"
    assert hits[0].distance < 0.001 and hits[0].score > hits[1].score
    assert all(h.bm25 is None for h in hits)


def test_keyword_search(spark):
    hits = ask(spark, [("/a.md", 1, "text", ["hello world", "goodbye world"])], "hello", "x", top_k=10)
    assert len(hits) == 2 and "hello" in hits[0].snippet


def test_hybrid_ranks_a_double_match_first(spark):
    rows = [("/a.md", 1, "text", ["exact match phrase", "similar concept here", "unrelated content"])]
    hits = ask(spark, rows, "exact match", "exact match phrase", top_k=10)
    assert len(hits) == 3 and hits[0].snippet == "exact match phrase"
    assert hits[0].score == pytest.approx(1.0, abs=1e-6)


TWO = [("/docs/a.md", 1, "text", ["alpha beta"]), ("/other/b.py", 2, "code", ["alpha gamma"])]


@pytest.mark.parametrize("text", ["", "alpha"])
def test_filters_hold_in_both_legs(spark, text):
    def paths(**options):
        return [h.path for h in ask(spark, TWO, text, "alpha", **options)]

    assert sorted(paths()) == ["/docs/a.md", "/other/b.py"]
    assert paths(location_ids=[1]) == ["/docs/a.md"]
    assert paths(categories=["code"]) == ["/other/b.py"]
    assert paths(location_ids=[]) == [] and paths(categories=[]) == []
    assert paths(location_ids=[1], categories=["code"]) == []
    off = spark.createDataFrame([("text", True), ("code", False)], FILE_TYPE_SETTINGS)
    assert paths(settings=off) == ["/docs/a.md"]
    some = spark.createDataFrame([(1, "/docs", False, 0.0), (2, "/other", True, 0.0)], LOCATIONS)
    assert paths(locations=some) == ["/other/b.py"]


def test_only_indexed_files(spark):
    files, _ = corpus(spark, TWO)
    files = files.withColumn("status", F.when(F.col("file_id") == 0, "pending").otherwise("indexed"))
    assert [h.path for h in ask(spark, TWO, "alpha", "alpha", files=files)] == ["/other/b.py"]


def test_chunk_without_vector_is_found_by_words(spark):
    _, chunks = corpus(spark, TWO)
    vector = F.when(F.col("file_id") == 1, F.col("embedding"))
    hits = ask(spark, TWO, "beta", "alpha", chunks=chunks.withColumn("embedding", vector))
    assert {(h.path, h.distance is None, h.bm25 is None) for h in hits} == {
        ("/docs/a.md", True, False), ("/other/b.py", False, True),
    }


def test_keywords_only(spark):
    hits = ask(spark, TWO, "alpha", None)
    assert [h.chunk_id for h in hits] == [0, 1000]
    assert [h.score for h in hits] == [0.4, 0.4]


def test_ties_keep_the_order_of_the_legs(spark):
    v = spark.createDataFrame(
        [(1, c, c, d, r) for c, d, r in [(5, 0.5, 1), (3, 0.5, 2)]],
        "query_id long, chunk_id long, file_id long, distance double, rank int",
    )
    k = spark.createDataFrame(
        [(1, c, c, -1.0, r) for c, r in [(9, 1), (2, 2)]],
        "query_id long, chunk_id long, file_id long, bm25 double, rank int",
    )
    rows = hybrid.fuse(v, k, vector_weight=0.5, keyword_weight=0.375, top_k=3).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [5, 3, 9]
    assert [r.score for r in rows] == [0.375] * 3


def test_search_plan(spark):
    files, chunks = corpus(spark, TWO)
    locations = spark.createDataFrame([(1, "/docs", True, 0.0), (2, "/other", True, 1.0)], LOCATIONS)
    queries = spark.createDataFrame(
        [(1, "alpha beta"), (2, "   "), (3, "what's"), (4, "alpha")], "query_id long, text string"
    )
    hits = search(
        queries, files, chunks, fulltext.build_index(chunks), locations, file_type_settings(spark), top_k=0
    ).collect()
    assert {h.query_id for h in hits} == {1, 3, 4}
    best = next(h for h in hits if h.query_id == 1 and h.rank == 1)
    assert best.path == "/docs/a.md" and best.score == pytest.approx(1.0, abs=1e-6)


def test_chunks_without_stored_vectors(spark, monkeypatch, tmp_path):
    """They are embedded where they are compared, once and behind the restriction: the same hits as with vectors that are kept."""
    rows = [(f"/{i}.md", i, "text", [f"hello number {i}", f"bye {i}", None]) for i in range(6)]
    files, chunks = corpus(spark, rows)
    locations = spark.createDataFrame([(i, f"/{i}", i < 4, 0.0) for i in range(6)], LOCATIONS)
    queries = spark.createDataFrame([(1, "hello number"), (2, "bye 3"), (3, "hello 5")], "query_id long, text string")
    made = spark.sparkContext.accumulator(0)

    def counting(texts, dim):
        made.add(len(texts))
        return hash_embed(texts, dim)

    def hits(given):
        found = search(queries, files, given, fulltext.build_index(given), locations, file_type_settings(spark), embed_fn=counting)
        return sorted(map(str, found.drop("embedder").collect()))

    stored = embed(chunks.drop("embedding", "embedder"), fn=counting)
    bare = spark.createDataFrame(chunks.drop("embedding", "embedder").collect(), chunks.drop("embedding", "embedder").schema)
    want = hits(stored)
    before = made.value
    assert hits(bare) == want and len(want) > 8
    assert made.value - before <= 3 * 4 + 2 * len(queries.collect())


def test_look_ups(spark):
    files, _ = corpus(spark, TWO + [("/docs/0.md", 1, "text", [])])
    assert [r.path for r in filters.files_by_location(files, 1).collect()] == ["/docs/0.md", "/docs/a.md"]
    assert filters.file_by_path(files, "/other/b.py").first().file_id == 1
    assert filters.file_by_id(files, 1).first().path == "/other/b.py"
    assert filters.findable_files(files, location_ids=[2]).first().path == "/other/b.py"
    assert np.isclose(hash_embed(["x"])[0] @ hash_embed(["x"])[0], 1, atol=1e-5)
