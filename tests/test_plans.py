"""Properties of physical plans that keep the operators usable on large tables."""

import re

import pytest
from pyspark.sql import functions as F

import registry
from docloom.operators import chunking, fulltext, nearest
from docloom.operators.maintenance import detect_changes
from registry import inputs, maintenance_queries

FOLDER = "/root/testdata/sf0.001"
SHUFFLE = re.compile(r"\bExchange (hash|range|Single|RoundRobin)")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_query_compares_all_with_all(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def texts(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select(
        F.col("doc_id").alias("file_id"),
        F.lit("/a.md").alias("path"),
        F.lit("text").alias("file_type"),
        F.col("text").alias("content"),
        F.col("n_chars"),
    )


def test_cutting_and_indexing_do_not_shuffle(spark):
    chunks = chunking.explode_chunks(chunking.extract(texts(spark)))
    text = plan(fulltext.postings(chunks))
    assert not SHUFFLE.search(text)
    assert "n_chars" not in text


def test_the_scan_of_documents_joins_nothing(spark):
    for df in (maintenance_queries.scanned(spark, FOLDER), maintenance_queries._pages(spark, FOLDER), inputs.sheets(spark, FOLDER)):
        assert "Join" not in plan(df) and df.count() > 0


def test_postings_leave_in_the_order_of_their_terms(spark):
    chunks = chunking.explode_chunks(chunking.extract(texts(spark))).limit(500).coalesce(1)
    rows = [(r.term.encode(), r.chunk_id) for r in fulltext.postings(chunks).collect()]
    assert len(rows) > 500 and [term for term, _ in rows] == sorted(term for term, _ in rows)


def test_row_number_limits_run_before_the_shuffle(spark):
    pages = texts(spark).select("file_id", F.lit(1).alias("page_no"), F.col("content").alias("page_text"))
    for df in (
        chunking.extract_pages(pages, doc="file_id"),
        fulltext.top_matches(texts(spark).select(F.col("file_id").alias("query_id"), F.lit(1.0).alias("bm25"), F.col("n_chars").alias("chunk_id"))),
    ):
        text = plan(df)
        assert "Partial" in text[text.index("WindowGroupLimit") :]
        assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_a_search_reads_the_folders_of_its_words(spark):
    index = inputs.index(spark, FOLDER).text
    words = spark.createDataFrame([(1, "the")], "query_id long, text string")
    text = plan(fulltext.term_hits(fulltext.query_terms(words), index))
    bucket = index.postings.filter("term = 'the'").select("term_bucket").first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*term_bucket#\d+ = {bucket}\b", text)
    assert not SHUFFLE.search(text)


def test_vectors_are_read_alone_and_not_shuffled(spark):
    corpus = inputs.index(spark, FOLDER)
    asked = corpus.chunks.select(F.col("chunk_id").alias("query_id"), "embedding").limit(2)
    text = plan(nearest.vector_topk(asked, corpus.chunks, 3))
    scan = text[text.index("FileScan") :]
    assert "snippet" not in scan and not SHUFFLE.search(text[text.index("MapInArrow") :])


def test_change_detection_moves_no_contents(spark):
    scan = texts(spark).select(
        F.concat(F.lit("/"), F.col("file_id").cast("string")).alias("path"),
        F.lit(1.0).alias("mtime"),
        F.lit(1).alias("size_bytes"),
        F.sha2("content", 256).alias("content_hash"),
    )
    known = inputs.index(spark, FOLDER).files
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(detect_changes(scan, known).select("path", "state"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    hashed = text.index("sha2(")
    assert text.index("Exchange") < hashed and "content#" not in text[:hashed]
    assert "gist" not in text
