"""The given tables seen as files, paragraphs, chunks and queries of a document index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking, fulltext
from docloom.sources.sizes import spread, written
from registry.sqltext import EXTENSIONS

_CORPORA: dict[tuple[str, str], Corpus] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _path() -> F.Column:
    extension = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int"))
    return F.concat(
        F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), extension
    )


def files(spark: SparkSession, sf_dir: str, *more: F.Column) -> DataFrame:
    """A file per document; every source is a location. With further columns of its row, so that texts need no join."""
    last_digit = F.col("doc_id") % 10
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"),
        _path().alias("path"),
        F.substring("source", 4, 10).cast("long").alias("location_id"),
        tx.category_of(_path()).alias("file_type"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        (F.lit(1000.0) + F.col("doc_id")).alias("mtime"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.when(last_digit == 7, "pending")
        .when(last_digit == 8, "error")
        .when(last_digit == 9, "skipped")
        .otherwise("indexed")
        .alias("status"),
        *more,
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain texts whose lines are separated by blank lines."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("file_type"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source code whose lines each start a definition."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.lit("code").alias("file_type"),
        F.concat(
            F.lit("import x\n\ndef "), F.replace("text", F.lit("\n"), F.lit("\n\ndef "))
        ).alias("content"),
    )


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents, a turn being a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("page_text"),
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paged files among the documents, a line being a page."""
    return sheets_by(spark, sf_dir, "file_id")


def sheets_by(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The same by another column of the files."""
    paged_files = files(spark, sf_dir, F.col("text")).filter(F.col("file_type") == "pdf")
    lines = paged_files.select(key, F.posexplode(F.split("text", "\n")).alias("i", "page_text"))
    return lines.select(key, (F.col("i") + 1).alias("page_no"), "page_text")


def cut_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs of all documents as chunks."""
    return chunking.explode_chunks(chunking.extract(paragraphs(spark, sf_dir)))


@dataclass(frozen=True)
class Corpus:
    """A written index."""

    chunks: DataFrame
    files: DataFrame
    text: fulltext.Index


def index(spark: SparkSession, sf_dir: str) -> Corpus:
    """The whole index, written: chunks (with the vector whose number is that of the document plus the chunk's, counted
    round; some have none), files, postings, vocabulary and statistics. Once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        round_ = table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).scalar()
        cut = cut_chunks(spark, sf_dir)
        numbered = cut.withColumn("vec_id", (F.col("file_id") + F.col("ord")) % round_)
        chunks = written(
            numbered.join(vectors, "vec_id", "left").select(*cut.columns, "embedding"), "chunks"
        )
        known = _CORPORA.get((spark.sparkContext.applicationId, f"{sf_dir}/texts"))
        _CORPORA[key] = _indexed(spark, sf_dir, chunks) if known is None else replace(known, chunks=chunks)
    return _CORPORA[key]


def _indexed(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> Corpus:
    return Corpus(
        chunks, written(files(spark, sf_dir).withColumn("gist", F.lit("")), "files"), fulltext.written_index(chunks)
    )


def texts(spark: SparkSession, sf_dir: str) -> Corpus:
    """The same index with chunks that have no vectors, for searches that embed them. Once per session and folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/texts")
    if key not in _CORPORA:
        plain = _CORPORA.get((spark.sparkContext.applicationId, sf_dir))
        _CORPORA[key] = (
            _indexed(spark, sf_dir, written(cut_chunks(spark, sf_dir), "chunks", compression="zstd"))
            if plain is None
            else replace(plain, chunks=plain.chunks.drop("embedding"))
        )
    return _CORPORA[key]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every clause of every benchmark item."""
    return (
        table(spark, sf_dir, "benchmark")
        .select("item_id", F.posexplode(F.split("text", r"[.,\n]+")).alias("pos", "text"))
        .select(
            (F.col("item_id") * 1000 + F.col("pos")).alias("query_id"),
            tx.strip(F.col("text")).alias("text"),
        )
        .filter(F.col("text") != "")
    )


SEGMENTS = """
split_items AS (
  SELECT item_id, string_split_regex(text, '[.,\\n]+') AS parts FROM benchmark),
segments AS (
  SELECT item_id * 1000 + generate_subscripts(parts, 1) - 1 AS query_id,
         trim(unnest(parts)) AS text
  FROM split_items),
queries AS (SELECT * FROM segments WHERE text <> '')"""
