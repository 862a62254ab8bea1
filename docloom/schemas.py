"""Table schemas of the index and the defaults shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Size limits, ranking defaults and the embedding dimension.
SNIPPET_CHARS = 150
GIST_CHARS = 300
TEXT_CHUNK_CAP = 150
PAGE_CHUNK_CAP = 200
FIXED_CHUNK_CHARS = 1000
VECTOR_WEIGHT = 0.6
KEYWORD_WEIGHT = 0.4
TOP_K = 50
EMBED_DIM = 384

# chunk_id = file_id * CHUNK_ID_STRIDE + ord: room for 16 million chunks of each of 500 billion files. A registered
# chunker that gives a file more is an error, never a collision.
CHUNK_ID_STRIDE = 1 << 24

STATUSES = ("pending", "indexed", "skipped", "error")

CHUNK_STRUCT = T.StructType(
    [
        T.StructField("chunk_type", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("position_meta", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("location_id", T.LongType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("gist", T.StringType()),
        T.StructField("indexed_at", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("position_meta", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedder", T.StringType()),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("chunk_len", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("tf", T.IntegerType()),
    ]
)

LOCATIONS = T.StructType(
    [
        T.StructField("location_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("added_at", T.DoubleType()),
    ]
)

FILE_TYPE_SETTINGS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

CHANGE_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dest_path", T.StringType()),
        T.StructField("is_directory", T.BooleanType()),
    ]
)
