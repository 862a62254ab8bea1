"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import tokens as tk
from docloom.sources.seeds import file_type_settings
from docloom.operators import maintenance
from registry import inputs, sqltext
from registry.base import query

NOW = 700_000.0


@query(
    "truncate_words",
    f"""SELECT doc_id, {sqltext.truncate('text', 150, 'a')} AS snippet,
               {sqltext.truncate('text', 300, 'b')} AS gist FROM documents""",
)
def truncate_words(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "doc_id",
        tx.truncate_words(F.col("text"), 150).alias("snippet"),
        tx.truncate_words(F.col("text"), 300).alias("gist"),
    )


@query(
    "file_category",
    f"WITH {sqltext.FILES} SELECT file_id, path, {sqltext.category('path')} AS category FROM files",
)
def file_category(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "file_id", "path", tx.category_of(F.col("path")).alias("category")
    )


@query(
    "file_language",
    f"WITH {sqltext.FILES} SELECT file_id, path, {sqltext.language('path')} AS language FROM files",
)
def file_language(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "file_id", "path", tx.language_of(F.col("path")).alias("language")
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "doc_id", tx.content_hash(F.col("text").cast("binary")).alias("content_hash")
    )


@query(
    "position_meta",
    """SELECT conv_id, turn, '{"page":' || (turn + 1) || ',"paragraph":' || length(text) || '}' AS meta,
              CAST(turn + 1 AS INTEGER) AS page FROM conversations""",
)
def position_meta(spark, sf_dir):
    meta = tx.position_meta(page=F.col("turn") + 1, paragraph=F.length("text"))
    return inputs.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        meta.alias("meta"),
        tx.position_field(meta, "page").cast("int").alias("page"),
    )


@query(
    "vector_score",
    """SELECT event_id, value / 10 AS distance, greatest(0.0::DOUBLE, 1 - value / 10 / 2) AS score
       FROM events""",
)
def vector_score(spark, sf_dir):
    distance = F.col("value") / 10
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", distance.alias("distance"), tx.vector_score(distance).alias("score")
    )


@query(
    "keyword_score",
    """SELECT event_id, 5 - value AS bm25,
              greatest(0.0::DOUBLE, 1 / (1 + greatest(0.0::DOUBLE, 5 - value))) AS score
       FROM events""",
)
def keyword_score(spark, sf_dir):
    bm25 = 5 - F.col("value")
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", bm25.alias("bm25"), tx.keyword_score(bm25).alias("score")
    )


HIGHLIGHT = "la de a mark"


@query(
    "highlight_hits",
    """SELECT doc_id,
              regexp_replace(regexp_replace(regexp_replace(text,
                '(la)', '<mark>\\1</mark>', 'gi'), '(de)', '<mark>\\1</mark>', 'gi'),
                '(mark)', '<mark>\\1</mark>', 'gi') AS highlighted,
              printf('%.0f%%', length(text)::DOUBLE) AS percent
       FROM documents""",
)
def highlight_hits(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "doc_id",
        tx.highlight(F.col("text"), F.lit(HIGHLIGHT)).alias("highlighted"),
        tx.percent_score(F.length("text") / 100).alias("percent"),
    )


@query(
    "relative_age",
    f"""WITH aged AS (SELECT event_id, event_id * 70.0::DOUBLE AS mtime,
                            {NOW}::DOUBLE - event_id * 70.0::DOUBLE AS age FROM events)
        SELECT event_id, CASE
          WHEN age < 60 THEN 'just now'
          WHEN age < 3600 THEN CAST(floor(age / 60) AS BIGINT) || 'm ago'
          WHEN age < 86400 THEN CAST(floor(age / 3600) AS BIGINT) || 'h ago'
          WHEN age < 604800 THEN CAST(floor(age / 86400) AS BIGINT) || 'd ago'
          ELSE strftime(make_timestamp(CAST(mtime * 1000000 AS BIGINT)), '%Y-%m-%d') END AS age
        FROM aged""",
)
def relative_age(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", tx.relative_age(F.col("event_id") * 70.0, F.lit(NOW)).alias("age")
    )


@query(
    "tokenize",
    f"SELECT doc_id, array_to_string({sqltext.tokens('text')}, ' ') AS tokens FROM documents",
)
def tokenize(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(
        "doc_id", F.array_join(tk.tokenize(F.col("text")), " ").alias("tokens")
    )


@query(
    "category_status",
    f"""WITH {sqltext.FILES},
             settings AS (SELECT unnest(['text','code','pdf','office','image','video']) AS category,
                                 unnest([true,true,true,false,false,false]) AS enabled)
        SELECT category, enabled, category IN ('text','code','pdf') AS supported,
               (SELECT count(*) FROM files WHERE file_type = category) AS n_files
        FROM settings ORDER BY category""",
)
def category_status(spark, sf_dir):
    return maintenance.category_status(file_type_settings(spark), inputs.files(spark, sf_dir))
