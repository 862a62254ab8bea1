"""The change feed: user events as events about files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.plans.indexing import index_batch
from docloom.operators import maintenance
from docloom.sources.index_tables import IndexTables
from docloom.sources.seeds import file_type_settings
from docloom.sources.sizes import broadcast_if_small, shared_folder
from docloom.streaming import changes, pending
from registry import inputs, sqltext
from registry.base import query
from registry.search_queries import locations


def _as_changes(events):
    kind = F.col("event_type")
    path = F.concat(F.lit("/u/"), F.col("user_id").cast("string"))
    return events.select(
        "event_id",
        "ts",
        F.when(kind == "signup", "created")
        .when(kind == "click", "modified")
        .when(kind == "purchase", "moved")
        .when(kind == "error", "deleted")
        .otherwise("created")
        .alias("action"),
        F.concat(path, F.lit(".md")).alias("path"),
        F.when(kind == "purchase", F.concat(path, F.lit(".py"))).alias("dest_path"),
        (kind == "view").alias("is_directory"),
    )


def change_feed(spark, sf_dir):
    return _as_changes(inputs.table(spark, sf_dir, "events"))


#: Micro-batches at least, and the events that one is meant to hold.
BATCHES = 3
BATCH_EVENTS = 1_000_000


def event_parts(spark, sf_dir, at_least=BATCHES):
    """The events and how to tell the part of one: consecutive ranges of ids, as many as the events ask for; those without an id come first."""
    events = inputs.table(spark, sf_dir, "events")
    low, high, n = events.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    parts = max(at_least, -(-n // BATCH_EVENTS))
    step = ((high or 0) - (low or 0)) // parts + 1
    part = F.coalesce(F.floor((F.col("event_id") - F.lit(low or 0)) / step), F.lit(0))
    return events, part, parts


def change_streams(spark, sf_dir, folder, at_least=BATCHES):
    """The events as a stream that grows: each part is written, by as many tasks as it takes, and what is yielded then finds it."""
    events, part, parts = event_parts(spark, sf_dir, at_least)
    for i in range(parts):
        events.filter(part == i).write.parquet(f"{folder}/events/part={i}")
        yield _as_changes(spark.readStream.schema(events.schema).parquet(f"{folder}/events/*"))


JOBS = """
jobs AS (
  SELECT event_id, ts, '/u/' || user_id || CASE event_type WHEN 'purchase' THEN '.py' ELSE '.md' END AS path,
         CASE event_type WHEN 'purchase' THEN 'code' ELSE 'text' END AS file_type,
         CAST(CASE event_type WHEN 'click' THEN 2 ELSE 1 END AS INTEGER) AS priority
  FROM events WHERE event_type IN ('signup', 'click', 'purchase'))"""

_FIRST = """
first_jobs AS (
  SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY path ORDER BY event_id) = 1)"""


def _jobs(spark, sf_dir):
    return changes.change_jobs(change_feed(spark, sf_dir), file_type_settings(spark))


@query("change_events", f"WITH {JOBS} SELECT event_id, ts, path, file_type, priority FROM jobs")
def change_events(spark, sf_dir):
    return _jobs(spark, sf_dir)


@query(
    "change_coalesce",
    f"WITH {JOBS}, {_FIRST} SELECT event_id, path, file_type, priority FROM first_jobs",
)
def change_coalesce(spark, sf_dir):
    """Run as a stream of several micro-batches: a path that has a pending job gets no other."""
    folder = f"{shared_folder(spark)}/coalesce-{uuid.uuid4().hex}"
    for feed in change_streams(spark, sf_dir, folder):
        jobs = changes.change_jobs(feed, file_type_settings(spark))
        changes.stream_pending(jobs, f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    pending = changes.pending_jobs(spark, f"{folder}/jobs")
    return pending.select("event_id", "path", "file_type", "priority")


STATE_BATCHES = 6


@query(
    "change_coalesce_state",
    f"""WITH {JOBS},
        span AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // {STATE_BATCHES} + 1 AS step FROM events),
        parts AS (SELECT event_id, '/u/' || user_id || '.md' AS gone, event_type, (event_id - low) // step AS part FROM events, span),
        done AS (SELECT DISTINCT gone AS path, part FROM parts WHERE event_type = 'error'),
        turns AS (
          SELECT jobs.*, (SELECT count(*) FROM done d WHERE d.path = jobs.path AND d.part <= p.part) AS turn
          FROM jobs JOIN parts p USING (event_id))
        SELECT event_id, ts, path, file_type, priority FROM turns
        QUALIFY row_number() OVER (PARTITION BY path, turn ORDER BY event_id) = 1""",
)
def change_coalesce_state(spark, sf_dir):
    """Several micro-batches, each a restart from the checkpoint; a deleted file's job is finished with the micro-batch that says so."""
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    for feed in change_streams(spark, sf_dir, folder, STATE_BATCHES):
        jobs = changes.change_jobs(feed, file_type_settings(spark))
        done = feed.filter("action = 'deleted'").select("path")
        first = pending.coalesce_state(jobs, done)
        pending.write_pending(first, f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    return pending.read_pending(spark, f"{folder}/jobs", jobs.schema["ts"].dataType.simpleString())


@query(
    "change_order",
    f"""WITH {JOBS}, {_FIRST}
        SELECT event_id, path, priority FROM first_jobs ORDER BY priority DESC, ts, event_id""",
)
def change_order(spark, sf_dir):
    jobs = changes.coalesce_jobs(_jobs(spark, sf_dir))
    return changes.job_order(jobs).select("event_id", "path", "priority")


@query(
    "change_batch",
    f"""WITH {JOBS}, {_FIRST}
        SELECT event_id, path, priority FROM first_jobs ORDER BY priority DESC, ts, event_id LIMIT 24""",
)
def change_batch(spark, sf_dir):
    """The next bounded batch of jobs."""
    jobs = changes.coalesce_jobs(_jobs(spark, sf_dir))
    return changes.first_jobs(jobs, 24).select("event_id", "path", "priority")


@query(
    "change_stats",
    f"""WITH {JOBS},
        states AS (
          SELECT CASE WHEN value > 30 THEN 'failed' WHEN value > 15 THEN 'done'
                      WHEN value > 10 THEN 'running' ELSE 'pending' END AS state
          FROM jobs JOIN events USING (event_id))
        SELECT count(*) AS enqueued, count(*) FILTER (state = 'pending') AS pending,
               count(*) FILTER (state = 'running') AS in_flight,
               count(*) FILTER (state = 'done') AS completed,
               count(*) FILTER (state = 'failed') AS failed,
               count(*) FILTER (state = 'pending') AS depth
        FROM states""",
)
def change_stats(spark, sf_dir):
    value = F.col("value")
    state = F.when(value > 30, "failed").when(value > 15, "done").when(value > 10, "running")
    outcomes = (
        inputs.table(spark, sf_dir, "events")
        .select("event_id", state.alias("state"))
        .filter(F.col("state").isNotNull())
    )
    return changes.change_stats(_jobs(spark, sf_dir), outcomes)


@query(
    "retry_errors",
    f"""WITH {sqltext.FILES} SELECT file_id, path, file_type, CAST(2 AS INTEGER) AS priority
        FROM files WHERE status = 'error'""",
)
def retry_errors(spark, sf_dir):
    return changes.retry_jobs(inputs.files(spark, sf_dir))


@query(
    "stream_apply",
    f"""WITH {sqltext.chunks()},
        counted AS (SELECT file_id, count(*) AS n_chunks FROM chunks GROUP BY file_id),
        users AS (
          SELECT doc_id, '/u/' || doc_id || '.md' AS path,
                 row_number() OVER (ORDER BY substr(md5('/u/' || doc_id || '.md'), 1, 3),
                                             '/u/' || doc_id || '.md') AS new_id
          FROM documents)
        SELECT new_id AS file_id, path, 'indexed' AS status, coalesce(n_chunks, 0) AS n_chunks
        FROM users LEFT JOIN counted ON file_id = doc_id
        WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
                   AND doc_id IN (SELECT user_id FROM events WHERE event_type <> 'view'))""",
)
def stream_apply(spark, sf_dir):
    """All documents are indexed; then the toxic ones disappear, which the index learns of only
    where an event mentions them."""
    home, where = file_type_settings(spark), locations(spark, sf_dir)
    present = inputs.documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("/u/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(0.0).alias("mtime"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).cast("binary").alias("content"),
    )
    toxic = inputs.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    # A short list is sent to the documents, whose contents are then not moved for each micro-batch.
    left = present.join(broadcast_if_small(toxic), "doc_id", "left_anti").drop("doc_id")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    tables = IndexTables(spark, f"{folder}/index", 8, 4)
    tables.create()
    tables.apply(index_batch(present.drop("doc_id"), tables.files(), where, home, now=0.0))
    for feed in change_streams(spark, sf_dir, folder):
        changes.stream_apply(
            feed, tables, lambda: left, where, home, f"{folder}/checkpoint", now=lambda: 1.0
        ).awaitTermination()
    counts = maintenance.chunk_counts(tables.chunks())
    return (
        tables.files()
        .join(counts, "file_id", "left")
        .select(
            "file_id", "path", "status",
            F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"),
        )
    )
