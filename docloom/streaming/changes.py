"""Change events: classifying, coalescing, ordering and counting them, and applying a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import category_of
from docloom.operators.maintenance import HIGH, NORMAL, retry_jobs  # noqa: F401
from docloom.plans.indexing import index_batch
from docloom.sources.index_tables import IndexTables
from docloom.sources.sizes import broadcast_if_small, written

PENDING = "event_id long, ts timestamp, path string, file_type string, priority int, batch long"
PRIORITY_OF_ACTION = {"created": NORMAL, "modified": HIGH, "moved": NORMAL}


def change_jobs(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Events (event_id, ts, action, path, dest_path, is_directory) to jobs, on tables and streams.

    A move is a job for its destination; deletions, directories and files of a disabled or unknown
    category give none.
    """
    target = F.when(F.col("action") == "moved", F.col("dest_path")).otherwise(F.col("path"))
    priority = F.when(F.lit(False), F.lit(None).cast("int"))
    for action, level in PRIORITY_OF_ACTION.items():
        priority = priority.when(F.col("action") == action, level)
    enabled = F.broadcast(settings.filter("enabled").select(F.col("category").alias("file_type")))
    return (
        events.filter(~F.col("is_directory"))
        .select("event_id", "ts", target.alias("path"), priority.alias("priority"))
        .filter(F.col("priority").isNotNull())
        .withColumn("file_type", category_of(F.col("path")))
        .join(enabled, "file_type", "left_semi")
        .select("event_id", "ts", "path", "file_type", "priority")
    )


def gone_paths(events: DataFrame) -> DataFrame:
    """Paths that events say are no longer there: deleted ones and the sources of moves."""
    leaving = F.col("action").isin("deleted", "moved")
    return events.filter(leaving & ~F.col("is_directory")).select("path").distinct()


def coalesce_jobs(jobs: DataFrame) -> DataFrame:
    """One job per path: the first pending one wins, whatever the priority of later ones.

    The minimum is taken in every task before the shuffle, so a path with a third of all events
    sends one row per task.
    """
    first = F.min_by(F.struct("ts", "file_type", "priority"), "event_id")
    return (
        jobs.groupBy("path")
        .agg(F.min("event_id").alias("event_id"), first.alias("_job"))
        .select("event_id", "_job.ts", "path", "_job.file_type", "_job.priority")
    )


def coalesce_stream(jobs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream: a path that had a job within ``delay`` gives no other."""
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path"])


def pending_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs that ``stream_pending`` has written, one for each path; none before its first batch."""
    return spark.read.schema(PENDING).option("ignoreMissingFiles", True).parquet(folder)


def stream_pending(jobs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of jobs below ``folder``, coalesced across micro-batches: a path that has a
    pending job, of this batch or an earlier one, gets no other. A batch that is run again after a failure replaces its own rows."""
    spark = jobs.sparkSession
    spark.createDataFrame([], PENDING).drop("batch").write.mode("append").parquet(f"{folder}/batch=-1")

    def append(batch: DataFrame, batch_id: int) -> None:
        earlier = pending_jobs(spark, folder).filter(F.col("batch") < batch_id).select("path")
        fresh = coalesce_jobs(batch).join(earlier, "path", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        jobs.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def job_order(jobs: DataFrame) -> DataFrame:
    """Jobs by priority, highest first, then by age."""
    return jobs.orderBy(F.col("priority").desc(), "ts", "event_id")


def first_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The next ``n`` jobs: a bounded batch."""
    return job_order(jobs).limit(n)


def change_stats(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of counters from jobs (event_id) and their outcomes (event_id, state).

    ``state`` is running, done or failed; a job without an outcome is pending. ``depth`` counts
    what is waiting, whether or not another job is running.
    """
    state = F.coalesce(F.col("state"), F.lit("pending"))
    counted = jobs.select("event_id").join(outcomes, "event_id", "left").select(state.alias("state"))
    return counted.agg(
        F.count(F.lit(1)).alias("enqueued"),
        *[
            F.count_if(F.col("state") == name).alias(alias)
            for name, alias in (
                ("pending", "pending"),
                ("running", "in_flight"),
                ("done", "completed"),
                ("failed", "failed"),
            )
        ],
    ).withColumn("depth", F.col("pending"))


def apply_events(
    events: DataFrame,
    tables: IndexTables,
    snapshot: DataFrame,
    locations: DataFrame,
    settings: DataFrame,
    *,
    now: float,
    **options,
) -> None:
    """Apply one batch of events to the index, given the present files (a scan).

    What an event says about a path only marks it: whether the file is there, and with what
    contents, is read from the snapshot. So applying a batch twice, or late, does no harm.
    """
    jobs = coalesce_jobs(change_jobs(events, settings)).select("path")
    touched = written(jobs.unionByName(gone_paths(events)).distinct(), "touched-paths")
    marked = broadcast_if_small(touched)
    files = tables.files()
    present = snapshot.join(marked, "path", "left_semi")
    batch = index_batch(present, files, locations, settings, now=now, **options)
    known = files.select("file_id", "path").join(marked, "path", "left_semi")
    removed = written(
        known.join(present.select("path"), "path", "left_anti").select("file_id"), "removed-files"
    )
    tables.apply(batch, removed)


def stream_apply(
    events: DataFrame,
    tables: IndexTables,
    snapshot: Callable[[], DataFrame],
    locations: DataFrame,
    settings: DataFrame,
    checkpoint: str,
    *,
    now: Callable[[], float],
    **options,
) -> StreamingQuery:
    """Apply a stream of events to the index, micro-batch by micro-batch, until it is drained.

    The source bounds a batch (``maxFilesPerTrigger``). A batch that is run again after a failure
    finds the index as it left it and gets the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_events(batch, tables, snapshot(), locations, settings, now=now(), **options)

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
