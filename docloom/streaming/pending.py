"""Pending jobs as keyed state: the first event of a path makes a job, and until that job is done the path gets no other.

The state of a path is one number, kept by Spark's state store next to the task that sees the path's events. A micro-batch looks at the
paths it mentions and at nothing else, so its cost does not follow the history; after a failure Spark takes up the state
of the last checkpoint. Paths are handled by shard, since a call of the processor costs far more than a path's rows; a shard's state is a map,
of which a path reads and writes its own entry only. The processor reads a shard's rows as they come and holds one of each path of the micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

if TYPE_CHECKING:
    import pandas as pd

#: Keyed state of this kind needs the store on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"

_JOB = "event_id long, ts string, file_type string, priority int"
#: Order of events without an id: before all others.
FIRST = -(1 << 63)
#: Shards of paths. They belong to the state: a checkpoint is read with the number it was written with.
SHARDS = 4096


class FirstPending(StatefulProcessor):
    """Of a shard's rows (path, place, finished, job) of a micro-batch: what is done is cleared first; then the first job of each path, if none is pending."""

    def init(self, handle) -> None:
        self.pending = handle.getMapState("pending", "path string", "since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        least, done = {}, set()
        for part in rows:
            for path, place, finished, job in zip(*(part[c].tolist() for c in ("path", "place", "finished", "job")), strict=True):
                if finished:
                    done.add(path)
                # Equal orders: the least text, so that a batch that is run again gives the same.
                elif path not in least or (place, job) < least[path]:
                    least[path] = (place, job)
        for path in done:
            if path not in least and self.pending.containsKey((path,)):
                self.pending.removeKey((path,))
        jobs = {}
        for path, (place, job) in least.items():
            if path in done or not self.pending.containsKey((path,)):
                self.pending.updateValue((path,), (place,))
                jobs[path] = job
        if jobs:
            yield pd.DataFrame({"path": list(jobs), "job": list(jobs.values())})

    def close(self) -> None:
        pass


def coalesce_state(jobs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """A stream of jobs (event_id, ts, path, file_type, priority), coalesced by path across micro-batches.

    ``done`` is a stream of paths whose job is finished; what it says counts before the jobs of the same micro-batch. Events without a path
    give no job; those without an id come before all others."""
    detail = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "file_type", "priority"))
    marks = jobs.select(
        "path", F.coalesce("event_id", F.lit(FIRST)).alias("place"), F.lit(False).alias("finished"), detail.alias("job")
    )
    if done is not None:
        marks = marks.unionByName(
            done.select("path", F.lit(FIRST).alias("place"), F.lit(True).alias("finished"), F.lit("").alias("job"))
        )
    shard = F.pmod(F.xxhash64("path"), F.lit(SHARDS)).cast("int")
    first = marks.filter("path IS NOT NULL").withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(
        FirstPending(), "path string, job string", "Append", "None"
    )
    job = F.from_json("job", _JOB)
    return first.select("path", job.alias("_j")).select(
        "_j.event_id", F.col("_j.ts").cast(jobs.schema["ts"].dataType).alias("ts"), "path", "_j.file_type", "_j.priority"
    )


def write_pending(jobs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's jobs to ``folder`` until what has arrived is drained."""
    spark = jobs.sparkSession
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, STORE)
    try:  # a query keeps the settings it was started with
        return (
            jobs.writeStream.format("parquet").outputMode("append").option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STORE_KEY, before)


def read_pending(spark: SparkSession, folder: str, ts: str = "timestamp") -> DataFrame:
    return spark.read.schema(f"event_id long, ts {ts}, path string, file_type string, priority int").parquet(folder)
