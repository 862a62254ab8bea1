"""Size checks that decide between a broadcast and a shuffle, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a few short columns: at most some tens of megabytes on every executor.
MAX_BROADCAST_ROWS = 200_000


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; never counts further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcasting when its size has been checked, else leave the join to Spark."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for an input of only a few splits; an input of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the executors would
    each see another one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that it is computed once; texts are smaller by the
    ``compression`` zstd than by the session's own."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # With its schema, since a table in folders that has no rows has no file either.
    order = [c for c in df.columns if c not in partition_by] + list(partition_by)
    return df.sparkSession.read.schema(df.select(*order).schema if partition_by else df.schema).parquet(path)


@dataclass(frozen=True)
class Settled:
    """A table computed once: local rows when it is small, else written to the shared folder."""

    df: DataFrame
    small: bool
    rows: pa.Table | None

    def hint(self, other: DataFrame) -> DataFrame:
        """A broadcast hint for a table known to have no more rows than this one, if small."""
        return F.broadcast(other) if self.small else other

    def bound(self, column: str) -> float:
        """Sum of a column of row counts, if small; else unbounded."""
        return sum(self.rows[column].to_pylist()) if self.small else float("inf")

    def most(self, column: str) -> float:
        """Largest value of a column, if small; else unbounded."""
        return max(self.rows[column].to_pylist(), default=0) if self.small else float("inf")

    def distinct(self, column: str) -> list | None:
        """Distinct values of a column, if small."""
        return sorted(set(self.rows[column].to_pylist())) if self.small else None


def settled(df: DataFrame, name: str, max_rows: int = MAX_BROADCAST_ROWS) -> Settled:
    """Compute ``df`` once, reading no more than ``max_rows`` (and one) rows to find its size."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return Settled(written(df, name), False, None)
    return Settled(df.sparkSession.createDataFrame(rows, df.schema), True, rows)
