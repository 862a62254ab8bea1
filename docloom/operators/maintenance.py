"""Keeping the index tables up to date: change detection, upserts, cascades, statistics.

Tables are DataFrames; every function returns the table after the change. Keys (path, file_id) are
unique, so none of the joins on them has a hot key; joins on a location or category go to a small
broadcast side instead of being shuffled by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import CATEGORIES, is_supported
from docloom.operators.prefixes import path_key, prefix_pairs
from docloom.sources.sizes import broadcast_if_small

# New ids are counted within this many groups of keys, by the first hex digits of their MD5.
ID_GROUP_DIGITS = 3

# Priorities of jobs.
LOW, NORMAL, HIGH = 0, 1, 2

# A file counts as untouched when its time moved by less than this.
MTIME_TOLERANCE = 1.0


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``gone``; columns keep their order."""
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


def detect_changes(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Compare a scan (path, mtime, size_bytes, content_hash) with the known files.

    Adds ``file_id`` (NULL for a new file) and ``state``: new, changed, unchanged, or unfinished
    for a file that did not change but never got as far as being indexed. The join carries
    metadata only; contents stay behind.
    """
    known = files.select(
        "path",
        "file_id",
        F.col("content_hash").alias("_hash"),
        F.col("mtime").alias("_mtime"),
        F.col("status").alias("_status"),
    )
    same = (F.col("content_hash") == F.col("_hash")) & (
        F.abs(F.col("mtime") - F.col("_mtime")) < MTIME_TOLERANCE
    )
    state = (
        F.when(F.col("file_id").isNull(), "new")
        .when(~same, "changed")
        .when(F.col("_status") != "indexed", "unfinished")
        .otherwise("unchanged")
    )
    return (
        scan.join(known, "path", "left")
        .withColumn("state", state)
        .drop("_hash", "_mtime", "_status")
    )


def path_ancestors(path: Column) -> Column:
    """The path itself and every folder above it, without trailing slashes; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def _roots(locations: DataFrame) -> DataFrame:
    return locations.select(
        F.regexp_replace("path", r"/+\z", "").alias("_root"), F.col("location_id")
    )


# Up to so many locations are looked up in the row itself.
MAX_LOCATIONS_IN_ROW = 200


def assign_location(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """Add the ``location_id`` of the innermost location a path lies under; NULL if none.

    A few locations are a map in the row, looked up for each of the path's own ancestors. More are joined in path order: one pass with a stack of
    the locations that are open, so that no path is multiplied by its depth and a location with a third of all files is no hot key.
    """
    few = _roots(locations).limit(MAX_LOCATIONS_IN_ROW + 1).collect()
    if len(few) <= MAX_LOCATIONS_IN_ROW:
        return paths.drop("location_id").withColumn("location_id", _innermost(few))
    return assign_in_order(paths, locations)


def assign_in_order(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """``assign_location`` for any number of locations."""
    roots = _roots(locations).select(F.col("location_id").alias("_key"), path_key(F.col("_root")).alias("_string"))
    strings = paths.select("path").distinct().select(F.col("path").alias("_key"), path_key(F.col("path")).alias("_string"))
    found = prefix_pairs(strings, roots, innermost=True).select(F.col("_key").alias("path"), F.col("_prefix").alias("location_id"))
    return paths.drop("location_id").join(found, "path", "left")


def _innermost(roots: list) -> Column:
    """The id of the longest of the given roots that is an ancestor of the column ``path``."""
    if not roots:
        return F.lit(None).cast("long")
    roots = {root["_root"]: root for root in roots}.values()  # a map has a key once
    pairs = [(F.lit(root["_root"]), F.lit(root["location_id"]).cast("long")) for root in roots]
    known = F.create_map(*[column for pair in pairs for column in pair])
    ids = F.transform(path_ancestors(F.col("path")), lambda folder: F.try_element_at(known, folder))
    return F.try_element_at(F.filter(ids, lambda i: i.isNotNull()), F.lit(-1))


def paths_in_scope(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """Paths under an enabled location."""
    inside = assign_location(paths.select("path").distinct(), locations.filter("enabled"))
    inside = inside.filter(F.col("location_id").isNotNull()).select("path")
    return paths.join(inside, "path", "left_semi")


def latest_per_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the highest version; reduced in every task before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*others), version).alias("_row"))
        .select(key, "_row.*")
        .select(*rows.columns)
    )


def assign_ids(rows: DataFrame, key: str, id_col: str, start: Column) -> DataFrame:
    """Consecutive ids from ``start`` on, in the order of (MD5 prefix, key).

    Ids depend on the keys alone, so a task that is run again gives the same ones. Rows are
    counted within groups of the prefix and the groups' counts (4096 at most) are summed up; no
    task sees all rows.
    """
    prefix = F.substring(F.md5(F.col(key).cast("binary")), 1, ID_GROUP_DIGITS)
    grouped = rows.withColumn("_group", prefix)
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        grouped.groupBy("_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy("_group").orderBy(key))
    return (
        grouped.withColumn("_place", place)
        .join(F.broadcast(offsets), "_group")
        .withColumn(id_col, (start + F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_group", "_place", "_offset")
    )


def with_ids(rows: DataFrame, base: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows with the id their key has in ``base``; keys not there get new ones above its highest."""
    ids = base.select(key, id_col)
    found = rows.drop(id_col).join(ids, key, "left")
    highest = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("id")).scalar()
    fresh = assign_ids(found.filter(F.col(id_col).isNull()).drop(id_col), key, id_col, highest)
    return found.filter(F.col(id_col).isNotNull()).unionByName(fresh)


def upsert_by_key(
    base: DataFrame, changes: DataFrame, key: str, id_col: str, version: str
) -> DataFrame:
    """Insert or replace rows by a unique key; the last version wins and an old row keeps its id."""
    latest = with_ids(latest_per_key(changes, key, version), base, key, id_col)
    kept = without(base, latest, key)
    return kept.unionByName(latest.select(*base.columns))


def add_locations(locations: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Add locations (path, enabled); a path that is one already stays as it is."""
    fresh = new.select("path", "enabled").dropDuplicates(["path"])
    fresh = fresh.join(locations.select("path"), "path", "left_anti")
    rows = with_ids(fresh, locations, "path", "location_id").withColumn("added_at", F.lit(now))
    return locations.unionByName(rows.select(*locations.columns))


def list_locations(locations: DataFrame) -> DataFrame:
    return locations.orderBy("added_at", "location_id")


def replace_by_owner(
    base: DataFrame, new: DataFrame, owners: DataFrame, owner: str = "file_id"
) -> DataFrame:
    """Drop the rows of the given owners and add the new ones.

    The owners are those of a batch: their list is broadcast when it is small, so that the table,
    which holds the vectors, is not shuffled.
    """
    gone = broadcast_if_small(owners.select(owner).distinct())
    return without(base, gone, owner).unionByName(new, allowMissingColumns=True)


def remove_location(
    files: DataFrame, chunks: DataFrame, locations: DataFrame, location_ids: list[int]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove locations with their files and the files' chunks."""
    leaving = F.col("location_id").isin(*location_ids) if location_ids else F.lit(False)
    leaving = F.coalesce(leaving, F.lit(False))
    gone = broadcast_if_small(files.filter(leaving).select("file_id"))
    return (
        files.filter(~leaving),
        without(chunks, gone, "file_id"),
        locations.filter(~leaving),
    )


def missing_paths(files: DataFrame, scan: DataFrame, locations: DataFrame) -> DataFrame:
    """Paths of known files that should have been found and were not.

    A scan covers the enabled locations: what lies elsewhere was not looked for and is not missing. Nor is what lies below
    a folder that could not be listed, which a scan reports as a row with an ``error``."""
    unseen = files.select("path").join(scan.select("path"), "path", "left_anti")
    missing = paths_in_scope(unseen, locations)
    if "error" not in scan.columns:
        return missing
    closed = broadcast_if_small(scan.filter("error IS NOT NULL").select(F.col("path").alias("_folder")).distinct())
    below = missing.select("path", F.explode(path_ancestors(F.col("path"))).alias("_folder")).join(closed, "_folder", "left_semi")
    return missing.join(below.select("path").distinct(), "path", "left_anti")


def purge_missing(
    files: DataFrame, chunks: DataFrame, scan: DataFrame, locations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove files that a scan of the enabled locations no longer finds, with their chunks."""
    return remove_paths(files, chunks, missing_paths(files, scan, locations))


def remove_paths(
    files: DataFrame, chunks: DataFrame, paths: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove the files with the given paths, with their chunks."""
    gone = broadcast_if_small(files.join(paths.select("path"), "path", "left_semi").select("file_id"))
    return without(files, gone, "file_id"), without(chunks, gone, "file_id")


def set_attribute(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Replace one column's value where ``updates`` (key, column) has a row."""
    new = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    return (
        table.join(broadcast_if_small(new), key, "left")
        .withColumn(column, value)
        .select(*table.columns)
    )


def index_status(exists: Column, category: Column, error: Column) -> Column:
    """What a processed file ends as: skipped, error or indexed."""
    skipped = ~exists | ~F.coalesce(is_supported(category), F.lit(False))
    return (
        F.when(skipped, "skipped").when(error.isNotNull(), "error").otherwise("indexed")
    )


def retry_jobs(files: DataFrame) -> DataFrame:
    """Jobs at high priority for the files whose indexing failed."""
    return files.filter(F.col("status") == "error").select(
        "file_id", "path", "file_type", F.lit(HIGH).alias("priority")
    )


def category_status(settings: DataFrame, files: DataFrame) -> DataFrame:
    """Every category by name: enabled, supported, and how many files it has."""
    counts = files.groupBy("file_type").agg(F.count(F.lit(1)).alias("n_files"))
    everything = settings.sparkSession.createDataFrame(
        [(c,) for c in CATEGORIES], "category string"
    )
    return (
        everything.join(F.broadcast(settings), "category", "left")
        .join(counts, F.col("category") == F.col("file_type"), "left")
        .select(
            "category",
            F.coalesce("enabled", F.lit(False)).alias("enabled"),
            is_supported(F.col("category")).alias("supported"),
            F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"),
        )
        .orderBy("category")
    )


def index_stats(files: DataFrame, chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """One row of counts over the three tables."""
    of_files = files.agg(
        F.count(F.lit(1)).alias("files_total"),
        *[
            F.count_if(F.col("status") == status).alias(f"files_{status}")
            for status in ("indexed", "pending", "error")
        ],
    )
    of_locations = locations.agg(
        F.count(F.lit(1)).alias("locations_total"),
        F.count_if(F.col("enabled")).alias("locations_enabled"),
    )
    return of_files.select(
        "files_total",
        "files_indexed",
        "files_pending",
        "files_error",
        chunks.agg(F.count(F.lit(1)).alias("n")).scalar().alias("chunks_total"),
        of_locations.select("locations_total").scalar().alias("locations_total"),
        of_locations.select("locations_enabled").scalar().alias("locations_enabled"),
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"))
