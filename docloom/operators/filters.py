"""Which files a search may find: status, location and category."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import category_of, is_blank, is_supported
from docloom.sources.sizes import broadcast_if_small, fits

Restriction = Callable[[DataFrame], DataFrame]


def one_of(column: str, values: Sequence | None) -> Column:
    """Membership in a list; no list means no condition, an empty list means nothing."""
    if values is None:
        return F.lit(True)
    return F.col(column).isin(*values) if values else F.lit(False)


def flag_files(
    files: DataFrame,
    location_ids: Sequence[int] | None = None,
    categories: Sequence[str] | None = None,
    locations: DataFrame | None = None,
    settings: DataFrame | None = None,
) -> DataFrame:
    """(file_id, findable): indexed, and in the given lists and the enabled locations/categories."""
    findable = (
        (F.col("status") == "indexed")
        & one_of("location_id", location_ids)
        & one_of("file_type", categories)
    )
    flagged = files
    if locations is not None:
        on = locations.filter("enabled").select("location_id", F.lit(True).alias("_location_on"))
        flagged = flagged.join(broadcast_if_small(on), "location_id", "left")
        findable = findable & F.col("_location_on").isNotNull()
    if settings is not None:
        on = settings.filter("enabled").select(
            F.col("category").alias("file_type"), F.lit(True).alias("_category_on")
        )
        flagged = flagged.join(broadcast_if_small(on), "file_type", "left")
        findable = findable & F.col("_category_on").isNotNull()
    return flagged.select("file_id", F.coalesce(findable, F.lit(False)).alias("findable"))


def restriction(flagged: DataFrame) -> Restriction:
    """A function that keeps the rows of findable files.

    Whichever list is short, that of the files to keep or that of the files to leave out, is
    broadcast, so that vectors need not be shuffled; only when both are long are rows shuffled.
    """
    kept = flagged.filter("findable").select("file_id")
    left_out = flagged.filter(~F.col("findable")).select("file_id")
    if fits(kept):
        return lambda rows: rows.join(F.broadcast(kept), "file_id", "left_semi")
    if fits(left_out):
        return lambda rows: rows.join(F.broadcast(left_out), "file_id", "left_anti")
    return lambda rows: rows.join(kept, "file_id", "left_semi")


def findable_files(files: DataFrame, **conditions) -> DataFrame:
    """The files themselves that a search with these conditions may find."""
    flagged = flag_files(files, **conditions).filter("findable")
    return files.join(flagged.select("file_id"), "file_id", "left_semi")


def with_indexable(scan: DataFrame, settings: DataFrame) -> DataFrame:
    """``scan`` with file_type and obstacle: why a file is not indexed (unsupported or disabled), NULL where it is."""
    enabled = settings.filter("enabled").select(F.col("category").alias("file_type"), F.lit(True).alias("_on"))
    typed = scan.withColumn("file_type", category_of(F.col("path")))
    supported = F.coalesce(is_supported(F.col("file_type")), F.lit(False))
    obstacle = F.when(~supported, "unsupported").when(F.col("_on").isNull(), "disabled")
    return typed.join(broadcast_if_small(enabled), "file_type", "left").withColumn("obstacle", obstacle).drop("_on")


def indexable_files(scan: DataFrame, settings: DataFrame) -> DataFrame:
    """Files of a category that is supported and enabled."""
    enabled = settings.filter("enabled").select(F.col("category").alias("file_type"))
    return (
        scan.withColumn("file_type", category_of(F.col("path")))
        .filter(is_supported(F.col("file_type")))
        .join(broadcast_if_small(enabled), "file_type", "left_semi")
    )


def asked(queries: DataFrame, text: str = "text") -> DataFrame:
    """Queries that are not blank."""
    return queries.filter(~is_blank(F.col(text)))


def files_by_location(files: DataFrame, location_id: int) -> DataFrame:
    return files.filter(F.col("location_id") == location_id).orderBy("path")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def file_by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.filter(F.col("file_id") == file_id)
