"""Which files a search may find, as bitmaps over file ids.

For each location, category and status there is a row for every 32768 consecutive ids that have any: a bit for each file. A scope is the union of the
bitmaps of its locations and of its categories, intersected with each other and with the indexed files. Both legs of a search look a row's file up in
the bitmap of its range, so no list of files is joined: ids are dense, and a bitmap of a billion files has 30 thousand rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.filters import Restriction
from docloom.sources.sizes import broadcast_if_small, fits

#: Rows of 4 KB: 64 MB on every executor at most.
MAX_BROADCAST_BITMAPS = 16_384

LOCATION, CATEGORY, STATUS = "location", "category", "status"


def bucket_of(file_id: Column) -> Column:
    return F.bitmap_bucket_number(file_id + 1)


def has_file(bits: Column, file_id: Column) -> Column:
    """Whether the bitmap of the file's bucket has its bit."""
    place = F.bitmap_bit_position(file_id + 1)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1


def file_bitmaps(files: DataFrame) -> DataFrame:
    """(kind, value, bucket, bits) of files (file_id, location_id, file_type, status); write it before searching more than once."""
    values = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"))
        for kind, column in ((LOCATION, "location_id"), (CATEGORY, "file_type"), (STATUS, "status"))
    ])
    rows = files.select("file_id", F.inline(values)).filter("value IS NOT NULL")
    return rows.groupBy("kind", "value", bucket_of(F.col("file_id")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("file_id") + 1)).alias("bits")
    )


def _of_kind(bitmaps: DataFrame, kind: str, listed: Sequence | None, enabled: DataFrame | None) -> DataFrame | None:
    """The union of the bitmaps of a kind's allowed values; None where every value is."""
    if listed is None and enabled is None:
        return None
    rows = bitmaps.filter(F.col("kind") == kind)
    if listed is not None:
        rows = rows.filter(F.col("value").isin(*map(str, listed)) if listed else F.lit(False))
    if enabled is not None:
        rows = rows.join(broadcast_if_small(enabled), "value", "left_semi")
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def scope(
    bitmaps: DataFrame,
    location_ids: Sequence[int] | None = None,
    categories: Sequence[str] | None = None,
    locations: DataFrame | None = None,
    settings: DataFrame | None = None,
) -> DataFrame:
    """(bucket, bits) of the files that ``filters.flag_files`` calls findable."""
    on_locations = None if locations is None else locations.filter("enabled").select(F.col("location_id").cast("string").alias("value"))
    on_categories = None if settings is None else settings.filter("enabled").select(F.col("category").alias("value"))
    parts = [
        _of_kind(bitmaps, STATUS, ["indexed"], None),
        _of_kind(bitmaps, LOCATION, location_ids, on_locations),
        _of_kind(bitmaps, CATEGORY, categories, on_categories),
    ]
    parts = [p for p in parts if p is not None]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return (
        every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") == len(parts)) & (F.bitmap_count("bits") > 0))
        .drop("n")
    )


def restriction(found: DataFrame) -> Restriction:
    """A function that keeps the rows of the files in a scope. Bitmaps are broadcast if they are few, else joined by range."""
    named = found.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    if fits(named, MAX_BROADCAST_BITMAPS):
        named = F.broadcast(named)

    def keep(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_bucket", bucket_of(F.col("file_id"))).join(named, "_bucket")
        return placed.filter(has_file(F.col("_bits"), F.col("file_id"))).select(*rows.columns)

    return keep
