"""Strings and the prefixes they start with, for any number of either.

The strings that start with a prefix are an interval of the sorted strings, and two such intervals lie inside one another or apart.
So one pass over both kinds in order is enough, with a stack of the prefixes that are open: no string is
multiplied by its beginnings, and none is compared with a prefix it does not start with. Strings are dealt to tasks by ranges; a
prefix goes to all ranges that its interval reaches into, so that each task starts with what is open at its border.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows for each range, and the most ranges that a driver should plan.
ROWS_PER_RANGE = 500_000
MAX_RANGES = 4096
LAST_CHARACTER = 0x10FFFF


def next_string(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None if there is none."""
    while prefix:
        code = ord(prefix[-1]) + 1
        if code <= LAST_CHARACTER:
            return prefix[:-1] + chr(0xE000 if code == 0xD800 else code)
        prefix = prefix[:-1]
    return None


def in_intervals(column: Column, prefixes: list[str]) -> Column:
    """Whether the column starts with one of the prefixes, as a comparison with the ends of their intervals.

    Of prefixes inside one another only the outermost counts."""
    outer: list[str] = []
    for prefix in sorted(set(prefixes)):
        if not outer or not prefix.startswith(outer[-1]):
            outer.append(prefix)
    condition = F.lit(False)
    for prefix in outer:
        end = next_string(prefix)
        inside = column >= prefix
        condition = condition | (inside if end is None else inside & (column < end))
    return condition


def _bounds(strings: DataFrame, ranges: int) -> list[str]:
    """Strings that cut the table into ranges of about equal size, from a sample of bounded size: at most 40 for each range.

    The sample only balances the ranges; any bounds give the same result."""
    if ranges <= 1:
        return []
    least = strings.select(F.xxhash64("_string").alias("_hash"), "_string").distinct().orderBy("_hash").limit(40 * ranges)
    sample = sorted(row["_string"] for row in least.select("_string").collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _dealt(bounds: list[str]):
    """The ranges of each row: a string's own, and for a prefix all that its interval reaches into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for string, is_string in zip(batch["_string"].to_pylist(), batch["_is_string"].to_pylist(), strict=True):
                at = bisect_right(bounds, string)
                end = None if is_string else next_string(string)
                first.append(at)
                last.append(at if is_string else len(bounds) if end is None else max(at, bisect_left(bounds, end)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*batch.schema.names, "_first", "_last"]
            )

    return run


def _sweep(innermost: bool):
    """Rows in order, prefixes before the strings equal to them: the pairs of a string and the prefixes open at it, or the last of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[tuple[str, object]] = []
        current = None
        for batch in batches:
            keys, prefixes = [], []
            columns = (batch[c].to_pylist() for c in ("_range", "_string", "_is_string", "_key", "_prefix"))
            for number, string, is_string, key, prefix in zip(*columns, strict=True):
                if number != current:
                    current, opened = number, []
                while opened and not string.startswith(opened[-1][0]):
                    opened.pop()
                if not is_string:
                    opened.append((string, prefix))
                elif opened:
                    found = opened[-1:] if innermost else opened
                    keys += [key] * len(found)
                    prefixes += [p for _, p in found]
            kinds = batch.schema
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, kinds.field("_key").type), pa.array(prefixes, kinds.field("_prefix").type)], names=["_key", "_prefix"]
            )

    return run


def prefix_pairs(strings: DataFrame, prefixes: DataFrame, innermost: bool = False, ranges: int | None = None) -> DataFrame:
    """(_key, _prefix): the keys of strings (_key, _string) and of prefixes (_key, _string) that they start with.

    ``innermost`` keeps the longest prefix of each string. Null strings have and are no prefix; equal prefixes all count (with
    ``innermost`` the one of the largest key). The number of ``ranges`` follows from the number of strings."""
    strings, prefixes = strings.filter("_string IS NOT NULL"), prefixes.filter("_string IS NOT NULL")
    key, prefix = strings.schema["_key"].dataType, prefixes.schema["_key"].dataType
    if ranges is None:
        ranges = max(1, min(MAX_RANGES, -(-strings.count() // ROWS_PER_RANGE)))
    bounds = _bounds(strings, ranges)
    rows = strings.select("_string", F.lit(True).alias("_is_string"), "_key", F.lit(None).cast(prefix).alias("_prefix")).unionByName(
        prefixes.select("_string", F.lit(False).alias("_is_string"), F.lit(None).cast(key).alias("_key"), F.col("_key").alias("_prefix"))
    )
    ends = [T.StructField("_first", T.IntegerType()), T.StructField("_last", T.IntegerType())]
    dealt = rows.mapInArrow(_dealt(bounds), T.StructType([*rows.schema.fields, *ends]))
    placed = dealt.withColumn("_range", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    in_order = placed.repartition(len(bounds) + 1, "_range").sortWithinPartitions("_range", "_string", "_is_string", "_prefix", "_key")
    return in_order.mapInArrow(_sweep(innermost), T.StructType([T.StructField("_key", key), T.StructField("_prefix", prefix)]))


def path_key(path: Column) -> Column:
    """A path as a string that starts with the key of each folder above it, and with its own; slashes at the end do not count.

    The separator becomes the least character, and ends the key; the two characters that this needs are written otherwise."""
    plain = F.regexp_replace(path, r"/+\z", "")
    escaped = F.replace(F.replace(plain, F.lit("\x02"), F.lit("\x02\x03")), F.lit("\x01"), F.lit("\x02\x02"))
    return F.concat(F.replace(escaped, F.lit("/"), F.lit("\x01")), F.lit("\x01"))
