"""Column expressions and small helpers shared by the operators of this package."""

from __future__ import annotations

import string
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.sizes import written

#: The six characters that count as white space in the contracts: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fingerprint(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a string column."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def text_hash(text: Column) -> Column:
    """With the id, the name of a row: rows of equal id and text are treated alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` without the rows that ``gone`` (_id, _h) names; texts stay in the JVM."""
    same = docs[id_column].eqNullSafe(gone["_id"]) & (text_hash(docs[text_column]) == gone["_h"])
    return docs.join(gone, same, "left_anti")


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe if executors go."""
    return written(df, name)


def worker_state() -> types.ModuleType:
    """A place that lives as long as a Python worker does, for what its tasks can share.

    The functions of this library travel by value, so their own module globals do not last."""
    return sys.modules.setdefault("_docloom_worker", types.ModuleType("_docloom_worker"))
