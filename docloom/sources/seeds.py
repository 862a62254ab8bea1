"""The dimension tables every index starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.text import CATEGORIES, SUPPORTED_CATEGORIES
from docloom.schemas import FILE_TYPE_SETTINGS


def file_type_settings(spark: SparkSession) -> DataFrame:
    """Each category and whether it is on: the supported ones are."""
    return spark.createDataFrame(
        [(c, c in SUPPORTED_CATEGORIES) for c in CATEGORIES], FILE_TYPE_SETTINGS
    )
