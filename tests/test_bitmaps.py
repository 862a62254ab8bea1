import itertools
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import bitmaps, filters

FILES = "file_id long, location_id long, file_type string, status string"


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(6)
    ids = [*range(0, 300), *range(32_700, 32_800), 65_535, 65_536, 98_303, 10**9, 10**9 + 1]
    kinds = ["text", "code", "pdf", "office", None]
    rows = [(i, rng.choice([1, 2, 3, 40, None]), rng.choice(kinds), rng.choice(["indexed", "indexed", "error", "pending"])) for i in ids]
    return spark.createDataFrame(rows, FILES).repartition(3)


def scopes(spark):
    locations = spark.createDataFrame([(1, "/a", True, 0.0), (2, "/b", False, 0.0), (3, "/c", True, 0.0)], "location_id long, path string, enabled boolean, added_at double")
    settings = spark.createDataFrame([("text", True), ("code", False), ("pdf", True)], "category string, enabled boolean")
    return itertools.product((None, [], [1, 2, 40]), (None, [], ["text", "code"]), (None, locations), (None, settings))


def test_same_as_lists(spark, files):
    stored = bitmaps.file_bitmaps(files).cache()
    for location_ids, categories, locations, settings in scopes(spark):
        asked = dict(location_ids=location_ids, categories=categories, locations=locations, settings=settings)
        want = {r.file_id for r in filters.flag_files(files, **asked).filter("findable").collect()}
        keep = bitmaps.restriction(bitmaps.scope(stored, **asked))
        chunks = files.select((F.col("file_id") * 7).alias("chunk_id"), "file_id").unionByName(files.select(F.lit(1).alias("chunk_id"), "file_id"))
        kept = keep(chunks)
        got = kept.collect()
        assert kept.columns == chunks.columns and {r.file_id for r in got} == want and len(got) == 2 * len(want), asked
    stored.unpersist()


def test_shuffled_when_there_are_many(spark, files, monkeypatch):
    stored = bitmaps.file_bitmaps(files)
    few = sorted(r.file_id for r in bitmaps.restriction(bitmaps.scope(stored))(files).collect())
    monkeypatch.setattr(bitmaps, "MAX_BROADCAST_BITMAPS", 1)
    assert sorted(r.file_id for r in bitmaps.restriction(bitmaps.scope(stored))(files).collect()) == few


def test_no_join_with_files(spark, files):
    stored = spark.createDataFrame(bitmaps.file_bitmaps(files).toArrow())
    found = spark.createDataFrame(bitmaps.scope(stored, location_ids=[1]).toArrow())
    chunks = spark.range(1000).select("id", (F.col("id") % 300).alias("file_id"))
    plan = bitmaps.restriction(found)(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin") == 1 and "location_id" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], FILES)
    assert bitmaps.file_bitmaps(none).count() == 0
    keep = bitmaps.restriction(bitmaps.scope(bitmaps.file_bitmaps(none)))
    assert keep(spark.createDataFrame([(1,)], "file_id long")).count() == 0
