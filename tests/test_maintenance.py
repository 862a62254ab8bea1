import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import maintenance as m
from docloom.schemas import FILES, LOCATIONS
from docloom.sources.seeds import file_type_settings


def files(spark, rows):
    """rows: (id, path, location, hash, mtime, status)."""
    return spark.createDataFrame(
        [(i, p, loc, "text", h, t, 1, "", 0.0, s) for i, p, loc, h, t, s in rows], FILES
    )


def test_detect_changes(spark):
    old = files(
        spark,
        [(1, "/same", 1, "a", 10.0, "indexed"), (2, "/edited", 1, "a", 10.0, "indexed"),
         (3, "/touched", 1, "a", 10.0, "indexed"), (4, "/failed", 1, "a", 10.0, "error"),
         (5, "/gone", 1, "a", 10.0, "indexed")],
    )
    scan = spark.createDataFrame(
        [("/same", 10.9, 1, "a"), ("/edited", 10.0, 1, "b"), ("/touched", 11.0, 1, "a"),
         ("/failed", 10.0, 1, "a"), ("/new", 1.0, 1, "z")],
        "path string, mtime double, size_bytes long, content_hash string",
    )
    got = {r.path: (r.file_id, r.state) for r in m.detect_changes(scan, old).collect()}
    assert got == {
        "/same": (1, "unchanged"), "/edited": (2, "changed"), "/touched": (3, "changed"),
        "/failed": (4, "unfinished"), "/new": (None, "new"),
    }


def test_upsert_keeps_the_id_and_the_last_version(spark):
    base = files(spark, [(7, "/x", 1, "abc", 1.0, "pending"), (3, "/y", 1, "abc", 1.0, "indexed")])
    changes = files(spark, [(0, "/x", 1, h, 1.0, "indexed") for h in ("abc1", "def456", "abc2")])
    changes = changes.withColumn("version", F.when(F.col("content_hash") == "def456", 3).otherwise(1))
    rows = {r.path: r for r in m.upsert_by_key(base, changes, "path", "file_id", "version").collect()}
    assert len(rows) == 2
    assert (rows["/x"].file_id, rows["/x"].content_hash, rows["/x"].status) == (7, "def456", "indexed")
    assert rows["/y"].file_id == 3


def test_new_ids_are_consecutive_and_repeatable(spark):
    paths = [f"/p/{i}" for i in range(3000)]
    random.Random(1).shuffle(paths)
    base = files(spark, [(41, "/old", 1, "a", 1.0, "indexed")])
    rows = spark.createDataFrame([(p,) for p in paths + ["/old"]], "path string")
    want = sorted(paths, key=lambda p: (hashlib.md5(p.encode()).hexdigest()[:3], p))
    for parts in (1, 7):
        got = {r.path: r.file_id for r in m.with_ids(rows.repartition(parts), base, "path", "file_id").collect()}
        assert got.pop("/old") == 41
        assert got == {p: 42 + i for i, p in enumerate(want)}


def test_locations(spark):
    locations = spark.createDataFrame(
        [(1, "/docs", True, 0.0), (2, "/docs/in", False, 1.0), (3, "/doc", True, 2.0), (4, "/", False, 3.0)],
        LOCATIONS,
    )
    paths = ["/docs/a.md", "/docs/in/b.md", "/docs2/c", "/doc/d", "/x", "rel/y"]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    got = {r.path: r.location_id for r in m.assign_location(df, locations).collect()}
    assert got == {"/docs/a.md": 1, "/docs/in/b.md": 2, "/docs2/c": 4, "/doc/d": 3, "/x": 4, "rel/y": None}
    inside = {r.path for r in m.paths_in_scope(df, locations).collect()}
    assert inside == {"/docs/a.md", "/docs/in/b.md", "/doc/d"}


def test_remove_and_purge(spark):
    all_files = files(spark, [(1, "/a/x", 1, "h", 1.0, "indexed"), (2, "/b/y", 2, "h", 1.0, "indexed")])
    chunks = spark.createDataFrame([(1000, 1), (1001, 1), (2000, 2)], "chunk_id long, file_id long")
    locations = spark.createDataFrame([(1, "/a", True, 0.0), (2, "/b", True, 1.0)], LOCATIONS)
    f, c, loc = m.remove_location(all_files, chunks, locations, [1])
    assert ([r.file_id for r in f.collect()], [r.chunk_id for r in c.collect()]) == ([2], [2000])
    assert [r.location_id for r in loc.collect()] == [2]
    f, c, loc = m.remove_location(all_files, chunks, locations, [])
    assert (f.count(), c.count(), loc.count()) == (2, 3, 2)
    everywhere = spark.createDataFrame([(9, "/", True, 0.0)], "location_id long, path string, enabled boolean, added_at double")
    f, c = m.purge_missing(all_files, chunks, spark.createDataFrame([("/a/x",)], "path string"), everywhere)
    assert ([r.file_id for r in f.collect()], c.count()) == ([1], 2)


def test_replace_and_set(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "chunk_id long, file_id long, snippet string")
    new = spark.createDataFrame([(10, 1, "z")], base.schema)
    owners = spark.createDataFrame([(1,), (3,)], "file_id long")
    assert sorted(tuple(r) for r in m.replace_by_owner(base, new, owners).collect()) == [(2, 2, "b"), (10, 1, "z")]
    updates = spark.createDataFrame([(2, None)], "chunk_id long, snippet string")
    got = m.set_attribute(base, updates, "chunk_id", "snippet").collect()
    assert sorted((r.chunk_id, r.snippet or "") for r in got) == [(1, "a"), (2, ""), (3, "c")]


@pytest.mark.parametrize(
    "exists, category, error, status",
    [(True, "text", None, "indexed"), (False, "text", None, "skipped"), (True, "image", None, "skipped"),
     (True, None, None, "skipped"), (True, "code", "boom", "error")],
)
def test_status(spark, exists, category, error, status):
    df = spark.createDataFrame([(exists, category, error)], "x boolean, c string, e string")
    assert df.select(m.index_status(F.col("x"), F.col("c"), F.col("e")).alias("s")).first().s == status


def test_statistics(spark):
    all_files = files(
        spark, [(i, f"/{i}", 1, "h", 1.0, s) for i, s in enumerate(["indexed", "indexed", "pending", "error", "skipped"])]
    )
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "chunk_id long, file_id long")
    locations = spark.createDataFrame([(1, "/a", True, 0.0), (2, "/b", False, 1.0)], LOCATIONS)
    assert tuple(m.index_stats(all_files, chunks, locations).first()) == (5, 2, 1, 1, 3, 2, 1)
    assert {tuple(r) for r in m.chunk_counts(chunks).collect()} == {(1, 2), (2, 1)}


def test_categories(spark):
    rows = m.category_status(file_type_settings(spark), files(spark, [(1, "/a", 1, "h", 1.0, "indexed")])).collect()
    assert [r.category for r in rows] == ["code", "image", "office", "pdf", "text", "video"]
    assert [r.category for r in rows if r.enabled] == ["code", "pdf", "text"]
    assert [r.category for r in rows if r.supported] == ["code", "pdf", "text"]
    assert next(r.n_files for r in rows if r.category == "text") == 1
