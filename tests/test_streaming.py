import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.plans.indexing import index_batch
from docloom.schemas import CHANGE_EVENTS, LOCATIONS
from docloom.sources.index_tables import IndexTables
from docloom.sources.seeds import file_type_settings
from docloom.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (action, path, dest, is_directory), in order of arrival."""
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=i), *r) for i, r in enumerate(rows)], CHANGE_EVENTS
    )


FEED = [
    ("created", "/a.md", None, False),
    ("modified", "/a.md", None, False),
    ("modified", "/b.py", None, False),
    ("moved", "/c.md", "/d.md", False),
    ("deleted", "/e.md", None, False),
    ("created", "/dir.md", None, True),
    ("created", "/f.png", None, False),
    ("created", "/g.zip", None, False),
    ("moved", "/h.md", "/h.png", False),
]


def test_classify(spark):
    jobs = changes.change_jobs(events(spark, FEED), file_type_settings(spark)).orderBy("event_id")
    assert [(r.path, r.file_type, r.priority) for r in jobs.collect()] == [
        ("/a.md", "text", 1), ("/a.md", "text", 2), ("/b.py", "code", 2), ("/d.md", "text", 1),
    ]
    gone = {r.path for r in changes.gone_paths(events(spark, FEED)).collect()}
    assert gone == {"/c.md", "/e.md", "/h.md"}


def test_first_job_of_a_path_wins_and_high_priority_goes_first(spark):
    jobs = changes.coalesce_jobs(changes.change_jobs(events(spark, FEED), file_type_settings(spark)))
    rows = changes.job_order(jobs).collect()
    assert [(r.path, r.priority) for r in rows] == [("/b.py", 2), ("/a.md", 1), ("/d.md", 1)]


def test_bounded_batches(spark):
    jobs = changes.change_jobs(
        events(spark, [("created", f"/file{i}.txt", None, False) for i in range(5)]), file_type_settings(spark)
    )
    first = changes.first_jobs(jobs, 3)
    assert [r.path for r in first.collect()] == ["/file0.txt", "/file1.txt", "/file2.txt"]
    rest = jobs.join(first.select("event_id"), "event_id", "left_anti")
    assert changes.first_jobs(rest, 3).count() == 2


def test_counters(spark):
    jobs = events(spark, [("created", f"/{i}.md", None, False) for i in range(6)])
    outcomes = spark.createDataFrame(
        [(0, "done"), (1, "done"), (2, "failed"), (3, "running")], "event_id long, state string"
    )
    row = changes.change_stats(jobs, outcomes).first()
    assert (row.enqueued, row.pending, row.in_flight, row.completed, row.failed, row.depth) == (6, 2, 1, 2, 1, 2)


def test_failed_files_are_tried_again(spark):
    files = spark.createDataFrame(
        [(1, "/a.md", "text", "error"), (2, "/b.md", "text", "indexed")],
        "file_id long, path string, file_type string, status string",
    )
    assert [(r.path, r.priority) for r in changes.retry_jobs(files).collect()] == [("/a.md", changes.HIGH)]


def test_stream_coalescing(spark, tmp_path):
    for i, half in enumerate((FEED[:2], FEED[2:])):
        events(spark, half).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(CHANGE_EVENTS).parquet(f"{tmp_path}/in/*")
    jobs = changes.coalesce_stream(changes.change_jobs(stream, file_type_settings(spark)))
    query = jobs.writeStream.format("memory").queryName("coalesced").outputMode("append").start()
    try:
        query.processAllAvailable()
        assert sorted(r.path for r in spark.table("coalesced").collect()) == ["/a.md", "/b.py", "/d.md"]
    finally:
        query.stop()


def scan(spark, files):
    return spark.createDataFrame(
        [(p, 1.0, len(t), bytearray(t.encode())) for p, t in files.items()],
        "path string, mtime double, size_bytes long, content binary",
    )


def state(tables):
    chunks = tables.chunks().join(tables.files().select("file_id", "path"), "file_id")
    return (
        sorted(r.path for r in tables.files().collect()),
        sorted((r.path, r.snippet) for r in chunks.collect()),
    )


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_gives_what_a_fresh_index_has(spark, tmp_path, batches):
    settings = file_type_settings(spark)
    locations = spark.createDataFrame([(1, "/", True, 0.0)], LOCATIONS)
    before = {"/a.md": "old a", "/b.py": "def b(): pass", "/c.md": "moving", "/e.md": "leaving", "/z.md": "stays"}
    after = {"/a.md": "new a", "/b.py": "def b2(): pass", "/d.md": "moving", "/z.md": "stays", "/f.png": "x"}
    tables = IndexTables(spark, f"{tmp_path}/index", buckets=3, term_buckets=2)
    tables.create()
    tables.apply(index_batch(scan(spark, before), tables.files(), locations, settings, now=0.0))
    ids = {r.path: r.file_id for r in tables.files().collect()}

    feed = events(spark, FEED)
    for i in range(batches):
        feed.filter(F.col("event_id") % batches == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = (
        spark.readStream.schema(CHANGE_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    )
    changes.stream_apply(
        stream, tables, lambda: scan(spark, after), locations, settings, f"{tmp_path}/cp", now=lambda: 1.0
    ).awaitTermination()

    fresh = IndexTables(spark, f"{tmp_path}/fresh", buckets=3, term_buckets=2)
    fresh.create()
    fresh.apply(index_batch(scan(spark, after), fresh.files(), locations, settings, now=1.0))
    assert state(tables) == state(fresh)
    now = {r.path: r.file_id for r in tables.files().collect()}
    assert {p: now[p] for p in ("/a.md", "/b.py", "/z.md")} == {p: ids[p] for p in ("/a.md", "/b.py", "/z.md")}

    # The same events again change nothing.
    done = state(tables)
    changes.apply_events(feed, tables, scan(spark, after), locations, settings, now=2.0)
    assert state(tables) == done
