import hashlib
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from docloom.operators import fulltext
from docloom.operators.chunking import explode_chunks
from docloom.operators.maintenance import add_locations, set_attribute
from docloom.plans import indexing
from docloom.plans.indexing import apply_batch, index_batch, refresh, retry_batch
from docloom.plans.searching import search
from docloom.schemas import CHUNKS, FILES, LOCATIONS
from docloom.sources import index_tables
from docloom.sources.files import enabled_roots, list_files, read_contents, read_hashes, scan_files
from docloom.sources.index_tables import IndexTables
from docloom.sources.seeds import file_type_settings


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Title\r\n\r\nhello world")
    (root / "sub" / "b.py").write_text("import x\n\ndef foo():\n    pass\n")
    (root / "c.pdf").write_bytes(b"%PDF")
    (root / "d.zip").write_bytes(b"PK")
    (root / "bad.txt").write_bytes(b"caf\xe9 ok")
    (root / "empty.txt").write_bytes(b"")
    (root / "sub" / "__init__.py").write_bytes(b"")
    (root / "sub" / "loop").symlink_to(root)
    return root


@pytest.fixture
def world(spark, tree):
    locations = spark.createDataFrame(
        [(5, str(tree), True, 0.0), (6, str(tree / "sub"), True, 1.0), (7, "/off", False, 2.0)], LOCATIONS
    )
    return locations, file_type_settings(spark)


def rows_of(files):
    return {os.path.basename(r.path): r for r in files.collect()}


def test_scan(spark, tree, world):
    assert enabled_roots(world[0]) == [str(tree), str(tree / "sub")]
    rows = rows_of(scan_files(spark, [str(tree)]))
    assert set(rows) == {"a.md", "b.py", "c.pdf", "d.zip", "bad.txt", "empty.txt", "__init__.py"}
    assert scan_files(spark, [str(tree), str(tree / "sub") + "/"]).count() == 7
    assert rows["empty.txt"].content == b""
    assert rows["b.py"].path == str(tree / "sub" / "b.py")
    assert rows["a.md"].size_bytes == os.path.getsize(tree / "a.md")
    assert abs(rows["a.md"].mtime - os.path.getmtime(tree / "a.md")) < 0.01
    assert {r.error for r in rows.values()} == {None}
    large = rows_of(scan_files(spark, [str(tree)], max_bytes=10))
    assert set(large) == set(rows) and large["a.md"].content is None and large["bad.txt"].content


def test_index_batch(spark, tree, world):
    pages = spark.createDataFrame([(str(tree / "c.pdf"), 1, "one\n\ntwo")], "path string, page_no int, page_text string")
    empty = spark.createDataFrame([], FILES)
    batch = index_batch(scan_files(spark, [str(tree)]), empty, *world, now=9.0, pages=pages)
    files = rows_of(batch.files)
    assert set(files) == {"a.md", "b.py", "c.pdf", "bad.txt", "empty.txt", "__init__.py"}
    assert {f.status for f in files.values()} == {"indexed"}
    assert (files["a.md"].location_id, files["b.py"].location_id) == (5, 6)
    assert files["c.pdf"].gist == "one" and files["empty.txt"].gist == ""
    assert sorted(f.file_id for f in files.values()) == [1, 2, 3, 4, 5, 6]
    chunks = batch.chunks.collect()
    by_file = {}
    for c in sorted(chunks, key=lambda c: c.chunk_id):
        by_file.setdefault(c.file_id, []).append(c.snippet)
        assert len(c.embedding) == 384 and c.embedder == "hash_embed"
    assert by_file[files["a.md"].file_id] == ["# Title", "hello world"]
    assert by_file[files["bad.txt"].file_id] == ["caf ok"]
    assert by_file[files["c.pdf"].file_id] == ["one", "two"]
    assert files["empty.txt"].file_id not in by_file


def test_refresh_reads_only_what_is_due(spark, tree, world):
    files, chunks = refresh(
        scan_files(spark, [str(tree)]), spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS), *world, now=1.0
    )
    first = rows_of(files)
    stored_files = spark.createDataFrame(files.collect(), FILES)
    stored_chunks = spark.createDataFrame(chunks.collect(), CHUNKS)
    (tree / "a.md").write_text("changed text")
    (tree / "sub" / "b.py").unlink()
    (tree / "new.md").write_text("brand new")
    scan = scan_files(spark, [str(tree)])
    listing = list_files(spark, [str(tree)])
    batch = index_batch(listing, stored_files, *world, now=2.0, read=read_contents)
    assert set(rows_of(batch.files)) == {"a.md", "new.md"}
    assert rows_of(apply_batch(batch, stored_files, stored_chunks)[0])["b.py"].indexed_at == 1.0
    files, chunks = refresh(scan, stored_files, stored_chunks, *world, now=2.0)
    second = rows_of(files)
    assert set(second) == set(first) - {"b.py"} | {"new.md"}
    assert second["a.md"].file_id == first["a.md"].file_id
    assert second["a.md"].content_hash != first["a.md"].content_hash
    assert second["new.md"].file_id == max(f.file_id for f in first.values()) + 1
    snippets = {c.snippet for c in chunks.collect()}
    assert {"changed text", "brand new"} <= snippets and "hello world" not in snippets
    assert second["bad.txt"].indexed_at == 1.0


def test_too_large_files_are_errors_and_tried_again(spark, tree, world):
    empty = spark.createDataFrame([], FILES)
    batch = index_batch(scan_files(spark, [str(tree)], max_bytes=10), empty, *world, now=1.0)
    files = rows_of(batch.files)
    assert files["a.md"].status == "error" and files["bad.txt"].status == "indexed"
    stored = spark.createDataFrame(batch.files.collect(), FILES)
    again = index_batch(scan_files(spark, [str(tree)]), stored, *world, now=2.0)
    assert {n: f.status for n, f in rows_of(again.files).items()} == {"a.md": "indexed", "b.py": "indexed"}


def snapshot(tables):
    index = tables.index()
    return (
        sorted(tuple(r) for r in tables.files().select("file_id", "path", "status").collect()),
        sorted((r.chunk_id, r.snippet) for r in tables.chunks().collect()),
        sorted((r.term, r.chunk_id, r.tf) for r in index.postings.collect()),
        tuple(index.stats.first()),
    )


def test_tables_on_disk(spark, tree, world, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"), buckets=4, term_buckets=2)
    tables.create()
    assert tables.files().count() == 0 and tables.index().stats.first().n_chunks == 0
    tables.apply(index_batch(scan_files(spark, [str(tree)]), tables.files(), *world, now=1.0))
    first = snapshot(tables)
    assert len(first[0]) == 6
    want = fulltext.build_index(tables.chunks())
    assert first[2] == sorted((r.term, r.chunk_id, r.tf) for r in want.postings.collect())
    assert first[3] == tuple(want.stats.first())

    # Nothing changed: nothing is written.
    tables.apply(index_batch(scan_files(spark, [str(tree)]), tables.files(), *world, now=2.0))
    assert snapshot(tables) == first

    queries = spark.createDataFrame([(1, "hello")], "query_id long, text string")
    hits = search(queries, tables.files(), tables.chunks(), tables.index(), *world).collect()
    assert next(h for h in hits if h.bm25 is not None).snippet == "hello world"

    # A change and a removal that may empty whole folders.
    (tree / "a.md").write_text("other words")
    gone = tables.files().filter("path like '%b.py' or path like '%bad.txt'").select("file_id")
    scan = scan_files(spark, [str(tree)])
    batch = index_batch(scan.filter("path like '%a.md'"), tables.files(), *world, now=3.0)
    tables.apply(batch, gone)
    files, chunks, postings, stats = snapshot(tables)
    assert {os.path.basename(p) for _, p, _ in files} == {"a.md", "c.pdf", "empty.txt", "__init__.py"}
    assert [s for _, s in chunks] == ["other words"]
    assert [t for t, _, _ in postings] == ["other", "words"]
    assert stats == (1, 2, 2.0)

    tables.create()
    assert tables.files().count() == 4
    tables.create(reset=True)
    assert snapshot(tables) == ([], [], [], (0, 0, None))


def test_locations_and_settings_on_disk(spark, tree, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"), buckets=4, term_buckets=2)
    tables.create()
    assert tables.locations().count() == 0
    assert sorted(r.category for r in tables.settings().filter("enabled").collect()) == ["code", "pdf", "text"]
    new = spark.createDataFrame([(str(tree), True), (str(tree / "sub"), True)], "path string, enabled boolean")
    tables.save_locations(add_locations(tables.locations(), new, 1.0))
    tables.save_locations(add_locations(tables.locations(), new, 2.0))
    ids = {r.path: r.location_id for r in tables.locations().collect()}
    assert sorted(ids.values()) == [1, 2]
    off = spark.createDataFrame([("pdf", False)], "category string, enabled boolean")
    tables.save_settings(set_attribute(tables.settings(), off, "category", "enabled"))
    tables.create()

    listing = list_files(spark, enabled_roots(tables.locations()))
    batch = index_batch(
        listing, tables.files(), tables.locations(), tables.settings(), now=1.0, read=read_contents
    )
    tables.apply(batch)
    assert set(rows_of(tables.files())) == {"a.md", "b.py", "bad.txt", "empty.txt", "__init__.py"}

    queries = spark.createDataFrame([(1, "foo"), (2, "hello")], "query_id long, text string")

    def found():
        hits = search(
            queries, tables.files(), tables.chunks(), tables.index(), tables.locations(), tables.settings()
        )
        return {(h.query_id, os.path.basename(h.path)) for h in hits.collect() if h.bm25 is not None}

    assert found() == {(1, "b.py"), (2, "a.md")}
    off = spark.createDataFrame([(ids[str(tree)], False)], "location_id long, enabled boolean")
    tables.save_locations(set_attribute(tables.locations(), off, "location_id", "enabled"))
    assert found() == {(1, "b.py")}
    tables.remove_locations([ids[str(tree / "sub")]])
    assert found() == set()
    assert set(rows_of(tables.files())) == {"a.md", "bad.txt", "empty.txt"}
    assert [r.path for r in tables.locations().collect()] == [str(tree)]
    tables.remove_locations([])
    assert tables.files().count() == 3


def test_hash_of_a_file_beyond_the_limit(spark, tree):
    """Files of any size are hashed; the limit is on what a row holds."""
    listing = list_files(spark, [str(tree)])
    hashes = rows_of(read_hashes(listing))
    for name in ("a.md", "bad.txt", "empty.txt"):
        assert hashes[name].content_hash == hashlib.sha256((tree / name).read_bytes()).hexdigest()
    assert rows_of(read_contents(listing, max_bytes=3))["a.md"].error == "too_large"


def test_contents_are_read_once_and_twice_if_due(spark, tree, world):
    """A run reads every file for its hash, and those that are due again."""
    found = list_files(spark, [str(tree)])
    listing = spark.createDataFrame(found.collect(), found.schema)
    log = tree.parent / "reads"

    def counted(kind, reader):
        def run(rows):
            def note(batches):
                for batch in batches:
                    with open(log, "a") as f:
                        f.writelines(f"{kind} {os.path.basename(p)}\n" for p in batch["path"].to_pylist())
                    yield batch

            return reader(rows.mapInArrow(note, rows.schema))

        return run

    options = {"read": counted("read", read_contents), "hashes": counted("hash", read_hashes)}
    batch = index_batch(listing, spark.createDataFrame([], FILES), *world, now=1.0, **options)
    stored = spark.createDataFrame(batch.files.collect(), FILES)
    batch.chunks.collect()
    names = set(rows_of(stored))
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(
        [f"hash {n}" for n in names] + [f"read {n}" for n in names - {"c.pdf"}]  # pages come as a table
    )
    log.write_text("")
    assert index_batch(listing, stored, *world, now=2.0, **options).files.count() == 0
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(f"hash {n}" for n in names)


def test_failing_files_do_not_fail_the_others(spark, tree, world):
    found = list_files(spark, [str(tree)])
    listing = spark.createDataFrame(found.collect(), found.schema)
    (tree / "a.md").unlink()
    (tree / "b2.txt").symlink_to(tree / "nowhere")
    listing = listing.unionByName(spark.createDataFrame([(str(tree), 0.0, 0, "read_failed")], listing.schema))
    listing = listing.unionByName(spark.createDataFrame([(str(tree / "sub") + "/x.txt", 0.0, 1, None)], listing.schema))
    os.mkdir(tree / "sub" / "x.txt")  # a folder under a file's name cannot be read
    batch = index_batch(listing, spark.createDataFrame([], FILES), *world, now=1.0, read=read_contents, hashes=read_hashes)
    files = rows_of(batch.files)
    assert "a.md" not in files and files["b.py"].status == "indexed" and files["x.txt"].status == "error"
    assert files["b.py"].file_id in {c.file_id for c in batch.chunks.collect()}
    # Known files that have vanished are skipped, failed ones are tried again.
    known = spark.createDataFrame(
        [r for r in batch.files.collect()] + [(90, str(tree / "a.md"), 5, "text", "old", 0.0, 1, "", 0.0, "indexed")], FILES
    )
    again = rows_of(index_batch(listing, known, *world, now=2.0, read=read_contents, hashes=read_hashes).files)
    assert again["a.md"].status == "skipped" and again["x.txt"].status == "error" and len(again) == 2
    os.rmdir(tree / "sub" / "x.txt")
    (tree / "sub" / "x.txt").write_text("now it can be read")
    retried = rows_of(retry_batch(known, *world, now=3.0, read=read_contents, hashes=read_hashes).files)
    assert {n: f.status for n, f in retried.items()} == {"x.txt": "indexed"}


def test_refresh_keeps_what_was_not_looked_for(spark, tree, world):
    """Files of a disabled location, and below a folder that could not be listed, are not missing."""
    rows = [(i, p, 5, "text", "", 0.0, 0, "", 0.0, "indexed") for i, p in enumerate(
        (str(tree / "gone.md"), "/off/kept.md", "/elsewhere/kept.md", str(tree / "closed" / "deep" / "kept.md")), 1)]
    known = spark.createDataFrame(rows, FILES)
    listing = list_files(spark, [str(tree)])
    closed = spark.createDataFrame([(str(tree / "closed"), 0.0, 0, "read_failed: PermissionError")], listing.schema)
    files, _ = refresh(
        listing.unionByName(closed), known, spark.createDataFrame([], CHUNKS), *world, now=1.0, read=read_contents, hashes=read_hashes
    )
    paths = {r.path for r in files.collect()}
    assert {r[1] for r in rows[1:]} <= paths and rows[0][1] not in paths


def test_other_bucket_counts_are_refused(spark, tmp_path):
    root = str(tmp_path / "index")
    IndexTables(spark, root, 8, 4).create()
    again = IndexTables(spark, root)
    assert (again.buckets, again.term_buckets) == (8, 4)
    IndexTables(spark, root, 8)
    for other in ({"buckets": 16}, {"term_buckets": 16}):
        with pytest.raises(ValueError, match="buckets"):
            IndexTables(spark, root, **other)


def test_many_chunks_of_a_file_keep_their_own_ids(spark):
    many = spark.range(1, 3).withColumnRenamed("id", "file_id").withColumn(
        "chunks", F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.struct(
            F.lit("text").alias("chunk_type"), i.cast("string").alias("snippet"), F.lit(None).cast("string").alias("position_meta"))))
    chunks = explode_chunks(many)
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 2400


def test_a_batch_that_fails_leaves_the_index_as_it_was(spark, tree, world, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    tables = IndexTables(spark, root, buckets=2, term_buckets=2)
    tables.create()
    tables.apply(index_batch(scan_files(spark, [str(tree)]), tables.files(), *world, now=1.0))
    first = snapshot(tables)
    (tree / "a.md").write_text("other words")
    (tree / "new.md").write_text("brand new")
    batch = index_batch(scan_files(spark, [str(tree)]), tables.files(), *world, now=2.0)

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # chunks are written by then, postings are not
        m.setattr(fulltext, "postings", broken)
        with pytest.raises(RuntimeError):
            tables.apply(batch)
    assert snapshot(tables) == first
    with monkeypatch.context() as m:  # everything is written, but does not count yet
        m.setattr(IndexTables, "_commit", broken)
        with pytest.raises(RuntimeError):
            tables.apply(batch)
    assert snapshot(IndexTables(spark, root)) == first
    tables.apply(batch)
    second = snapshot(tables)
    assert {s for _, s in second[1]} >= {"other words", "brand new"} and second != first
    want = fulltext.build_index(tables.chunks())
    assert second[2] == sorted((r.term, r.chunk_id, r.tf) for r in want.postings.collect())
    terms = sorted(tuple(r) for r in tables.index().vocabulary.select("term", "df", "cf").collect())
    assert terms == sorted(tuple(r) for r in want.vocabulary.select("term", "df", "cf").collect())
    tables.vacuum()
    assert snapshot(IndexTables(spark, root)) == second
    versions = {d for t in ("files", "chunks", "postings") for d in os.listdir(f"{root}/{t}")}
    assert len(versions) <= 2


def test_a_batch_does_not_copy_what_it_leaves(spark, tmp_path, world, monkeypatch):
    """Chunks and postings stay in their versions; what is gone is left out, until a bucket is written whole."""
    root = tmp_path / "index"
    tables = IndexTables(spark, str(root), buckets=2, term_buckets=2)
    tables.create()

    def scan(numbers, word):
        rows = [(f"/in/f{i}.md", float(i), 10, f"{word} number{i}\n\nsecond {word}".encode()) for i in numbers]
        return spark.createDataFrame(rows, "path string, mtime double, size_bytes long, content binary")

    def same_as_new():
        want = fulltext.build_index(tables.chunks())
        files, chunks, postings, stats = snapshot(tables)
        assert postings == sorted((r.term, r.chunk_id, r.tf) for r in want.postings.collect())
        assert stats == tuple(want.stats.first())
        terms = sorted(tuple(r) for r in tables.index().vocabulary.select("term", "df", "cf").collect())
        assert terms == sorted(tuple(r) for r in want.vocabulary.select("term", "df", "cf").collect())
        return len(files), sorted(s for _, s in chunks)

    def stored(version):
        return sum(spark.read.parquet(str(f)).count() for f in (root / "chunks" / f"version={version}").rglob("*.parquet"))

    def apply(numbers, word, paths=()):
        gone = tables.files().filter(F.col("path").isin([f"/in/f{i}.md" for i in paths])).select("file_id")
        tables.apply(index_batch(scan(numbers, word), tables.files(), *world, now=1.0), gone)
        return tables._latest()[0]

    assert stored(apply(range(40), "old")) == 80
    # One file is replaced, one removed, one new.
    assert stored(apply([3, 50], "new", [7])) == 4
    n, texts = same_as_new()
    assert n == 40 and "old number3" not in texts and "new number3" in texts and "old number7" not in texts and len(texts) == 80
    # The replaced file once more, and a removed one again.
    assert stored(apply([3, 7], "last")) == 4
    n, texts = same_as_new()
    assert n == 41 and "new number3" not in texts and {"last number3", "last number7"} <= set(texts) and len(texts) == 82
    tables.vacuum()
    assert same_as_new() == (n, texts)
    # Of most files gone, and of many versions, the rest is written whole.
    rest = stored(apply([], "none", range(10, 40)))
    n, texts = same_as_new()
    assert n == 11 and rest == 22 and not any(tables._manifest()["gone"].values())
    monkeypatch.setattr(index_tables, "MAX_VERSIONS", 1)
    assert stored(apply([60, 61, 62, 63], "late")) >= 8
    assert same_as_new()[0] == 15


def test_a_batch_adds_only_what_it_changes(spark, tmp_path, world, monkeypatch):
    """Files, vocabulary and statistics follow a batch, too; sums of many versions are folded without looking at the chunks."""
    root = tmp_path / "index"
    tables = IndexTables(spark, str(root), buckets=2, term_buckets=2)
    tables.create()
    rows = [(f"/in/f{i}.md", float(i), 10, f"common number{i}\n\nsecond common".encode()) for i in range(60)]
    scan = spark.createDataFrame(rows, "path string, mtime double, size_bytes long, content binary")
    tables.apply(index_batch(scan, tables.files(), *world, now=1.0))

    def stored(table):
        place = root / table / f"version={tables._latest()[0]}"
        return sum(spark.read.parquet(str(f)).count() for f in place.rglob("*.parquet")) if place.exists() else 0

    monkeypatch.setattr(index_tables, "MAX_VERSIONS", 3)
    for i in range(8):
        gone = tables.files().filter(F.col("path") == f"/in/f{i}.md").select("file_id")
        tables.apply(indexing.Batch(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS)), gone)
        assert stored("files") == stored("chunks") == stored("postings") == 0
        assert stored("stats") == 1
        assert stored("vocabulary") == 3 or i >= 2  # common, second and the file's number
        want = fulltext.build_index(tables.chunks())
        assert tables.files().count() == 59 - i and tuple(tables.index().stats.first()) == tuple(want.stats.first())
        terms = sorted(tuple(r) for r in tables.index().vocabulary.select("term", "df", "cf").collect())
        assert terms == sorted(tuple(r) for r in want.vocabulary.select("term", "df", "cf").collect())
    for table in ("vocabulary", "stats"):
        assert max(map(len, tables._manifest()[table].values())) <= 3


def held(spark, n=20):
    """A scan with contents, one of which is missing, and pages for its paged files."""
    kinds = ("md", "py", "pdf")
    rows = [(f"/in/f{i}.{kinds[i % 3]}", float(i), 10, f"one {i}\n\ndef two{i}():\n  pass".encode()) for i in range(n)]
    scan = spark.createDataFrame([*rows, ("/in/none.md", 0.0, 10, None)], "path string, mtime double, size_bytes long, content binary")
    pages = [(path, k, f"page {k} of {path}") for path, *_ in rows if path.endswith("pdf") for k in (1, 2)]
    return scan, spark.createDataFrame(pages, "path string, page_no int, page_text string")


def test_vectors_are_not_moved(spark, tmp_path, world, monkeypatch):
    tables = IndexTables(spark, str(tmp_path / "index"), buckets=2, term_buckets=2)
    tables.create()
    scan, pages = held(spark)
    batch = index_batch(scan, tables.files(), *world, now=1.0, pages=pages)
    plans, write = {}, DataFrameWriter.parquet

    def watched(self, path, *rest, **more):
        plans[path.split("/")[-2]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        write(self, path, *rest, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    tables.apply(batch)
    assert 0 <= plans["chunks"].find("ArrowEvalPython") < plans["chunks"].index("RebalancePartitions")
    assert "ArrowEvalPython" not in plans["postings"] and "Join" not in plans["postings"]
    want = {r.chunk_id: r.embedding for r in batch.chunks.collect()}
    assert {r.chunk_id: r.embedding for r in tables.chunks().collect()} == want and len(want) > 20


@pytest.mark.parametrize("few", [0, 10_000])
def test_postings_are_not_moved(spark, tmp_path, world, monkeypatch, few):
    """Texts are dealt to their buckets before they become postings, in parts of so many chunks."""
    monkeypatch.setattr(index_tables, "FEW_CHUNKS", few)
    monkeypatch.setattr(index_tables, "CHUNKS_AT_ONCE", 5)
    tables = IndexTables(spark, str(tmp_path / "index"), buckets=2, term_buckets=2)
    tables.create()
    scan, pages = held(spark)
    plans, write = {}, DataFrameWriter.parquet

    def watched(self, path, *rest, **more):
        plans[path.split("/")[-2]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        write(self, path, *rest, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    tables.apply(index_batch(scan, tables.files(), *world, now=1.0, pages=pages))
    assert 0 <= plans["postings"].find("MapInArrow") < plans["postings"].index("Repartition" if not few else "RebalancePartitions")
    want = fulltext.build_index(tables.chunks()).postings
    assert sorted(map(str, tables.read("postings").drop("bucket", "term_bucket").collect())) == sorted(map(str, want.collect()))


def test_contents_are_cut_where_they_are(spark, world, monkeypatch):
    """When the list of files due is too long to be sent to the contents."""
    scan, pages = held(spark)
    empty = spark.createDataFrame([], FILES)

    def rows():
        batch = index_batch(scan, empty, *world, now=1.0, pages=pages)
        return [sorted(map(str, df.collect())) for df in (batch.files, batch.chunks)]

    want, given, cut = rows(), [], indexing.extract_all
    monkeypatch.setattr(indexing, "extract_all", lambda texts, *rest, **more: given.append(texts.columns) or cut(texts, *rest, **more))
    monkeypatch.setattr(indexing, "MAX_BROADCAST_ROWS", 2)
    assert rows() == want and len(want[0]) == 21
    assert len(given) == 1 and "file_id" not in given[0]
    # Of a scan that is mostly known, the others stay out.
    known = index_batch(scan, empty, *world, now=1.0, pages=pages).files.filter("file_id % 2 = 0")
    batch = index_batch(scan, known.localCheckpoint(), *world, now=1.0, pages=pages)
    assert "file_id" in given[-1] and batch.files.count() == 21 - known.count()
