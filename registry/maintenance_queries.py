"""Index maintenance. The state before a change is that of the documents `labels` covers: a label of
poor quality stands for other contents, a toxic one for a file touched since."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import functions as F

from docloom.functions.text import category_of
from docloom.operators import filters, maintenance, trees
from docloom.operators.chunking import chunk_id
from docloom.plans.indexing import index_batch, refresh, retry_batch
from docloom.schemas import CHUNKS, FILES
from docloom.sources.files import list_files, read_contents, read_hashes
from docloom.sources.index_tables import IndexTables
from docloom.sources.large_files import cut_files
from docloom.sources.seeds import file_type_settings
from docloom.sources.sizes import shared_folder, written
from registry import inputs, sqltext
from registry.base import query
from registry.chunk_queries import CODE_CHUNKS, SHEETS
from registry.search_queries import LOCATIONS, locations

FILE_COLUMNS = "file_id, path, location_id, file_type, content_hash, mtime, size_bytes, status"


def old_files(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")
    edited = F.sha2(F.concat(F.col("content_hash"), F.lit("edited")).cast("binary"), 256)
    return (
        inputs.files(spark, sf_dir)
        .join(labels, "file_id")
        .withColumn(
            "content_hash", F.when(F.col("quality") == 0, edited).otherwise(F.col("content_hash"))
        )
        .withColumn("mtime", F.col("mtime") + F.when(F.col("toxic") == 1, 2.0).otherwise(0.5))
        .drop("quality", "toxic")
    )


OLD_FILES = """
old_files AS (
  SELECT file_id, path, location_id, file_type,
         CASE WHEN quality = 0 THEN sha256(content_hash || 'edited') ELSE content_hash END AS content_hash,
         mtime + CASE WHEN toxic = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS mtime,
         size_bytes, status
  FROM files JOIN labels ON doc_id = file_id)"""

_STATES = """
states AS (
  SELECT f.path, o.file_id, f.file_id AS scanned_id, CASE
           WHEN o.file_id IS NULL THEN 'new'
           WHEN f.content_hash <> o.content_hash OR abs(f.mtime - o.mtime) >= 1 THEN 'changed'
           WHEN o.status <> 'indexed' THEN 'unfinished' ELSE 'unchanged' END AS state
  FROM files f LEFT JOIN old_files o ON f.path = o.path)"""


def _scan(spark, sf_dir):
    return inputs.files(spark, sf_dir).select("path", "mtime", "size_bytes", "content_hash")


@query(
    "detect_changes",
    f"WITH {sqltext.FILES}, {OLD_FILES}, {_STATES} SELECT path, file_id, state FROM states",
)
def detect_changes(spark, sf_dir):
    states = maintenance.detect_changes(_scan(spark, sf_dir), old_files(spark, sf_dir))
    return states.select("path", "file_id", "state")


@query(
    "detect_changes_tree",
    f"""WITH {sqltext.FILES}, {OLD_FILES}, {_STATES}
        SELECT path, file_id, state FROM states JOIN documents ON doc_id = scanned_id
        WHERE state <> 'unchanged' AND lang <> 'es'
        UNION ALL
        SELECT path, file_id, 'gone' FROM old_files JOIN documents ON doc_id = file_id WHERE lang = 'es'""",
)
def detect_changes_tree(spark, sf_dir):
    """The Spanish folders are gone; of the others, those whose digests are the known ones are not looked at."""
    spanish = F.col("path").contains("/es/")
    scan, known = _scan(spark, sf_dir).filter(~spanish), old_files(spark, sf_dir)
    changes, gone = trees.detect_changes_tree(scan, known)
    removed = known.join(gone, "path", "left_semi").select("path", "file_id", F.lit("gone").alias("state"))
    return changes.select("path", "file_id", "state").unionByName(removed)


def nested_locations(spark, sf_dir):
    """Every source as a location, and its English and French folders as locations inside it."""
    inner = (
        inputs.table(spark, sf_dir, "documents")
        .select("source", "lang")
        .filter(F.col("lang").isin("en", "fr"))
        .distinct()
        .select(
            (
                F.substring("source", 4, 10).cast("long") * 10
                + F.when(F.col("lang") == "en", 1000).otherwise(1001)
            ).alias("location_id"),
            F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/")).alias("path"),
            (F.col("lang") == "en").alias("enabled"),
            F.lit(0.0).alias("added_at"),
        )
    )
    return locations(spark, sf_dir).unionByName(inner)


_NESTED = f"""
{LOCATIONS},
nested AS (
  SELECT location_id, path, enabled FROM locations
  UNION ALL
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) * 10
           + CASE lang WHEN 'en' THEN 1000 ELSE 1001 END,
         '/' || source || '/' || lang, lang = 'en'
  FROM documents WHERE lang IN ('en', 'fr'))"""


@query(
    "assign_location",
    f"""WITH {sqltext.FILES}, {_NESTED}
        SELECT f.path, arg_max(n.location_id, length(n.path)) AS location_id
        FROM files f LEFT JOIN nested n ON starts_with(f.path, n.path || '/') GROUP BY f.path""",
)
def assign_location(spark, sf_dir):
    paths = inputs.files(spark, sf_dir).select("path")
    return maintenance.assign_location(paths, nested_locations(spark, sf_dir))


@query(
    "paths_in_scope",
    f"""WITH {sqltext.FILES}, {_NESTED}
        SELECT path FROM files f
        WHERE EXISTS (SELECT 1 FROM nested n WHERE enabled AND starts_with(f.path, n.path || '/'))""",
)
def paths_in_scope(spark, sf_dir):
    paths = inputs.files(spark, sf_dir).select("path")
    return maintenance.paths_in_scope(paths, nested_locations(spark, sf_dir))


@query(
    "upsert_files",
    f"""WITH {sqltext.FILES}, {OLD_FILES},
        fresh AS (
          SELECT * FROM files WHERE path NOT IN (SELECT path FROM old_files)),
        ids AS (
          SELECT file_id, path FROM old_files
          UNION ALL
          SELECT (SELECT max(file_id) FROM old_files)
                   + row_number() OVER (ORDER BY substr(md5(path), 1, 3), path), path FROM fresh)
        SELECT ids.file_id, f.path, location_id, file_type, content_hash, mtime, size_bytes,
               'pending' AS status
        FROM files f JOIN ids ON ids.path = f.path""",
)
def upsert_files(spark, sf_dir):
    """All files written over the old table twice; the second time counts."""
    scanned = inputs.files(spark, sf_dir).drop("file_id")
    first = scanned.withColumn("status", F.lit("skipped")).withColumn("version", F.lit(1))
    second = scanned.withColumn("status", F.lit("pending")).withColumn("version", F.lit(2))
    return maintenance.upsert_by_key(
        old_files(spark, sf_dir), second.unionByName(first), "path", "file_id", "version"
    )


_REPLACED = f"""{sqltext.FILES}, {OLD_FILES}, {_STATES}, {sqltext.chunks()},
owners AS (SELECT file_id FROM states WHERE state = 'changed')"""


@query(
    "replace_chunks",
    f"""WITH {_REPLACED}
        SELECT chunk_id, file_id, ord, snippet FROM chunks
        WHERE file_id NOT IN (SELECT file_id FROM owners)
        UNION ALL
        SELECT file_id * 16777216, file_id, CAST(0 AS INTEGER), 'replaced ' || file_id FROM owners""",
)
def replace_chunks(spark, sf_dir):
    """Chunks of changed files give way to one new chunk each."""
    owners = written(detect_changes(spark, sf_dir).filter(F.col("state") == "changed").select("file_id"), "owners")
    new = owners.select(
        chunk_id(F.col("file_id"), F.lit(0)).alias("chunk_id"),
        "file_id",
        F.lit(0).alias("ord"),
        F.concat(F.lit("replaced "), F.col("file_id").cast("string")).alias("snippet"),
    )
    base = inputs.index(spark, sf_dir).chunks.select("chunk_id", "file_id", "ord", "snippet")
    return maintenance.replace_by_owner(base, new, owners)


def _ids(table, name, column):
    return table.select(F.lit(name).alias("kind"), F.col(column).alias("id"))


def _left_over(files, chunks):
    return _ids(files, "file", "file_id").unionByName(_ids(chunks, "chunk", "chunk_id"))


@query(
    "add_location",
    f"""WITH {_NESTED},
        fresh AS (SELECT DISTINCT path || '/' AS path, enabled FROM nested WHERE location_id >= 1000)
        SELECT location_id, path, enabled, added_at FROM locations
        UNION ALL
        SELECT (SELECT max(location_id) FROM locations)
                 + row_number() OVER (ORDER BY substr(md5(path), 1, 3), path),
               path, enabled, 99.0::DOUBLE FROM fresh""",
)
def add_location(spark, sf_dir):
    """The inner folders become locations; the sources are locations already."""
    return maintenance.list_locations(
        maintenance.add_locations(locations(spark, sf_dir), nested_locations(spark, sf_dir), 99.0)
    )


REMOVED = [0, 5, 10, 19]


@query(
    "remove_location",
    f"""WITH {sqltext.FILES}, {LOCATIONS}, {sqltext.chunks()},
        staying AS (SELECT file_id FROM files WHERE location_id NOT IN (0, 5, 10, 19))
        SELECT 'file' AS kind, file_id AS id FROM staying
        UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM staying)
        UNION ALL SELECT 'location', location_id FROM locations
                  WHERE location_id NOT IN (0, 5, 10, 19)""",
)
def remove_location(spark, sf_dir):
    index = inputs.index(spark, sf_dir)
    files, chunks, kept = maintenance.remove_location(
        index.files, index.chunks, locations(spark, sf_dir), REMOVED
    )
    return _left_over(files, chunks).unionByName(_ids(kept, "location", "location_id"))


@query(
    "purge_missing",
    f"""WITH {sqltext.FILES}, {LOCATIONS}, {sqltext.chunks()},
        staying AS (
          SELECT file_id FROM files JOIN locations USING (location_id)
          WHERE NOT enabled OR file_id IN (SELECT doc_id FROM labels))
        SELECT 'file' AS kind, file_id AS id FROM staying
        UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM staying)""",
)
def purge_missing(spark, sf_dir):
    """A scan of the enabled locations that finds the labelled documents only."""
    index = inputs.index(spark, sf_dir)
    return _left_over(
        *maintenance.purge_missing(index.files, index.chunks, old_files(spark, sf_dir), locations(spark, sf_dir))
    )


@query(
    "set_status",
    f"""WITH {sqltext.FILES}
        SELECT file_id, path, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'pending'
               ELSE status END AS status
        FROM files LEFT JOIN labels ON doc_id = file_id""",
)
def set_status(spark, sf_dir):
    updates = (
        inputs.table(spark, sf_dir, "labels")
        .filter((F.col("toxic") == 1) | (F.col("quality") == 0))
        .select(
            F.col("doc_id").alias("file_id"),
            F.when(F.col("toxic") == 1, "error").otherwise("pending").alias("status"),
        )
    )
    files = inputs.files(spark, sf_dir)
    return maintenance.set_attribute(files, updates, "file_id", "status").select(
        "file_id", "path", "status"
    )


@query(
    "index_status",
    f"""WITH {sqltext.FILES}
        SELECT file_id, CASE WHEN doc_id IS NULL OR coalesce(file_type, '') NOT IN ('text', 'code', 'pdf')
                             THEN 'skipped' WHEN quality = 0 THEN 'error' ELSE 'indexed' END AS status
        FROM files LEFT JOIN labels ON doc_id = file_id""",
)
def index_status(spark, sf_dir):
    """All documents are known files, none indexed yet. Those with a label exist; those of poor quality cannot be read."""
    known = inputs.files(spark, sf_dir).withColumn("status", F.lit("pending")).withColumn("content_hash", F.lit(""))
    labels = inputs.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    texts = inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text")
    rows = known.join(texts, "file_id").join(labels, F.col("file_id") == F.col("labelled"), "left")
    error = F.when(F.col("labelled").isNull(), "file_not_found").when(F.col("quality") == 0, "read_failed")
    scan = rows.select("path", "mtime", "size_bytes", F.when(error.isNull(), F.col("text").cast("binary")).alias("content"), error.alias("error"))
    batch = index_batch(
        scan, known.withColumn("gist", F.lit("")).withColumn("indexed_at", F.lit(0.0)), locations(spark, sf_dir),
        file_type_settings(spark), now=0.0, record_skipped=True,
    )
    return batch.files.select("file_id", "status")


@query(
    "retry_batch",
    f"""WITH {sqltext.FILES}, {sqltext.chunks()}, {SHEETS},
        texts AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents),
        slices AS (
          SELECT doc_id, len(list_filter(list_transform(range(0, length(content), 1000),
                   lambda o: {sqltext.strip('substr(content, o + 1, 1000)')}),
                   lambda p: p <> '')[1:150]) AS n FROM texts)
        SELECT f.file_id, path, 'indexed' AS status, sha256(content) AS content_hash,
               CASE file_type WHEN 'code' THEN n
                 WHEN 'pdf' THEN (SELECT count(*) FROM sheet_chunks s WHERE s.file_id = f.file_id)
                 ELSE (SELECT count(*) FROM chunks c WHERE c.file_id = f.file_id) END AS n_chunks
        FROM files f JOIN texts ON texts.doc_id = f.file_id JOIN slices ON slices.doc_id = f.file_id
        WHERE status = 'error' AND file_type IN ('text', 'code', 'pdf')""",
)
def retry_batch_query(spark, sf_dir):
    """The files whose indexing failed are read and indexed again."""
    known = inputs.files(spark, sf_dir).withColumn("gist", F.lit("")).withColumn("indexed_at", F.lit(0.0))
    contents = scanned(spark, sf_dir).select("path", "content")
    batch = retry_batch(
        known, locations(spark, sf_dir), file_type_settings(spark), now=1.0,
        read=lambda listing: listing.join(contents, "path"), pages=_pages(spark, sf_dir),
    )
    counts = maintenance.chunk_counts(batch.chunks)
    return batch.files.join(counts, "file_id", "left").select(
        "file_id", "path", "status", "content_hash", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks")
    )


@query(
    "index_stats",
    f"""WITH {sqltext.FILES}, {LOCATIONS}, {sqltext.chunks()}
        SELECT count(*) AS files_total, count(*) FILTER (status = 'indexed') AS files_indexed,
               count(*) FILTER (status = 'pending') AS files_pending,
               count(*) FILTER (status = 'error') AS files_error,
               (SELECT count(*) FROM chunks) AS chunks_total,
               (SELECT count(*) FROM locations) AS locations_total,
               (SELECT count(*) FROM locations WHERE enabled) AS locations_enabled
        FROM files""",
)
def index_stats(spark, sf_dir):
    index = inputs.index(spark, sf_dir)
    return maintenance.index_stats(index.files, index.chunks, locations(spark, sf_dir))


@query(
    "chunk_counts",
    f"WITH {sqltext.chunks()} SELECT file_id, count(*) AS n_chunks FROM chunks GROUP BY file_id",
)
def chunk_counts(spark, sf_dir):
    return maintenance.chunk_counts(inputs.index(spark, sf_dir).chunks)


@query(
    "indexable_files",
    f"""WITH {sqltext.FILES} SELECT path, file_type FROM files
        WHERE file_type IN ('text', 'code', 'pdf')""",
)
def indexable_files(spark, sf_dir):
    scan = inputs.files(spark, sf_dir).select("path")
    return filters.indexable_files(scan, file_type_settings(spark)).select("path", "file_type")


@query(
    "files_by_location",
    f"WITH {sqltext.FILES} SELECT {FILE_COLUMNS} FROM files WHERE location_id = 3 ORDER BY path",
)
def files_by_location(spark, sf_dir):
    return filters.files_by_location(inputs.files(spark, sf_dir), 3)


def _plant(folder: str):
    """Write each row's content under its path below the folder; rows pass through."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(folder + path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(content)
            yield batch.select(["path"])

    return run


@query(
    "scan_files",
    f"""WITH {sqltext.FILES},
        planted AS (
          SELECT regexp_replace(path, '/d([0-9]+[.])', CASE WHEN file_id % 50 = 7 THEN '/_d' WHEN file_id % 50 = 11
                   THEN '/.d' ELSE '/d' END || '\\1') AS path, file_type AS category,
                 CASE WHEN file_id % 97 = 0 THEN '' ELSE text END AS content
          FROM files JOIN documents ON doc_id = file_id)
        SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes, sha256(content) AS content_hash,
               sha256(content) AS streamed_hash, category FROM planted""",
)
def scan_document_files(spark, sf_dir):
    """Documents as a tree of files, some of them empty or with names that Spark's own listing leaves out."""
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    mark = F.when(F.col("file_id") % 50 == 7, "/_d").when(F.col("file_id") % 50 == 11, "/.d").otherwise("/d")
    text = F.when(F.col("file_id") % 97 == 0, "").otherwise(F.col("text"))
    planted = (
        inputs.files(spark, sf_dir)
        .select("file_id", "path")
        .join(inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text"), "file_id")
        .select(
            F.regexp_replace("path", F.lit("/d([0-9]+[.])"), F.concat(mark, F.lit("$1"))).alias("path"),
            text.cast("binary").alias("content"),
        )
    )
    planted.mapInArrow(_plant(folder), "path string").write.format("noop").mode("overwrite").save()
    listing = list_files(spark, [folder])
    hashes = read_hashes(listing).select("path", F.col("content_hash").alias("streamed_hash"))
    return (
        read_contents(listing)
        .join(hashes, "path")
        .select(
            F.replace("path", F.lit(folder), F.lit("")).alias("path"),
            "size_bytes",
            F.sha2("content", 256).alias("content_hash"),
            "streamed_hash",
            category_of(F.col("path")).alias("category"),
        )
    )


@query(
    "refresh_scope",
    f"""WITH {sqltext.FILES}, {LOCATIONS},
        known AS (
          SELECT files.*, enabled, text, coalesce(toxic, 0) = 1 AS gone, coalesce(quality, 1) = 0 AS changed
          FROM files JOIN locations USING (location_id) JOIN documents d ON d.doc_id = file_id
          LEFT JOIN labels l ON l.doc_id = file_id)
        SELECT file_id, path, location_id,
               CASE WHEN due THEN sha256(text || CASE WHEN changed THEN chr(10) || 'changed' ELSE '' END)
                 ELSE content_hash END AS content_hash,
               CASE WHEN due THEN 'indexed' ELSE status END AS status
        FROM (SELECT *, enabled AND file_type IN ('text', 'code', 'pdf') AS due FROM known WHERE NOT (enabled AND gone))""",
)
def refresh_scope(spark, sf_dir):
    """All documents are known; every third location is switched off. Of the others the toxic documents are gone and those
    of poor quality have changed. What the scan did not look for stays as it was."""
    where = locations(spark, sf_dir)
    labels = inputs.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")
    known = (
        inputs.files(spark, sf_dir)
        .withColumn("gist", F.lit(""))
        .withColumn("indexed_at", F.lit(0.0))
        .select(*FILES.fieldNames())
    )
    text = inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text")
    scan = (
        known.join(where.filter("enabled").select("location_id"), "location_id", "left_semi")
        .join(text, "file_id")
        .join(labels, "file_id", "left")
        .filter(F.coalesce("toxic", F.lit(0)) == 0)
        .select(
            "path", "mtime", "size_bytes",
            F.when(F.col("quality") == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
            .cast("binary").alias("content"),
        )
    )
    files, _ = refresh(written(scan, "scan"), known, spark.createDataFrame([], CHUNKS), where, file_type_settings(spark), now=1.0)
    return files.select("file_id", "path", "location_id", "content_hash", "status")


@query(
    "cut_in_pieces",
    f"""SELECT 'text' AS kind, file_id, ord, snippet, position_meta
        FROM (WITH {sqltext.chunks()} SELECT file_id, ord, snippet, position_meta FROM chunks)
        UNION ALL
        SELECT 'code', file_id, ord, snippet, position_meta FROM ({CODE_CHUNKS})""",
)
def cut_in_pieces(spark, sf_dir):
    """Every document as a text file and as a source file, read a thousand bytes at a time."""
    folder = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    for kind, rows in (("text", inputs.paragraphs(spark, sf_dir)), ("code", inputs.code(spark, sf_dir))):
        planted = rows.select("path", F.col("content").cast("binary").alias("content"))
        planted.mapInArrow(_plant(f"{folder}/{kind}"), "path string").write.format("noop").mode("overwrite").save()
    cut = cut_files(list_files(spark, [folder]), piece_bytes=1000)
    return cut.select(
        F.regexp_extract("path", "/(text|code)/d[0-9]+[.][a-z]+$", 1).alias("kind"),
        F.regexp_extract("path", "/d([0-9]+)[.][a-z]+$", 1).cast("long").alias("file_id"),
        F.posexplode("chunks").alias("ord", "c"),
    ).select("kind", "file_id", "ord", "c.snippet", "c.position_meta")


def scanned(spark, sf_dir):
    """Documents as a scan of files with contents, lines set apart by blank lines."""
    content = F.replace("text", F.lit("\n"), F.lit("\n\n")).cast("binary").alias("content")
    return inputs.files(spark, sf_dir, content).filter("file_id IS NOT NULL").select("path", "mtime", "size_bytes", "content")


def _pages(spark, sf_dir):
    """The pages of the paged files: (path, page_no, page_text)."""
    return inputs.sheets_by(spark, sf_dir, "path")


@query(
    "index_roundtrip",
    f"""WITH {sqltext.FILES}, {sqltext.chunks()}, {SHEETS},
        numbered_files AS (
          SELECT *, row_number() OVER (ORDER BY substr(md5(path), 1, 3), path) AS new_id
          FROM files WHERE file_type IN ('text', 'code', 'pdf')),
        texts AS (
          SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents),
        counted AS (SELECT file_id, count(*) AS n_chunks FROM chunks GROUP BY file_id),
        slices AS (
          SELECT doc_id, len(list_filter(list_transform(range(0, length(content), 1000),
                   lambda o: {sqltext.strip('substr(content, o + 1, 1000)')}),
                   lambda p: p <> '')[1:150]) AS n FROM texts)
        SELECT new_id AS file_id, path, file_type, sha256(content) AS content_hash,
               CASE file_type WHEN 'code' THEN {sqltext.truncate('content', 300)}
                 WHEN 'pdf' THEN coalesce(
                   (SELECT CASE WHEN leads <> '' THEN {sqltext.truncate('leads', 300, 'h')} END
                    FROM sheet_gists g WHERE g.file_id = f.file_id),
                   (SELECT k.snippet FROM sheet_chunks s WHERE s.file_id = f.file_id AND s.ord = 0), '')
                 ELSE (SELECT {sqltext.truncate(
                   "coalesce(list_filter(ps, lambda p: length(p) > 50)[1], ps[1])", 300, 'g')}
                   FROM paras WHERE paras.doc_id = f.file_id) END AS gist,
               'indexed' AS status,
               CASE file_type WHEN 'code' THEN n
                 WHEN 'pdf' THEN (SELECT count(*) FROM sheet_chunks s WHERE s.file_id = f.file_id)
                 ELSE coalesce(n_chunks, 0) END AS n_chunks
        FROM numbered_files f JOIN texts ON texts.doc_id = f.file_id
        LEFT JOIN counted ON counted.file_id = f.file_id JOIN slices ON slices.doc_id = f.file_id""",
)
def index_roundtrip(spark, sf_dir):
    """Index all documents into empty tables on disk and read them back."""
    tables = IndexTables(spark, f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}", 8, 4)
    tables.create()
    batch = index_batch(
        scanned(spark, sf_dir),
        tables.files(),
        locations(spark, sf_dir),
        file_type_settings(spark),
        now=0.0,
        pages=_pages(spark, sf_dir),
    )
    tables.apply(batch)
    return (
        tables.files()
        .join(maintenance.chunk_counts(tables.chunks()), "file_id", "left")
        .select(
            "file_id", "path", "file_type", "content_hash", "gist", "status",
            F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"),
        )
    )
