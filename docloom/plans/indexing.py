"""Indexing a batch of scanned files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import category_of, content_hash, decode_text
from docloom.operators.chunking import explode_chunks, extract_all
from docloom.operators.embedding import EmbedFn, embed, hash_embed
from docloom.operators.filters import indexable_files, with_indexable
from docloom.operators.maintenance import (
    assign_location,
    detect_changes,
    index_status,
    missing_paths,
    remove_paths,
    replace_by_owner,
    retry_jobs,
    with_ids,
)
from docloom.schemas import CHUNKS, EMBED_DIM, FILES, PAGE_CHUNK_CAP, TEXT_CHUNK_CAP
from docloom.sources.large_files import cut_files
from docloom.sources.sizes import MAX_BROADCAST_ROWS, written

#: Files of more bytes are not held whole.
LARGE_BYTES = 64 << 20

#: Contents that a scan holds are cut before their files are looked up, if the list of those due is long and holds at least this share of the scan.
MOSTLY_DUE = 0.9

#: From listed files to the same with contents, or with hashes.
ReadFn = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Batch:
    """The rows a batch adds or replaces, and the files they belong to."""

    files: DataFrame
    chunks: DataFrame
    #: The chunks without their vectors, and what adds these: who moves chunks can move them without.
    cut: DataFrame | None = None
    add_vectors: Callable[[DataFrame], DataFrame] | None = None


def _seen(indexable: DataFrame, read: ReadFn | None, hashes: ReadFn | None) -> DataFrame:
    """Path, times and hash of every file, and what went wrong with it."""
    if hashes is not None:
        rows = hashes(indexable)
    else:
        rows = read(indexable) if read is not None else indexable
        rows = rows.withColumn("content_hash", content_hash(F.col("content")))
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    unread = F.when(F.col("content_hash").isNull(), F.lit("too_large"))
    return rows.select(
        "path",
        category_of(F.col("path")).alias("file_type"),
        "mtime",
        "size_bytes",
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce(error, unread).alias("failure"),
    )


def _passed_over(scan: DataFrame, files: DataFrame, settings: DataFrame) -> DataFrame:
    """Files of categories that are not indexed, but those known to be skipped already."""
    passed = with_indexable(scan.select("path", "mtime", "size_bytes"), settings).filter("obstacle IS NOT NULL")
    known = files.select("path", "file_id", F.col("status").alias("_status"))
    rows = passed.join(known, "path", "left").filter(~F.col("_status").eqNullSafe("skipped"))
    return rows.withColumn("content_hash", F.lit("")).withColumnRenamed("obstacle", "failure")


def index_batch(
    scan: DataFrame,
    files: DataFrame,
    locations: DataFrame,
    settings: DataFrame,
    *,
    now: float,
    read: ReadFn | None = None,
    hashes: ReadFn | None = None,
    pages: DataFrame | None = None,
    embed_fn: EmbedFn = hash_embed,
    dim: int = EMBED_DIM,
    cap: int | None = TEXT_CHUNK_CAP,
    page_cap: int | None = PAGE_CHUNK_CAP,
    record_skipped: bool = False,
    large_bytes: int = LARGE_BYTES,
) -> Batch:
    """Turn scanned files (path, mtime, size_bytes, content) into file and chunk rows.

    ``read`` adds the contents where the scan is a mere listing, ``hashes`` their hashes alone. Every file is hashed
    once, and what came of it is written; only new, changed and unfinished files are read again, cut and embedded.
    What decides that is a join of paths and hashes; the list of files due is written, and sent to
    the scan when it is short, so that contents are not shuffled. When it is long, and nearly all of a scan with contents is due, these are cut
    where they are and only what was cut is shuffled. ``pages`` (path, page_no, page_text) holds the
    texts of paged files. Vectors are computed last and pass through no further join.

    Files of more than ``large_bytes`` that ``read`` would have to hold whole are read in pieces and cut as they pass, to the same result.

    ``cap`` and ``page_cap`` bound the chunks of a file; None keeps all. A file that fails is a row of status ``error``; one that has vanished is ``skipped`` if it was known.
    With ``record_skipped``, files of unsupported and disabled categories are rows of status ``skipped`` as well, whose contents are not read.
    """
    if "error" in scan.columns and "content" not in scan.columns:
        scan = scan.filter("error IS NULL").drop("error")  # folders that could not be listed
    indexable = indexable_files(scan, settings)
    seen = written(_seen(indexable, read, hashes), "seen-files")
    states = detect_changes(seen, files.select("path", "file_id", "content_hash", "mtime", "status"))
    vanished = F.col("failure").eqNullSafe("file_not_found")
    due = states.filter((F.col("state") != "unchanged") & ~(vanished & F.col("file_id").isNull())).drop("state")
    if record_skipped:
        due = due.unionByName(_passed_over(scan, files, settings).select(*due.columns))
    todo = written(
        assign_location(with_ids(due, files, "path", "file_id"), locations), "files-to-read"
    )
    readable = todo.filter(F.col("failure").isNull()).select("path", "file_id")
    n_readable = readable.count()
    if n_readable <= MAX_BROADCAST_ROWS:
        readable = F.broadcast(readable)
    cut_first = read is None and n_readable > max(MAX_BROADCAST_ROWS, MOSTLY_DUE * seen.count())
    due_files = indexable if cut_first else indexable.join(readable.select("path"), "path", "left_semi")
    is_paged = category_of(F.col("path")).eqNullSafe("pdf")
    paged = due_files.filter(is_paged).select("path", category_of(F.col("path")).alias("file_type"), F.lit(None).cast("string").alias("late"))
    due_files = due_files.filter(~is_paged)
    large: DataFrame | None = None
    if read is not None:
        large = cut_files(due_files.filter(F.col("size_bytes") > large_bytes), cap).join(readable, "path")
        due_files = read(due_files.filter(F.col("size_bytes") <= large_bytes))
    unreadable = F.col("content").isNull()
    late = F.col("error") if "error" in due_files.columns else F.lit(None).cast("string")
    texts = due_files.select(
        "path",
        category_of(F.col("path")).alias("file_type"),
        F.coalesce(decode_text(F.col("content")), F.lit("")).alias("content"),
        F.when(unreadable, F.coalesce(late, F.lit("too_large"))).alias("late"),
    )
    if pages is not None:
        pages = pages.join(readable, "path").select("file_id", "page_no", "page_text")
    owned = texts if cut_first else texts.join(readable, "path")
    cut = extract_all(
        owned, pages, paged=paged.join(readable, "path"), cap=cap, page_cap=page_cap, owners=readable if cut_first else None
    )
    if large is not None:
        late = large.withColumnRenamed("error", "late").withColumn("error", F.lit(None).cast("string"))
        cut = cut.unionByName(late.select(*cut.columns))
    extracted = written(cut, "extracted", compression="zstd")

    done = todo.join(extracted.select("path", "gist", "error", "late"), "path", "left")
    error = F.coalesce("failure", "late", "error")
    file_rows = done.select(
        "file_id",
        "path",
        "location_id",
        "file_type",
        "content_hash",
        "mtime",
        "size_bytes",
        "gist",
        F.lit(now).alias("indexed_at"),
        index_status(~F.coalesce(error.isin("file_not_found", "disabled"), F.lit(False)), F.col("file_type"), error).alias("status"),
    )
    chunk_rows = explode_chunks(extracted.filter("late IS NULL"))

    def add_vectors(rows: DataFrame) -> DataFrame:
        return embed(rows, "snippet", embed_fn, dim)

    return Batch(
        file_rows.select(*FILES.fieldNames()), add_vectors(chunk_rows).select(*CHUNKS.fieldNames()), chunk_rows, add_vectors
    )


def retry_batch(files: DataFrame, locations: DataFrame, settings: DataFrame, **options) -> Batch:
    """Index the files again whose indexing failed; ``read`` is needed among the options."""
    known = files.select("path", "mtime", "size_bytes")
    return index_batch(known.join(retry_jobs(files).select("path"), "path", "left_semi"), files, locations, settings, **options)


def apply_batch(
    batch: Batch, files: DataFrame, chunks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The file and chunk tables after a batch."""
    owners = batch.files.select("file_id")
    return (
        replace_by_owner(files, batch.files, owners),
        replace_by_owner(chunks, batch.chunks, owners),
    )


def refresh(
    scan: DataFrame,
    files: DataFrame,
    chunks: DataFrame,
    locations: DataFrame,
    settings: DataFrame,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Bring both tables to the state of a scan of the enabled locations: read what is due, remove what is gone.

    Files of disabled locations stay: these are left out of searches, not of the index."""
    batch = index_batch(scan, files, locations, settings, **options)
    new_files, new_chunks = apply_batch(batch, files, chunks)
    return remove_paths(new_files, new_chunks, missing_paths(files, scan, locations))
