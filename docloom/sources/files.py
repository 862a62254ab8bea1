"""Scanning folder trees.

Spark's own file listing leaves out empty files and every name that starts with an underscore or a
dot, and with them each ``__init__.py``. Here tasks list the folders, one level of the tree after
the other, and read the files; the driver sees neither.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.maintenance import list_locations
from docloom.sources.sizes import written

# Here a row holds a whole file, and Spark's rows end at two gigabytes: a larger one gets the error ``too_large``. Indexing a listing reads
# large files in pieces instead, see ``large_files``; hashes are taken block by block, whatever the size.
MAX_FILE_BYTES = 1 << 30
HASH_BYTES = 1 << 20
# Contents handed over at a time.
BATCH_BYTES = 64 * 1024 * 1024

_LISTED = "path string, is_folder boolean, mtime double, size_bytes long, error string"
_READ = "path string, mtime double, size_bytes long, content binary, error string"
_HASHED = "path string, mtime double, size_bytes long, content_hash string, error string"


def _reason(error: OSError) -> str:
    return "file_not_found" if isinstance(error, FileNotFoundError) else f"read_failed: {type(error).__name__}"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch["path"].to_pylist():
            system, inner = fs.FileSystem.from_uri(folder)
            prefix = folder[: len(folder) - len(inner)]
            error, found = None, []
            try:
                found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            except OSError as e:
                error = _reason(e)
            # A link to a folder may lead back up the tree; files behind links are read.
            kept = [
                info
                for info in found
                if info.is_file or (info.type == fs.FileType.Directory and not os.path.islink(info.path))
            ]
            rows = [(prefix + i.path, not i.is_file, (i.mtime_ns or 0) / 1e9, i.size or 0, None) for i in kept]
            if error:
                rows.append((folder, False, 0.0, 0, error))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["path", "is_folder", "mtime", "size_bytes", "error"],
            )


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every file below the roots: path, mtime, size_bytes, error. One small job per level of the tree.

    A folder that cannot be listed is a row of its own, with the reason in ``error``."""
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(root.rstrip("/") or "/",) for root in set(roots)], "path string")
    files = spark.createDataFrame([], _LISTED)
    while not level.isEmpty():
        listed = written(level.repartition(tasks).mapInArrow(_list_folders, _LISTED), "listing")
        files = files.unionByName(listed.filter(~F.col("is_folder")))
        level = listed.filter("is_folder").select("path")
    # Roots may lie inside one another.
    return files.drop("is_folder").dropDuplicates(["path"])


def _reader(max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(path: str, size: int) -> tuple[bytes | None, str | None]:
        if size > max_bytes:
            return None, "too_large"
        try:
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_stream(inner) as stream:
                return stream.read(), None
        except OSError as e:
            return None, _reason(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors, start, held = [], [], 0, 0
            sizes = batch["size_bytes"].to_pylist()
            for i, (path, size) in enumerate(zip(batch["path"].to_pylist(), sizes, strict=True)):
                content, error = read(path, size)
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(contents))
                    part = part.append_column("content", pa.array(contents, pa.binary()))
                    yield part.append_column("error", pa.array(errors, pa.string()))
                    contents, errors, start, held = [], [], i + 1, 0

    return run


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, errors = [], []
        for path in batch["path"].to_pylist():
            digest, error = hashlib.sha256(), None
            try:
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner) as stream:
                    while block := stream.read(HASH_BYTES):
                        digest.update(block)
            except OSError as e:
                error = _reason(e)
            hashes.append(None if error else digest.hexdigest())
            errors.append(error)
        batch = batch.append_column("content_hash", pa.array(hashes, pa.string()))
        yield batch.append_column("error", pa.array(errors, pa.string()))


def read_contents(listing: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Add ``content`` to listed files, or NULL and the reason in ``error``; a file's failure is its own."""
    rows = listing.select("path", "mtime", "size_bytes")
    return rows.mapInArrow(_reader(max_bytes), _READ)


def read_hashes(listing: DataFrame) -> DataFrame:
    """Add ``content_hash`` to listed files of any size, or NULL and the reason in ``error``. No contents are held."""
    return listing.select("path", "mtime", "size_bytes").mapInArrow(_hash_files, _HASHED)


def scan_files(
    spark: SparkSession, roots: list[str], max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Every file below the roots: path, mtime, size_bytes, content, error."""
    listing = list_files(spark, roots)
    closed = listing.filter("error IS NOT NULL").withColumn("content", F.lit(None).cast("binary"))
    return read_contents(listing.filter("error IS NULL"), max_bytes).unionByName(closed)


def enabled_roots(locations: DataFrame) -> list[str]:
    """Paths of the enabled locations, in the order they were added."""
    rows = list_locations(locations.filter("enabled")).select("path").collect()
    return [row.path for row in rows]
