"""Change detection by digests of folders.

A folder's digest says what its files and folders are: it is made of the digests of what lies directly in it, level by level from the deepest, and
sums are used that need no order, so that no folder's entries are ever gathered. Two trees are compared from the top: where digests are
equal nothing below differs, and nothing below is looked at again; only files of folders that differ are joined with the known ones. A tree is
kept with the index, so that an unchanged scan costs one pass over its own listing and one row of the stored tree.

Files are equal here if path, content hash and time are exactly the same and the known file was indexed: less than what counts as unchanged, so
what is skipped is unchanged, and all else is decided by ``detect_changes``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.maintenance import detect_changes
from docloom.sources.sizes import MAX_BROADCAST_ROWS, fits, written

_TREE = "folder string, parent string, depth int, n long, x1 long, x2 long, s decimal(38,0)"


@dataclass
class Looked:
    """What a comparison looked at: folders on both sides, and files that were joined."""

    folders: int = 0
    files: int = 0
    levels: int = 0


def folder_of(path: Column) -> Column:
    """The folder that a path lies in; '' for what has no slash but a leading one or none at all. The root has no folder."""
    return F.when(path == "", F.lit(None).cast("string")).otherwise(F.regexp_replace(path, r"/?[^/]*\z", ""))


def depth_of(folder: Column) -> Column:
    """How many folders are above a folder."""
    slashes = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))
    return F.when(folder.startswith("/") | (folder == ""), slashes).otherwise(slashes + 1)


def _digest(*parts: Column) -> list[Column]:
    """Aggregates of a set of entries, each given by some values: their number, two exclusive ors of hashes, and a sum of another.

    Repeated entries leave the exclusive ors but not the number and the sum."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(F.lit(1), *parts)).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(2), *parts)).alias("x2"),
        F.sum(F.xxhash64(F.lit(3), *parts).cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"),
    ]


def folder_tree(files: DataFrame) -> DataFrame:
    """The digests of all folders (folder, parent, depth, n, x1, x2, s) of files (path, content_hash, mtime), written.

    ``files`` of the index also have ``status``: one that was not indexed equals no scanned file."""
    status = F.col("status") if "status" in files.columns else F.lit("indexed")
    entries = files.select(
        folder_of(F.col("path")).alias("folder"),
        F.xxhash64("path", F.coalesce("content_hash", F.lit("")), F.coalesce("mtime", F.lit(0.0)).cast("double"), status).alias("entry"),
    ).filter("folder IS NOT NULL")
    own = written(entries.withColumn("depth", depth_of(F.col("folder"))).groupBy("folder", "depth").agg(*_digest(F.lit("file"), F.col("entry"))), "folder-files")
    deepest = own.agg(F.max("depth")).first()[0]
    tree: DataFrame | None = None
    above: DataFrame | None = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = own.filter(F.col("depth") == level).drop("depth")
        if above is not None:
            # What lies below counts as one entry for each folder.
            folders = above.groupBy(F.col("parent").alias("folder")).agg(*_digest(F.lit("folder"), *map(F.col, ("folder", "n", "x1", "x2", "s"))))
            here = here.unionByName(folders).groupBy("folder").agg(
                F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("s").cast("decimal(38,0)").alias("s")
            )
        rows = here.select("folder", folder_of(F.col("folder")).alias("parent"), F.lit(level).alias("depth"), "n", "x1", "x2", "s")
        above = written(rows, "folder-level")
        tree = above if tree is None else tree.unionByName(above)
    return tree if tree is not None else files.sparkSession.createDataFrame([], _TREE)


def differing_folders(new: DataFrame, old: DataFrame, looked: Looked | None = None) -> DataFrame:
    """Of two trees, the folders whose digests differ or that only one has: found from the top, below differing folders only."""
    spark = new.sparkSession
    tops = [t.agg(F.max("depth")).first()[0] for t in (new, old)]
    deepest = max((t for t in tops if t is not None), default=-1)
    values = ["n", "x1", "x2", "s"]
    found = spark.createDataFrame([], "folder string")
    frontier: DataFrame | None = None
    for level in range(deepest + 1):
        sides = [t.filter(F.col("depth") == level) for t in (new, old)]
        if frontier is not None:
            small = F.broadcast(frontier) if fits(frontier, MAX_BROADCAST_ROWS) else frontier
            sides = [t.join(small.withColumnRenamed("folder", "parent"), "parent", "left_semi") for t in sides]
        left, right = (t.select("folder", F.struct(*values).alias(c)) for t, c in zip(sides, ("a", "b"), strict=True))
        both = left.join(right, "folder", "full_outer")
        if looked is not None:
            looked.folders += both.count()
            looked.levels += 1
        frontier = written(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("folder"), "differing")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def detect_changes_tree(
    scan: DataFrame, files: DataFrame, known_tree: DataFrame | None = None, looked: Looked | None = None
) -> tuple[DataFrame, DataFrame]:
    """What ``detect_changes`` says of the files of a scan (path, mtime, size_bytes, content_hash) that are not unchanged, and the paths of known
    files that the scan does not have.

    ``known_tree`` is the tree of ``files``, kept since they were last written; without it, it is made."""
    known_tree = folder_tree(files) if known_tree is None else known_tree
    differing = written(differing_folders(folder_tree(scan), known_tree, looked), "differing-folders")
    hint = F.broadcast if fits(differing, MAX_BROADCAST_ROWS) else (lambda df: df)

    def in_differing(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_folder", folder_of(F.col("path"))).join(hint(differing.withColumnRenamed("folder", "_folder")), "_folder", "left_semi").drop("_folder")

    some, known = in_differing(scan), in_differing(files)
    if looked is not None:
        looked.files += some.count() + known.count()
    changes = detect_changes(some, known).filter(F.col("state") != "unchanged")
    gone = known.select("path").join(some.select("path"), "path", "left_anti")
    return changes, gone
