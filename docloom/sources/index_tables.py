"""The index as Parquet tables below one folder.

Files, chunks, postings, vocabulary and statistics are kept in folders by a hash of the file id, so that a batch rewrites
only the folders it touches; postings and vocabulary are further split by term, so that a search reads only the
folders of its words.

Nothing is ever overwritten. A batch writes its folders under a new version, and then one small file, the
manifest, that says which version of each folder counts. Until that file is there readers follow the one before; a batch
that fails leaves the index as it was, and running it again replaces what it had written.

Nothing is copied for a batch, however much of the index it leaves. A folder of files, chunks or postings is the sum of several versions, and
the files that a batch replaces or removes are listed as gone, which leaves out their rows of earlier versions. Vocabulary and statistics
are sums: a batch adds rows that count with signs what it adds and removes. Once much of a folder is gone, or it has many versions, a batch that
touches it writes it whole.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import fulltext
from docloom.operators.maintenance import without
from docloom.plans.indexing import Batch
from docloom.schemas import CHUNKS, FILE_TYPE_SETTINGS, FILES, LOCATIONS, POSTINGS
from docloom.sources.seeds import file_type_settings
from docloom.sources.sizes import broadcast_if_small, written

BUCKETS = 64
TERM_BUCKETS = 16

_STATS = T.StructType(
    [T.StructField("n_chunks", T.LongType()), T.StructField("n_tokens", T.LongType())]
)
_VOCABULARY = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("cf", T.LongType())]
)
_GONE = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("since", T.LongType())])
_SCHEMAS = {
    "files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "vocabulary": _VOCABULARY, "stats": _STATS, "gone": _GONE,
    "locations": LOCATIONS, "settings": FILE_TYPE_SETTINGS,
}
_FOLDERS = {
    "files": ["bucket"],
    "chunks": ["bucket"],
    "postings": ["bucket", "term_bucket"],
    "vocabulary": ["bucket", "term_bucket"],
    "stats": ["bucket"],
    "gone": ["bucket"],
}
#: Tables of which a bucket has several versions that count, each with rows of its own, and those whose versions are added up.
_GROWING = ("files", "chunks", "postings")
_SUMMED = ("vocabulary", "stats")
#: Nearly all of the index: their rows are dealt to several tasks a folder, and compressed more.
_LARGE = ("chunks", "postings")
#: A bucket of more versions is written whole, and so is one of which more files are gone than this share of those it holds.
MAX_VERSIONS = 16
MAX_GONE_SHARE = 0.5
#: Files that are listed as gone, altogether: rows of two numbers, which readers broadcast.
MAX_GONE = 1_000_000
#: Chunks whose postings one task sorts, some two million; so few chunks that buckets share a task.
CHUNKS_AT_ONCE = 100_000
FEW_CHUNKS = 10_000
#: Within a file, so that a search for a few terms skips the rest.
_SORTED = {"postings": ["term", "chunk_id"], "vocabulary": ["term"]}

#: What adds columns to rows that have been moved to their buckets.
Finish = Callable[[DataFrame], DataFrame]

#: Per table, the versions that count of each bucket; tables without buckets have bucket 0.
Manifest = dict[str, dict[int, list[int]]]


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class IndexTables:
    """The tables below ``root``. The numbers of buckets are chosen when the tables are created and kept with
    them; opening an index with other numbers than its own is an error."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int | None = None, term_buckets: int | None = None
    ):
        self.spark, self.root = spark, root
        self.buckets, self.term_buckets = buckets or BUCKETS, term_buckets or TERM_BUCKETS
        _, stored = self._latest()
        for name, asked in (("buckets", buckets), ("term_buckets", term_buckets)):
            if stored:
                if asked is not None and asked != stored[name]:
                    raise ValueError(f"the index has {stored[name]} {name}, not {asked}")
                setattr(self, name, stored[name])

    # Versions

    def _manifests(self) -> tuple[fs.FileSystem, str]:
        system, inner = fs.FileSystem.from_uri(self.root)
        return system, f"{inner}/manifest"

    def _latest(self) -> tuple[int, dict | None]:
        """The number and the content of the newest manifest; 0 and nothing before the first."""
        system, folder = self._manifests()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
        if not names:
            return 0, None
        with system.open_input_stream(f"{folder}/{names[-1]}") as stream:
            return int(names[-1].removesuffix(".json")), json.loads(stream.read())

    def _manifest(self) -> Manifest:
        _, stored = self._latest()
        if stored is None:
            raise ValueError(f"there is no index in {self.root}; create() makes one")
        # One version may stand alone, as in indexes written when there was no more than one.
        return {
            table: {int(b): v if isinstance(v, list) else [v] for b, v in rows.items()}
            for table, rows in stored["tables"].items()
        }

    def _commit(self, version: int, manifest: Manifest) -> None:
        """Make a version the one that counts, by one rename."""
        system, folder = self._manifests()
        system.create_dir(folder, recursive=True)
        content = {"buckets": self.buckets, "term_buckets": self.term_buckets, "tables": manifest}
        part = f"{folder}/.{uuid.uuid4().hex}.json"
        with system.open_output_stream(part) as out:
            out.write(json.dumps(content).encode())
        system.move(part, f"{folder}/{version:012d}.json")

    def _place(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/version={version}"

    def create(self, reset: bool = False) -> None:
        """Make empty tables and the default settings; existing ones stay unless ``reset``."""
        version, stored = self._latest()
        if stored is not None and not reset:
            return
        version += 1
        self.spark.createDataFrame([], LOCATIONS).write.mode("overwrite").parquet(self._place("locations", version))
        file_type_settings(self.spark).write.mode("overwrite").parquet(self._place("settings", version))
        self._commit(version, {"locations": {0: [version]}, "settings": {0: [version]}})

    def vacuum(self) -> None:
        """Delete what no longer counts: folders of older versions, and of batches that failed. Not while others read or write."""
        manifest = self._manifest()
        system, inner = fs.FileSystem.from_uri(self.root)
        for table in _SCHEMAS:
            wanted = {(v, b) for b, versions in manifest.get(table, {}).items() for v in versions}
            for version in system.get_file_info(fs.FileSelector(f"{inner}/{table}", allow_not_found=True)):
                number = int(version.base_name.removeprefix("version="))
                if number not in {v for v, _ in wanted}:
                    system.delete_dir(version.path)
                elif table in _FOLDERS:
                    for folder in system.get_file_info(fs.FileSelector(version.path)):
                        name = folder.base_name
                        if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in wanted:
                            system.delete_dir(folder.path)

    # Reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int")

    def _schema(self, table: str) -> T.StructType:
        folders = [T.StructField(name, T.IntegerType()) for name in ["version", *_FOLDERS[table]]]
        return T.StructType([*_SCHEMAS[table].fields, *folders])

    def _small(self, table: str) -> DataFrame:
        version = self._manifest()[table][0][0]
        return self.spark.read.schema(_SCHEMAS[table]).parquet(self._place(table, version))

    def locations(self) -> DataFrame:
        return self._small("locations")

    def settings(self) -> DataFrame:
        return self._small("settings")

    def _versions(self, manifest: Manifest, table: str, buckets: list[int] | None) -> DataFrame | None:
        """The rows of the versions that count, with their version; None if there are none."""
        by_version = defaultdict(list)
        for bucket, versions in manifest.get(table, {}).items():
            if buckets is None or bucket in buckets:
                for version in versions:
                    by_version[version].append(bucket)
        if not by_version:
            return None
        rows = self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/{table}")
        counts = [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in sorted(by_version.items())]
        return rows.filter(reduce(lambda a, b: a | b, counts))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, of all buckets or some."""
        manifest = self._manifest()
        rows = self._versions(manifest, table, buckets)
        if rows is None:
            return self.spark.createDataFrame([], self._schema(table)).drop("version")
        gone = self._versions(manifest, "gone", buckets) if table in _GROWING else None
        if gone is not None:
            # Bounded by MAX_GONE, however large the index is.
            gone = F.broadcast(gone.select("file_id", "since"))
            rows = rows.join(gone, (rows["file_id"] == gone["file_id"]) & (rows["version"] < gone["since"]), "left_anti")
        return rows.drop("version")

    def files(self) -> DataFrame:
        return self.read("files").drop("bucket")

    def chunks(self) -> DataFrame:
        return self.read("chunks").drop("bucket")

    def index(self) -> fulltext.Index:
        postings = self.read("postings").drop("bucket")
        vocabulary = _counted(self.read("vocabulary"), "term_bucket", "term").filter("df > 0")
        stats = self.read("stats").agg(
            F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
            F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        )
        average = F.col("n_tokens") / F.nullif(F.col("n_chunks"), F.lit(0))
        return fulltext.Index(
            postings, vocabulary, stats.withColumn("avg_len", average), self.term_buckets
        )

    # Writing

    def _pieces(self, table: str) -> int:
        """Parts that a folder's rows are dealt to when they are moved, so that a few folders occupy all cores."""
        folders = self.buckets * (self.term_buckets if "term_bucket" in _FOLDERS[table] else 1)
        return -(-2 * self.spark.sparkContext.defaultParallelism // folders) if table in _LARGE else 1

    def _piece(self, pieces: int) -> Column:
        return F.pmod(F.xxhash64("file_id", F.lit(1)), F.lit(pieces)).cast("int")

    def _dealt(self, chunks: DataFrame, n: int) -> DataFrame:
        """New chunks of this number by bucket, in parts whose postings can be sorted in memory."""
        placed = chunks.withColumn("bucket", self._bucket())
        if n <= FEW_CHUNKS:
            return placed.hint("rebalance", "bucket")
        pieces = max(self._pieces("chunks"), -(-n // (self.buckets * CHUNKS_AT_ONCE)))
        return placed.repartitionById(self.buckets * pieces, F.col("bucket") * pieces + self._piece(pieces))

    def _save(self, table: str, rows: DataFrame) -> None:
        version = self._latest()[0] + 1
        rows.write.mode("overwrite").parquet(self._place(table, version))
        self._commit(version, self._manifest() | {table: {0: [version]}})

    def save_locations(self, rows: DataFrame) -> None:
        self._save("locations", rows)

    def save_settings(self, rows: DataFrame) -> None:
        self._save("settings", rows)

    def remove(self, files: DataFrame) -> None:
        """Remove files (file_id) with their chunks and postings."""
        nothing = Batch(
            self.spark.createDataFrame([], FILES), self.spark.createDataFrame([], CHUNKS)
        )
        self.apply(nothing, files)

    def remove_locations(self, location_ids: list[int]) -> None:
        """Remove locations with everything below them, the locations themselves last."""
        leaving = F.col("location_id").isin(*location_ids) if location_ids else F.lit(False)
        leaving = F.coalesce(leaving, F.lit(False))
        self.remove(self.files().filter(leaving).select("file_id"))
        self.save_locations(self.locations().filter(~leaving))

    def apply(self, batch: Batch, removed: DataFrame | None = None) -> None:
        """Store a batch and drop the removed files (file_id), touching their buckets only.

        Chunks and postings of other files stay where they are, but in buckets that are due to be written whole."""
        owners = batch.files.select("file_id", F.lit(True).alias("added"))
        if removed is not None:
            owners = owners.unionByName(removed.select("file_id", F.lit(False).alias("added")))
        owners = written(
            owners.groupBy("file_id").agg(F.max("added").alias("added")).withColumn("bucket", self._bucket()), "owners"
        )
        added = {row.bucket: row.added for row in owners.groupBy("bucket").agg(F.max("added").alias("added")).collect()}
        touched = list(added)
        if not touched:
            return
        leaving = broadcast_if_small(owners.select("file_id"))
        version = self._latest()[0] + 1
        manifest = self._manifest()
        known = self.read("files", touched).select("file_id", "bucket")
        replaced = known.join(leaving, "file_id", "left_semi")
        whole = self._due(manifest, added, known, replaced)
        grown = [b for b in touched if b not in whole]

        def kept(table: str, buckets: list[int]) -> DataFrame | None:
            """What stays of some buckets; None if they hold nothing."""
            if not any(manifest.get(table, {}).get(bucket) for bucket in buckets):
                return None
            return without(self.read(table, buckets), leaving, "file_id")

        def store(
            table: str, rows: DataFrame, finish: Finish | None = None, mode: str = "overwrite", moved: bool = False
        ) -> DataFrame:
            """Write rows in folders; ``finish`` adds columns once they have been moved, if they are not yet, and sorted."""
            place = self._place(table, version)
            if not moved:
                pieces = self._pieces(table)
                if pieces > 1:
                    rows = rows.withColumn("_piece", self._piece(pieces))
                rows = rows.hint("rebalance", *_FOLDERS[table], *["_piece"][: pieces > 1])
            ordered = rows.sortWithinPartitions(*_FOLDERS[table], *_SORTED.get(table, ()))
            (
                (finish(ordered) if finish else ordered)
                .select(*_SCHEMAS[table].fieldNames(), *_FOLDERS[table])
                .write.mode(mode)
                .option("compression", "zstd" if table in _LARGE else "snappy")
                .partitionBy(*_FOLDERS[table])
                .parquet(place)
            )
            return self.spark.read.schema(self._schema(table)).parquet(place).drop("version")

        def after(table: str, new: DataFrame, finish: Finish | None = None, moved: bool = False) -> DataFrame:
            """Store new rows, and what stays of the buckets that are written whole: all rows of this version."""
            stored, staying = store(table, new, finish, moved=moved), kept(table, whole)
            return stored if staying is None else store(table, staying, mode="append")

        bare = batch.chunks if batch.cut is None else batch.cut
        chunks = after("chunks", bare.withColumn("bucket", self._bucket()), None if batch.cut is None else batch.add_vectors)
        # Texts are moved to their buckets, not the postings of their words, which are several times as large.
        texts = self._dealt(bare.select("chunk_id", "file_id", "snippet"), chunks.count())
        new_postings = (
            fulltext.postings(texts)
            .withColumn("bucket", self._bucket())
            .withColumn("term_bucket", fulltext.term_bucket(F.col("term"), self.term_buckets))
        )
        postings = after("postings", new_postings, moved=True)
        after("files", batch.files.withColumn("bucket", self._bucket()))

        # What was added and what has gone, by sign. Sums of many versions are added up once more, which looks at no chunk.
        folded = [b for b in grown if any(len(manifest.get(t, {}).get(b, [])) >= MAX_VERSIONS for t in _SUMMED)]
        plus, minus = F.lit(1).cast("long"), F.lit(-1).cast("long")
        keys = ["bucket", "term_bucket", "term"]
        words = postings.select(*keys, plus.alias("df"), F.col("tf").cast("long").alias("cf"))
        n_chunks = chunks.select("bucket", plus.alias("n_chunks"))
        if grown:
            left = self.read("chunks", grown).join(leaving, "file_id", "left_semi").select("chunk_id", "file_id", "snippet")
            lost = (
                fulltext.postings(left).withColumn("bucket", self._bucket())
                .withColumn("term_bucket", fulltext.term_bucket(F.col("term"), self.term_buckets))
            )
            words = words.unionByName(lost.select(*keys, minus.alias("df"), (-F.col("tf")).cast("long").alias("cf")))
            n_chunks = n_chunks.unionByName(left.select(self._bucket().alias("bucket"), minus.alias("n_chunks")))
        changes = _counted(words, *keys).filter("df <> 0 OR cf <> 0")
        if folded:
            changes = _counted(changes.unionByName(self.read("vocabulary", folded)), *keys).filter("df <> 0 OR cf <> 0")
        changes = store("vocabulary", changes)
        tokens = changes.select("bucket", F.lit(0).cast("long").alias("n_chunks"), F.col("cf").alias("n_tokens"))
        if folded:  # their tokens are all in the vocabulary, their chunks in the statistics
            known_sizes = self.read("stats", folded).select("bucket", "n_chunks")
            n_chunks = n_chunks.unionByName(known_sizes)
        sizes = n_chunks.withColumn("n_tokens", F.lit(0).cast("long")).unionByName(tokens)
        store("stats", sizes.groupBy("bucket").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")))
        if grown:
            now_gone = replaced.withColumn("since", F.lit(version).cast("long")).filter(F.col("bucket").isin(grown))
            listed = self.read("gone", grown).unionByName(now_gone)
            store("gone", listed.groupBy("file_id", "bucket").agg(F.max("since").alias("since")))
        for table in _FOLDERS:
            rows = manifest.setdefault(table, {})
            for bucket in touched:
                if table in _GROWING and bucket in grown:
                    rows[bucket] = [*rows.get(bucket, []), version] if added[bucket] else rows.get(bucket, [])
                elif table in _SUMMED and bucket in grown and bucket not in folded:
                    rows[bucket] = [*rows.get(bucket, []), version]
                elif table == "gone" and bucket in whole:
                    rows[bucket] = []  # nothing of what was gone is left in it
                else:
                    rows[bucket] = [version]
        self._commit(version, manifest)

    def _due(self, manifest: Manifest, added: dict[int, bool], known: DataFrame, replaced: DataFrame) -> list[int]:
        """The touched buckets that a batch writes whole: those that hold nothing, have many versions, or of which much is gone."""
        touched = list(added)
        counted = known.withColumn("n", F.lit(1)).unionByName(replaced.withColumn("n", F.lit(0)))
        gone = self._versions(manifest, "gone", touched)
        if gone is not None:
            counted = counted.unionByName(gone.select("file_id", "bucket", F.lit(0).alias("n")))
        # A row for each bucket.
        rows = counted.groupBy("bucket").agg(F.sum("n").alias("held"), F.count_if(F.col("n") == 0).alias("gone")).collect()
        limits = {r.bucket: r.gone > min(MAX_GONE_SHARE * r.held, MAX_GONE / self.buckets) for r in rows}
        versions = manifest.get("chunks", {})
        return [b for b in touched if b not in versions or len(versions[b]) >= MAX_VERSIONS or limits.get(b, False)]
