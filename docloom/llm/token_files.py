"""Token ids in compressed binary files, and back.

Documents are tokenised in ascending order of id: a range partition gives every task a run of ids, which it sorts, encodes and
writes as files of its own. A file holds whole documents: the mark, blocks of ``codec`` (each coded on its own, with its sums), and
at its end the ids and lengths of its documents (compressed, with a sum) and where these begin. A file ends
with the first document that passes ``FILE_IDS`` ids; a longer document makes a longer file, written and read block by block.

Names are a function of the task, and a file appears under its name only when it is complete, so tasks that run
again or twice leave the same files. A manifest (one row per file) is written with the files; positions in the
whole stream are sums over it.

Defined results: a null text is the end id alone; a null document id comes first; rows that repeat an id keep a row and
a place each; an empty table writes no file; columns other than id and text are not looked at.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import codec, vocab
from docloom.llm.columns import once
from docloom.llm.textscan import slices
from docloom.sources.sizes import shared_folder

MAGIC = b"TOKENS1\n"
END = 0
FILE_IDS = 1 << 24
#: Pieces that a worker remembers: some 130 MB.
REMEMBERED = 800_000
SLICE_BYTES = 4 << 20
FOOTER = "<QII"  # where the documents begin, their bytes, their sum
FOOTER_BYTES = 16
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("length", "<u8")])


class Writer:
    """One file."""

    def __init__(self, folder: str, name: str, vocabulary: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.name, self.path = f"{folder}/{name}", f"{root}/{name}"
        self.part = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.vocabulary = vocabulary
        self.at = self.out.write(MAGIC) or len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.documents: list[tuple[int, bool, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is None, len(ids)))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= codec.BLOCK_IDS:
            stream = np.concatenate(self.waiting)
            whole = len(stream) // codec.BLOCK_IDS * codec.BLOCK_IDS
            for k in range(0, whole, codec.BLOCK_IDS):
                self._put(codec.encode(stream[k : k + codec.BLOCK_IDS], self.vocabulary))
            self.waiting, self.held = [stream[whole:].copy()], len(stream) - whole

    def close(self) -> dict:
        if self.held:
            self._put(codec.encode(np.concatenate(self.waiting), self.vocabulary))
        documents = zlib.compress(np.array(self.documents, DOCUMENT).tobytes())
        begin = self.at
        self._put(documents)
        self._put(struct.pack(FOOTER, begin, len(documents), zlib.crc32(documents)))
        self.out.close()
        self.fs.move(self.part, self.path)
        return {"file": self.name, "n_documents": len(self.documents), "n_ids": self.ids, "n_bytes": self.at}


class Reader:
    """The documents of one file, block by block."""

    def __init__(self, name: str):
        fs, path = pafs.FileSystem.from_uri(name)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        begin, length, total = struct.unpack(FOOTER, self.source.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        documents = self.source.read_at(length, begin)
        self.source.seek(0, io.SEEK_SET)
        if self.source.read(len(MAGIC)) != MAGIC or zlib.crc32(documents) != total:
            raise ValueError(f"{name} is not a whole file of token ids")
        self.end = begin
        self.documents = np.frombuffer(zlib.decompress(documents), DOCUMENT)

    def blocks(self) -> Iterator[np.ndarray]:
        while self.source.tell() < self.end:
            header = self.source.read(codec.HEADER_BYTES)
            yield codec.decode(header + self.source.read(codec.payload_size(header)))

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document's number in the file, some of its ids, whether these end it), in order."""
        lengths = self.documents["length"].astype(np.int64)
        i, missing = 0, int(lengths[0]) if len(lengths) else 0
        for ids in self.blocks():
            at = 0
            while at < len(ids):
                take = min(missing, len(ids) - at)
                missing -= take
                yield i, ids[at : at + take], missing == 0
                at += take
                if not missing:
                    i += 1
                    missing = int(lengths[i]) if i < len(lengths) else 0


def new_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return folder


def write(
    docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
    end: int = END, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all documents below ``folder``; the manifest (task, part, file, n_documents, n_ids, n_bytes, start),
    start being the number of ids in all files before."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = (
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("_text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", F.xxhash64("_text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        memory = vocab.remembered("byte_bpe", path, vocab.byte_bpe, REMEMBERED)
        size = Tokenizer.from_file(path).get_vocab_size()
        task, part, writer = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"task": task, "part": part, **writer.close()}], schema=kinds)

        for batch in batches:
            for piece, data, offsets in slices(batch, "_text", SLICE_BYTES):
                ids, at = vocab.encode_texts(data, offsets, memory)
                for doc_id, a, b in zip(piece["id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if writer is None:
                        writer = Writer(folder, f"{task:08d}-{part:06d}.tokens", size)
                    writer.add(doc_id, np.append(ids[a:b], np.uint16(end)))
                    if writer.ids >= file_ids:
                        yield done()
                        part, writer = part + 1, None
        if writer is not None:
            yield done()

    kinds = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_documents", pa.int64()),
                       ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
    manifest = once(
        rows.mapInArrow(run, "task int, part int, file string, n_documents long, n_ids long, n_bytes long"), "manifest"
    )
    # Sums by groups of tasks first, so that no task sees more than a thousandth of the manifest or of the groups.
    group = F.floor(F.col("task") / 1000)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = manifest.groupBy(group.alias("group")).agg(F.sum("n_ids").alias("n")).select(
        "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("group").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        manifest.withColumn("group", group)
        .withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(groups, "group")
        .select(*manifest.columns, (F.col("base") + F.col("own")).alias("start"))
    )


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read back; with ``with_ids`` the ids as binary,
    little-endian unsigned 32-bit integers."""
    files = manifest.select("file", "start")
    parts = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                reader = Reader(name)
                total, held, sums, texts = 0, [], [], []
                for _, ids, ended in reader.pieces():
                    raw = ids.astype("<u4").tobytes()
                    total = zlib.crc32(raw, total)
                    if with_ids:
                        held.append(raw)
                    if ended:
                        sums.append(total)
                        texts.append(b"".join(held))
                        total, held = 0, []
                lengths = reader.documents["length"].astype(np.int64)
                columns = {
                    "doc_id": pa.array(reader.documents["doc_id"], pa.int64(), mask=reader.documents["null"].astype(bool)),
                    "start": pa.array(start + np.cumsum(lengths) - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(texts, pa.binary())} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.repartition(parts).mapInArrow(run, schema)
