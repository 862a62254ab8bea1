"""URL filter: rules in sorted arrays of 64-bit digests, probed by binary search.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's path. The longest fitting rule decides.

``build_index`` sorts the rules by the XXH64 digest of host + path and lets every task write one
shard: the digests, the full strings and the verdicts, as a plain binary file in the shared folder. A rule
list of any length is spread over shards; the driver only sees the list of shards. ``judge`` maps the
shards into memory, forms each URL's possible keys (host suffixes by path lengths that rules have), probes
all keys of a batch with one vectorised search, and compares full strings, so that equal digests of
different strings cannot decide anything.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule; rules with a
null or empty host are left out, a null path counts as empty; of equal keys ``block`` wins; a URL
that fits no rule gets ``default``; an empty rule list fits nothing; every input row gives one row, repeated rows too.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import ascii_lower, worker_state
from docloom.sources.sizes import shared_folder

SEED = 42
RULES_PER_SHARD = 4_000_000


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    low: int
    high: int


@dataclass(frozen=True)
class UrlIndex:
    shards: tuple[Shard, ...]
    path_lengths: tuple[int, ...]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _write_shard(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or table.num_rows == 0:
            return
        digests = table["digest"].to_numpy()
        keys = [k.encode() for k in table["rule"].to_pylist()]
        offsets = np.cumsum([0, *map(len, keys)], dtype=np.int64)
        blocked = np.array([v == "block" for v in table["verdict"].to_pylist()], np.uint8)
        # The name is a function of the content, so a task that runs again writes the same file.
        name = f"{folder}/{int(digests[0]) & 0xFFFFFFFFFFFFFFFF:016x}.rules"
        fs, path = pafs.FileSystem.from_uri(name)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for piece in (np.array([len(keys)], np.int64), digests, offsets, blocked):
                out.write(piece.tobytes())
            out.write(b"".join(keys))
        fs.move(part, path)
        yield pa.RecordBatch.from_pydict(
            {"path": [name], "rows": [len(keys)], "low": [int(digests[0])], "high": [int(digests[-1])]}
        )

    return write


def build_index(rules: DataFrame, rules_per_shard: int = RULES_PER_SHARD) -> UrlIndex:
    """Sort and write ``rules`` (host, path, verdict); ``rules`` may be of any length."""
    spark = rules.sparkSession
    folder = f"{shared_folder(spark)}/urls-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    keyed = (
        rules.select(
            ascii_lower(F.col("host")).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .filter("host <> ''")
        .groupBy(F.concat("host", "path").alias("rule"))
        .agg(F.max("verdict").alias("verdict"), F.max(F.char_length("path")).alias("path_length"))
        .withColumn("digest", F.xxhash64("rule"))
    )
    count = keyed.count()
    if not count:
        return UrlIndex((), ())
    shards = (
        keyed.repartitionByRange(-(-count // rules_per_shard), "digest")
        .sortWithinPartitions("digest", "rule")
        .select("digest", "rule", "verdict")
        .mapInArrow(_write_shard(folder), "path string, rows long, low long, high long")
        .collect()
    )
    # As many lengths as a path can have, however many rules there are.
    lengths = rules.select(F.char_length(F.coalesce("path", F.lit(""))).alias("n")).distinct().collect()
    return UrlIndex(
        tuple(sorted((Shard(*r) for r in shards), key=lambda s: s.low)),
        tuple(sorted((r.n for r in lengths), reverse=True)),
    )


def _mapped(path: str):
    """The arrays of a shard, mapped into memory; a shard that is not a local file is copied once per worker."""
    state = worker_state()
    cache = state.__dict__.setdefault("url_shards", {})
    if path not in cache:
        fs, place = pafs.FileSystem.from_uri(path)
        if not isinstance(fs, pafs.LocalFileSystem):
            with tempfile.NamedTemporaryFile(delete=False) as copy, fs.open_input_stream(place) as source:
                while block := source.read(1 << 22):
                    copy.write(block)
            place = copy.name
        raw = np.memmap(place, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        at = 8 + 8 * n
        end = at + 8 * (n + 1)
        cache[path] = (raw[8:at].view(np.int64), raw[at:end].view(np.int64), raw[end : end + n], raw[end + n :])
    return cache[path]


def _probe(index: UrlIndex, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
    """For each key 1 (block), 0 (allow) or -1 (no rule)."""
    found = np.full(len(keys), -1, np.int8)
    for shard in index.shards:
        inside = np.flatnonzero((digests >= shard.low) & (digests <= shard.high))
        if not inside.size:
            continue
        stored, offsets, blocked, text = _mapped(shard.path)
        at = np.searchsorted(stored, digests[inside])
        live = stored[np.minimum(at, len(stored) - 1)] == digests[inside]
        for i, k in zip(inside[live].tolist(), at[live].tolist(), strict=True):
            while k < len(stored) and stored[k] == digests[i]:  # equal digests stand together
                if text[offsets[k] : offsets[k + 1]].tobytes() == keys[i]:
                    found[i] = blocked[k]
                    break
                k += 1
    return found


def _candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    suffixes = [host]
    at = host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [s + h for s in suffixes if s for h in heads]


def _judge_batches(index: UrlIndex, default: str):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, keys = [], []
            for i, (host, path) in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                own = _candidates(host, path, index.path_lengths)
                owner += [i] * len(own)
                keys += own
            raw = [k.encode() for k in keys]
            digests = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in raw), np.uint64, len(raw)).view(np.int64)
            rule, verdict = [None] * batch.num_rows, [default] * batch.num_rows
            found = _probe(index, raw, digests)
            for k in np.flatnonzero(found >= 0).tolist():
                i = owner[k]
                if rule[i] is None or len(keys[k]) > len(rule[i]):
                    rule[i], verdict[i] = keys[k], "block" if found[k] else "allow"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return judge


def judge(pages: DataFrame, index: UrlIndex, id_column: str, url_column: str, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``."""
    parts = pages.select(
        F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    )
    kind = parts.schema[0].dataType.simpleString()
    return parts.mapInArrow(
        _judge_batches(index, default), f"`{id_column}` {kind}, host string, path string, rule string, verdict string"
    )
