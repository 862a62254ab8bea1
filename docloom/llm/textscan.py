"""Vectorised scanning of Arrow texts: bytes, words and word codes as numpy arrays.

Batches are cut into slices of a few megabytes, so the arrays stay small however large a batch is; a single text is never
cut. Everything returned refers to the bytes of one slice: ``offsets[i] : offsets[i + 1]`` is text ``i``.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: Bytes of words in the contracts: all but space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes with A-Z turned into a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def release_memory() -> None:
    """Give back what is free: a Python worker outlives its tasks, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and their offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.empty(0, np.uint8)
    return data, offsets - first


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive parts of a batch with their bytes and offsets: about ``limit`` bytes, or one longer text."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch[column])
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    del data, offsets
    release_memory()


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which end where texts end, and the first run of each text (one more for the end)."""
    n = len(member)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    opens[cuts] = member[cuts]
    closes[cuts - 1] = member[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def compact(data: np.ndarray, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as a binary array."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return binary_array(data[member], offsets)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def coded(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A code for each word and the distinct words in the order of their codes."""
    if not len(words):
        return np.empty(0, np.int64), []
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all given runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - begins, lengths)
