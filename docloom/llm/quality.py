"""Quality rules: counts of a text, and bands on how a public vocabulary cuts it.

Counts: words, code points in words, symbols, repeated lines, words in repeated 3-word windows. Fertility of a public
vocabulary with byte fallback: letters per token, share of byte-fallback tokens, and the entropy of the tokens as a share of
what so many different tokens could have. Natural text of one language keeps these within narrow bands.

The bands are robust statistics of the whole corpus for each language: quartiles over all documents that pass the
plain rules, and so many quartile ranges (scaled to standard deviations) around the median. Languages of
few documents get bands in the same way; a language without any passing document has none and rejects nothing.

Defined results: a null text has no words and fails the plain rules; a null language is a language of its own; repeated rows
are judged alike; an empty table gives an empty result; other columns pass through, whatever their names: the counts travel in one
struct column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import vocab
from docloom.llm.columns import once, text_hash, without_rows
from docloom.llm.textscan import NOT_SPACE, coded, compact, per_text, runs, slices

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Widths of the bands, in standard deviations estimated from the quartiles; a lower and an upper one.
LETTERS_BAND = (6.0, 12.0)
ENTROPY_BAND = (8.0, math.inf)
BYTES_BAND = (math.inf, 30.0)
#: A quartile range below this share of the median counts as this share.
LEAST_SPREAD = 0.02
#: The upper bound of the share of byte tokens is never below this: where most texts of a language have none, median and
#: quartiles are 0, and a few characters outside the vocabulary (three or four tokens each) do not make a text bad.
LEAST_BYTES_BOUND = 0.1

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STARTS = np.ones(256, bool)  # bytes that start a code point
STARTS[0x80:0xC0] = False
LETTERS = np.zeros(256, bool)  # ASCII letters and the first bytes of all other characters
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xF5)]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
SHARES = ("letters_per_token", "byte_share", "entropy")
MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES]
)


def _dup_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return repeated


def _repeat_words(codes: np.ndarray, first: np.ndarray, kinds: int) -> np.ndarray:
    """For each text the words that lie in a 3-word window found twice or more in it."""
    n, texts = len(codes), len(first) - 1
    if n < 3:
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(first))
    inside = owner[2:] == owner[:-2]
    if kinds < 1 << 21:
        window = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:  # one very long text: name pairs first, which keeps the numbers small and exact
        pairs = np.unique((codes[:-1] << 32) | codes[1:], return_inverse=True)[1]
        window = (pairs[:-1] << 32) | codes[2:]
    at = np.flatnonzero(inside)
    window, own = window[at], owner[at]
    order = np.argsort(window, kind="stable")  # and so by text within equal windows
    same = (window[order][1:] == window[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[hit + step] = True
    return per_text(covered, first)


def _entropy(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entropy of each text's ids over the largest that its number of distinct ids allows; 1 for fewer than two."""
    texts, n = len(offsets) - 1, np.diff(offsets)
    out = np.ones(texts)
    if not len(ids):
        return out
    owner = np.repeat(np.arange(texts, dtype=np.uint64), n)
    key = np.sort((owner << np.uint64(16)) | ids)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(begins, append=len(key))
    whose = (key[begins] >> np.uint64(16)).astype(np.int64)
    weight = np.bincount(whose, counts * np.log2(counts), texts)
    kinds = np.bincount(whose, minlength=texts)
    many = kinds > 1
    out[many] = (np.log2(n[many]) - weight[many] / n[many]) / np.log2(kinds[many])
    return out


def measure_slice(data: np.ndarray, offsets: np.ndarray, memory: vocab.Memory, is_byte: np.ndarray) -> list[np.ndarray]:
    raw = data.tobytes()
    member = NOT_SPACE[data]
    starts, ends, first = runs(member, offsets)
    codes, distinct = coded(compact(data, member, starts, ends))
    begins, lengths = memory.look_up(distinct)
    ids, at = vocab.gather(codes, begins, lengths, first, memory)
    tokens = np.diff(at)
    whole = np.maximum(tokens, 1)
    return [
        np.diff(first),
        per_text(member & STARTS[data], offsets),
        per_text(SYMBOLS[data], offsets),
        np.array([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64),
        _repeat_words(codes, first, len(distinct)),
        tokens,
        per_text(LETTERS[data], offsets) / whole,
        per_text(is_byte[ids], at) / whole,
        _entropy(ids, at),
    ]


def with_measures(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the struct _quality."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    kept = docs.columns if keep is None else keep
    source = docs.select(*[F.col(c) for c in kept], F.col(text_column).alias("_text"))
    kinds = [pa.field(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64()) for f in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        memory = vocab.remembered("sentencepiece", path, vocab.sentencepiece_words)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                found = measure_slice(data, offsets, memory, is_byte)
                struct = pa.StructArray.from_arrays([pa.array(a, f.type) for a, f in zip(found, kinds, strict=True)], fields=kinds)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], struct], names=[*kept, "_quality"])

    return source.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField("_quality", MEASURES)]))


def base_failed(min_words: int = MIN_WORDS, max_percent: int = MAX_REPEATED_PERCENT) -> Column:
    words, repeated = F.col("_quality.n_words"), F.col("_quality.n_repeat_words")
    return (words < min_words) | (100 * repeated > max_percent * words)


def bands(measured: DataFrame, group_column: str) -> DataFrame:
    """(_group, and a lower and an upper bound for each share): one row for each language."""
    widths = dict(zip(SHARES, (LETTERS_BAND, BYTES_BAND, ENTROPY_BAND), strict=True))
    quartiles = measured.filter(~base_failed()).groupBy(F.col(group_column).alias("_group")).agg(
        *[F.percentile_approx(f"_quality.{c}", [0.25, 0.5, 0.75], 1000).alias(c) for c in SHARES]
    )
    bounds = []
    for c in SHARES:
        low, middle, high = (F.col(c)[i] for i in range(3))
        spread = F.greatest((high - low) / 1.35, F.abs(middle) * LEAST_SPREAD, F.lit(1e-6))
        below, above = (spread * w if math.isfinite(w) else F.lit(math.inf) for w in widths[c])
        upper = middle + above
        if c == "byte_share":
            upper = F.greatest(upper, F.lit(LEAST_BYTES_BOUND))
        bounds += [(middle - below).alias(f"_{c}_low"), upper.alias(f"_{c}_high")]
    return quartiles.select("_group", *bounds)


def judge(measured: DataFrame, group_column: str = "lang") -> DataFrame:
    """``measured`` (written, as it is read twice) with _base_failed and _kept."""
    joined = measured.join(bands(measured, group_column), measured[group_column].eqNullSafe(F.col("_group")), "left")
    inside = F.lit(True)
    for c in SHARES:
        value = F.col(f"_quality.{c}")
        inside = inside & F.coalesce(value.between(F.col(f"_{c}_low"), F.col(f"_{c}_high")), F.lit(True))
    return joined.select(
        *[measured[c] for c in measured.columns], base_failed().alias("_base_failed"), (~base_failed() & inside).alias("_kept")
    )


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    keyed = docs.select(
        F.col(id_column).alias("_id"), text_hash(F.col(text_column)).alias("_h"), F.col(group_column).alias("_lang"), F.col(text_column).alias("_t")
    )
    measured = once(with_measures(keyed, "_t", ["_id", "_h", "_lang"]), "measured")
    rejected = judge(measured, "_lang").filter(~F.col("_kept")).select("_id", "_h").distinct()
    return without_rows(docs, rejected, id_column, text_column)
