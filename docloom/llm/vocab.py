"""Public tokenisers applied word by word, with a memory of the words seen by a Python worker.

A text is cut where no token can cross: before a space or line end that follows a byte which is certainly not white
space, and between a letter and a stop or comma. Distinct pieces of a slice are encoded once; short ones are remembered, up to ``REMEMBERED`` of them, so the
memory is bounded and the result is the tokeniser's own for any text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from docloom.llm.columns import worker_state
from docloom.llm.textscan import LOWER, binary_array, coded, spread_out

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Some 60 MB in each Python worker.
REMEMBERED = 300_000
REMEMBERED_BYTES = 16 << 20
#: Joined texts that a tokeniser gets at a time.
AT_ONCE = 16

#: From distinct pieces to all their ids in a row and the number of ids of each.
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class Memory:
    """Ids of pieces, encoded when first seen. When it is full it keeps those that slices had in common."""

    def __init__(self, encode: Encode, room: int | None = None):
        self.encode = encode
        self.room = room or REMEMBERED
        self.places: dict[bytes, int] = {}
        self.bytes = self.used = 0
        self.begins, self.lengths = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.seen = np.empty(1024, np.int64)
        self.flat = np.empty(4096, np.uint16)

    def _forget(self) -> None:
        """Keep the pieces of several slices, the commonest first, and at most half of what fits."""
        n = len(self.places)
        order = np.argsort(-self.seen[:n], kind="stable")[: self.room // 2]
        order = order[self.seen[order] > 1]
        words = list(self.places)
        kept = [words[i] for i in order.tolist()]
        if sum(map(len, kept)) > REMEMBERED_BYTES // 2:
            kept, order = [], order[:0]
        lengths = self.lengths[order]
        self.flat = self.flat[spread_out(self.begins[order], lengths)]
        self.begins, self.lengths, self.seen = np.cumsum(lengths) - lengths, lengths, np.ones(len(kept), np.int64)
        self.places = dict(zip(kept, range(len(kept)), strict=True))
        self.bytes, self.used = sum(map(len, kept)), len(self.flat)

    def look_up(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in ``flat``, and how many it has."""
        if len(self.places) > self.room or self.bytes > REMEMBERED_BYTES:
            self._forget()
        at = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            ids, lengths = self.encode(new)
            first = len(self.places)
            self.begins = _room(self.begins, first, len(new))
            self.lengths = _room(self.lengths, first, len(new))
            self.seen = _room(self.seen, first, len(new))
            self.seen[first : first + len(new)] = 0
            self.flat = _room(self.flat, self.used, len(ids))
            self.begins[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(new)] = lengths
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.bytes += sum(map(len, new))
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            at[unknown] = np.arange(first, first + len(new))
        self.seen[at] += 1  # the pieces of a slice are distinct
        return self.begins[at], self.lengths[at]


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    larger = np.empty(max(2 * len(array), used + more), array.dtype)
    larger[:used] = array[:used]
    return larger


def remembered(name: str, path: str, make: Callable[[str], Encode], room: int | None = None) -> Memory:
    """The worker's memory for one tokeniser; it holds one at a time."""
    state = worker_state()
    if getattr(state, "memory", (None,))[0] != (name, path):
        state.memory = (name, path), Memory(make(path), room)
    return state.memory[1]


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint16, int(lengths.sum())), lengths


def sentencepiece_words(path: str) -> Encode:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: _flat(model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))


#: Letters that every definition of a letter has: ASCII, and the letters of U+00C0 to U+017F.
LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+"
#: Of these, ones that neither lower case nor composition changes.
LOWER_LATIN = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
LONGEST = 200


class _Tier:
    """Pieces of one kind, encoded many at a time, with a mark between them that no merge of the vocabulary contains."""

    def __init__(self, tokenizer, pattern: bytes, glue: bytes, many: int = 200):
        self.tokenizer, self.pattern, self.glue, self.many = tokenizer, re.compile(pattern), glue, many
        self.mark = tokenizer.encode("\0", add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no id for the mark")

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [self.glue.join(words[k : k + self.many]).decode() for k in range(0, len(words), self.many)]
        parts = [np.empty(0, np.uint16)]
        for k in range(0, len(texts), AT_ONCE):  # an encoding is much larger than its ids
            for encoded in self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False):
                parts.append(np.array(encoded.ids + self.mark, np.uint16))
        flat = np.concatenate(parts)
        cuts = np.flatnonzero(flat == self.mark[0])
        return np.delete(flat, cuts), np.diff(cuts, prepend=-1) - 1


def _in_tiers(tokenizer, tiers: list[_Tier]) -> Encode:
    """Every piece goes to the first tier whose pattern it is; the others, and long ones, are encoded alone."""

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        kind = np.full(len(words), len(tiers))
        left = [i for i, w in enumerate(words) if len(w) < LONGEST]
        for k, tier in enumerate(tiers):
            mine = [i for i in left if tier.pattern.fullmatch(words[i])]
            kind[mine] = k
            left = [i for i in left if kind[i] > k]
        begins, sizes, flats, used = np.empty(len(words), np.int64), np.empty(len(words), np.int64), [], 0
        for k in range(len(tiers) + 1):
            at = np.flatnonzero(kind == k)
            if not len(at):
                continue
            own = [words[i] for i in at.tolist()]
            if k < len(tiers):
                flat, lengths = tiers[k](own)
            else:
                flat, lengths = _flat([e.ids for w in own for e in tokenizer.encode_batch_fast([w.decode()], add_special_tokens=False)])
            begins[at], sizes[at] = used + np.cumsum(lengths) - lengths, lengths
            flats.append(flat)
            used += len(flat)
        return (np.concatenate(flats) if flats else np.empty(0, np.uint16))[spread_out(begins, sizes)], sizes

    return encode


def _simple(path: str):
    """The tokeniser with nothing to look for in a text but marks: for pieces that are one word of letters each."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split("\0", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # pieces come once
    return tokenizer


def byte_bpe(path: str) -> Encode:
    """Pieces of a byte-level BPE, see ``pieces``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # None of the second kind can share a token with the mark: a mark before a stop or comma stays a token of its own, and
    # white space comes first and never last.
    safe = rb"[.,]|[ \n.,][^\0]*(?:[!-~]|[\xc3-\xdf][\x80-\xbf])"
    return _in_tiers(tokenizer, [_Tier(_simple(path), b" ?" + LATIN, b"\0"), _Tier(tokenizer, safe, b"\0")])


def word_bpe(path: str) -> Encode:
    """Pieces of a BPE with word ends that drops white space and case."""
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(path)
    simple = _simple(path)
    simple.normalizer = normalizers.Replace(" ", "")
    return _in_tiers(tokenizer, [_Tier(simple, b" ?" + LOWER_LATIN, b"\0"), _Tier(tokenizer, rb"[^\0]+", b" \0 ")])


def _safe_ends(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character which is not white space in any definition."""
    safe = (data > 0x20) & (data < 0x7F)
    n = len(data)
    if n > 1 and (data > 0x7E).any():
        lead2 = (data >= 0xC3) & (data <= 0xDF)
        safe[1:] |= lead2[:-1]
        lead3 = (data >= 0xE4) & (data <= 0xED)
        safe[2:] |= lead3[:-2]
    return safe


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the pieces of all texts, and the first piece of each text (one more for the end)."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        gap = (data == 0x20) | (data == 0x0A)
        cut[1:n] = gap[1:] & _safe_ends(data)[:-1]
        # A letter ends its token before a stop or comma.
        letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
        cut[1:n] |= ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & letter[:-1]
    cut[offsets] = True
    cut[n] = True
    places = np.flatnonzero(cut)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    return places, np.searchsorted(places, offsets)


def encode_texts(data: np.ndarray, offsets: np.ndarray, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the offsets of the texts in them."""
    places, first = pieces(data, offsets)
    codes, distinct = coded(binary_array(data, places))
    return gather(codes, *memory.look_up(distinct), first, memory)


def encode_caseless(data: np.ndarray, offsets: np.ndarray, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Like ``encode_texts`` for a tokeniser that drops case, so that fewer pieces differ."""
    # Special tokens are found before case is dropped; texts that may hold one stay as they are.
    return encode_texts(data if b"<|" in data.tobytes() else LOWER[data], offsets, memory)


def gather(
    codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, first: np.ndarray, memory: Memory
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of coded pieces one after the other, and the offsets of the texts in them."""
    own = lengths[codes]
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(own, out=total[1:])
    return memory.flat[spread_out(begins[codes], own)], total[first]
