"""Adaptive context-mixing range coder for token ids.

A block of ids is laid out in lanes that are coded in step, so that numpy works on all of them at once. All lanes of
a block share one model, which learns from every step and knows nothing of other blocks. For each id it has three
opinions: order 2 (the id that last followed these two), order 1 (the id that last followed this one), and order 0 (how
often each id has come). The probability of an id is their mixture,

    P(id) = w2 [id = guess 2] + w1 [id = guess 1] + w0 count(id) / total,

whose weights are learnt for each pair of confidences of the guesses. One range coder step per id
codes the id's interval in that mixture. The coder is carry-free, with 64-bit lows and 16-bit output.

A block is: a header (number of ids, lanes, vocabulary, payload bytes, CRC-32 of the payload, CRC-32 of the ids), the number
of output words of each lane, and the words of all lanes. ``decode`` checks both sums.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 22
LANES = 16384
LEAST_STEPS = 64

HEADER = "<6I"
HEADER_BYTES = 24

WHOLE = 4096  # what the weights sum to
FLOOR = 64  # the least weight of order 0
SURE = 8  # levels of confidence
TABLE_BITS = 18
REBUILD = 16

MIX1, MIX2 = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
TOP = np.uint64(1 << 48)
BOTTOM = np.uint64(1 << 40)
SHIFT = np.uint64(16)
HIGH = np.uint64(48)


class Model:
    def __init__(self, vocabulary: int, lanes: int, searching: bool):
        self.vocabulary, self.searching = vocabulary, searching
        # A cell holds a guess and, above its 16 bits, how sure it is.
        self.cells1, self.cells2 = np.zeros(1 << 16, np.int32), np.zeros(1 << TABLE_BITS, np.int32)
        states = SURE * SURE * 2
        # By state: how often neither, guess 1 alone, or guess 2 was right. If both agree, guess 2 has it all.
        self.outcomes = np.tile([4, 2, 2], (states, 1))
        self.outcomes[1::2] = 6, 0, 2
        self.counts = np.ones(vocabulary, np.int64)
        self.waiting: list[np.ndarray] = []
        self.step = 0
        self.before1, self.before2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self._rebuild()

    def _rebuild(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.vocabulary)
            self.waiting = []
        self.cumulated = np.zeros(self.vocabulary + 1, np.uint64)
        np.cumsum(self.counts, out=self.cumulated[1:], dtype=np.uint64)
        self.frequency = self.counts.astype(np.uint64)
        self.n = self.cumulated[-1]
        self.total = self.n * np.uint64(WHOLE)
        if self.searching:
            self.inverse = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.counts)

    def predict(self) -> None:
        """The guesses of both orders, smaller first, and their weights."""
        self.at1 = self.before1
        self.at2 = (self.before2 * MIX2 + self.before1 * MIX1) >> np.uint32(32 - TABLE_BITS)
        cell1, cell2 = self.cells1.take(self.at1), self.cells2.take(self.at2)
        self.one, self.two = cell1 & 0xFFFF, cell2 & 0xFFFF
        self.k1, self.k2 = cell1 >> 16, cell2 >> 16
        self.state = (((self.k2 << 3) | self.k1) << 1) | (self.one == self.two)
        weights = (WHOLE - FLOOR) * self.outcomes[:, 1:] // self.outcomes.sum(1)[:, None]
        weights = np.column_stack([WHOLE - weights.sum(1), weights]).astype(np.uint64)
        self.w0 = weights[:, 0].take(self.state)
        masses = weights[:, 1:] * self.n
        # The order of the guesses decides whose mass comes first; the larger one's is counted from above.
        swap = self.one >= self.two
        self.a, self.b = np.minimum(self.one, self.two), np.maximum(self.one, self.two)
        both = masses.reshape(-1)
        at = self.state * 2
        self.mass_a, self.mass_b = both.take(at + swap), both.take(at + 1 - swap)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids lie in the mixture: lower end and width, out of ``total``."""
        low = self.w0 * self.cumulated.take(ids) + self.mass_a * (ids > self.a) + self.mass_b * (ids > self.b)
        width = self.w0 * self.frequency.take(ids) + self.mass_a * (ids == self.a) + self.mass_b * (ids == self.b)
        return low, width

    def search(self, place: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the places."""
        high_a = self.w0 * self.cumulated.take(self.a + 1) + self.mass_a
        after_a = place >= high_a
        rest = place - self.mass_a * after_a
        # Within a guess's own mass, its id; beyond it, the rest is order 0 alone.
        high_b = self.w0 * self.cumulated.take(self.b + 1) + self.mass_b
        after_b = after_a & (rest >= high_b)
        rest -= self.mass_b * after_b
        # What is left of a guess's mass counts as the last place of its id in order 0.
        guess = np.where(after_a, self.b, self.a)
        own = np.where(after_a, high_b - self.mass_b, high_a - self.mass_a)
        inside = ~after_b & (rest >= own)
        plain = self.inverse.take((rest // self.w0).astype(np.int64), mode="clip")
        return np.where(inside, guess, plain)

    def learn(self, ids: np.ndarray) -> None:
        hit2, hit1 = ids == self.two, ids == self.one
        outcome = self.state * 3 + np.maximum(hit1, hit2 * np.int8(2))
        self.outcomes += np.bincount(outcome, minlength=self.outcomes.size).reshape(-1, 3)
        for cells, at, was, k, hit in (
            (self.cells1, self.at1, self.one, self.k1, hit1), (self.cells2, self.at2, self.two, self.k2, hit2),
        ):
            # A right guess gets surer, a wrong one less so, until it is replaced. Lanes that share a context write
            # the same cell; the last one counts, in both directions alike.
            missed = np.where(k <= 1, ids | (1 << 16), was | ((k >> 1) << 16))
            cells[at] = np.where(hit, was | (np.minimum(k + 1, SURE - 1) << 16), missed)
        self.before1, self.before2 = ids.astype(np.uint32), self.before1
        self.waiting.append(ids)
        self.step += 1
        if self.step % REBUILD == 0 or self.step in (1, 2, 4, 8):
            self._rebuild()


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-n // LEAST_STEPS)))
    return lanes, -(-n // lanes)


def _renew(low: np.ndarray, width: np.ndarray):
    """Shift out settled bits until every lane is wide again; yields the lanes that shift by 16 bits and their lows, each time."""
    settled = (low ^ (low + width)) < TOP
    at = np.flatnonzero(settled | (width < BOTTOM))
    lows, widths, settled = low.take(at), width.take(at), settled.take(at)
    while len(at):
        yield at, lows
        if not settled.all():
            # Too narrow, but not settled: give up what lies beyond the next border.
            widths = np.where(settled, widths, (np.uint64(0) - lows) & (BOTTOM - np.uint64(1)))
        lows, widths = lows << SHIFT, widths << SHIFT
        low[at], width[at] = lows, widths
        settled = (lows ^ (lows + widths)) < TOP
        again = np.flatnonzero(settled | (widths < BOTTOM))
        at, lows, widths, settled = at.take(again), lows.take(again), widths.take(again), settled.take(again)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of at most ``BLOCK_IDS`` ids below ``vocabulary`` (at most 65536)."""
    n = len(ids)
    lanes, steps = _lanes(n) if n else (0, 0)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    room = 3 * steps + 8
    out, filled = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    model = Model(vocabulary, lanes, False)
    for step in range(steps):
        model.predict()
        start, size = model.interval(grid[step])
        unit = width // model.total
        low += start * unit
        width = size * unit
        for at, lows in _renew(low, width):
            out[filled[at]] = lows >> HIGH
            filled[at] += 1
        model.learn(grid[step])
    # Two words name a value within the last interval; what follows reads as zero.
    low += np.uint64(0xFFFFFFFF)
    for shift in (48, 32):
        out[filled] = (low >> np.uint64(shift)).astype(np.uint16)
        filled += 1
    lengths = filled - np.arange(lanes) * room
    used = np.arange(room)[None, :] < lengths[:, None]
    payload = lengths.astype("<u2").tobytes() + out.reshape(lanes, room)[used].astype("<u2").tobytes()
    sums = zlib.crc32(payload), zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
    return struct.pack(HEADER, n, lanes, vocabulary, len(payload), *sums) + payload


def payload_size(header: bytes) -> int:
    return struct.unpack(HEADER, header)[3]


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; an error if it was damaged."""
    n, lanes, vocabulary, size, payload_sum, ids_sum = struct.unpack(HEADER, block[:HEADER_BYTES])
    payload = block[HEADER_BYTES:]
    if len(payload) != size or zlib.crc32(payload) != payload_sum:
        raise ValueError("a block of token ids is damaged")
    steps = -(-n // lanes) if n else 0
    lengths = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
    words = np.append(np.frombuffer(payload, "<u2", offset=2 * lanes), 0).astype(np.uint64)
    ends = np.cumsum(lengths)
    at = ends - lengths

    def take(which: np.ndarray) -> np.ndarray:
        place = at[which]
        inside = place < ends[which]
        at[which] += 1
        return words[np.where(inside, place, len(words) - 1)]

    everyone = np.arange(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << SHIFT) | take(everyone)
    model = Model(vocabulary, lanes, True)
    grid = np.zeros((steps, lanes), np.int32)
    for step in range(steps):
        model.predict()
        unit = width // model.total
        found = model.search(np.minimum((code - low) // unit, model.total - np.uint64(1)))
        start, size_of = model.interval(found)
        low += start * unit
        width = size_of * unit
        for lane, _ in _renew(low, width):
            code[lane] = (code[lane] << SHIFT) | take(lane)
        model.learn(found)
        grid[step] = found
    ids = grid.T.reshape(-1)[:n].astype(np.uint16)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("a block of token ids does not decode to what was written")
    return ids
