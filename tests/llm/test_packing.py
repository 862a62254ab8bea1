import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing
from tests.llm import samples


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 32, 256]))
    sizes = np.sort(rng.choice(np.arange(1, capacity + 1), int(rng.integers(1, min(capacity, 40) + 1)), replace=False))
    demand = rng.integers(1, [5, 1000][seed % 2], len(sizes))
    plan = packing.cutting_plan(sizes, demand, capacity)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all((p @ sizes) <= capacity and t > 0 for p, t in plan)
    used = sum(t for _, t in plan)
    bound = -(-int(sizes @ demand) // capacity)
    half = int(demand[2 * sizes > capacity].sum())
    assert max(bound, half) <= used <= 1.25 * max(bound, half) + len(sizes)


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes, values = np.sort(rng.choice(np.arange(1, 12), 4, replace=False)), rng.random(4)
        capacity = int(rng.integers(3, 25))
        if sizes[0] > capacity:
            continue
        grid = np.stack(np.meshgrid(*[np.arange(capacity // s + 1) for s in sizes], indexing="ij"), -1).reshape(-1, 4)
        best = (grid[grid @ sizes <= capacity] @ values).max()
        value, pattern = packing._knapsack(values, sizes, capacity)
        assert np.isclose(value, best) and pattern @ sizes <= capacity and np.isclose(pattern @ values, best)


def test_program_reaches_the_bound():
    """Pairs that fill a sequence exactly are found."""
    sizes, demand = np.array([40, 60, 100, 156, 196, 216]), np.array([500, 300, 700, 700, 300, 500])
    assert sum(t for _, t in packing.cutting_plan(sizes, demand, 256)) <= 1510


def check(rows, got):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array(e.ids + [2], "<u4") for e in tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    wanted = []
    for r, own in zip(rows, ids, strict=True):
        for a in range(0, len(own), 4096):
            piece = own[a : a + 4096]
            wanted.append((r[0], a, len(piece), zlib.crc32(piece.tobytes()), len(own)))
    samples.same([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], wanted)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return total, padding


def test_contract(spark):
    rows = samples.texts()
    total, padding = check(rows, packing.pack(samples.frame(spark, rows)).collect())
    assert padding <= 2 * 4096


def test_hot_length_and_little_padding(spark):
    rng = np.random.default_rng(1)
    sizes = [300] * 500 + rng.integers(10, 3000, 700).tolist()
    rows = [(i, "a " * n, "en", "s") for i, n in enumerate(sizes)]
    total, padding = check(rows, packing.pack(samples.frame(spark, rows, 5)).collect())
    assert padding < 0.02 * total


def test_ids_travel(spark):
    rows = [(1, "one two", "en", "s"), (2, "b " * 5000, "en", "s")]
    got = packing.pack(samples.frame(spark, rows), with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_empty(spark):
    assert packing.pack(samples.empty(spark)).count() == 0
