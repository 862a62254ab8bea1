import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import simhash
from tests.llm import samples


def fingerprint(text, size=3):
    words = samples.WORD.findall(samples.low(text))
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, radius):
    """(id, fingerprint) to the smallest id that can be reached."""
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(pairs):
        groups.setdefault(root(i), []).append(doc)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(pairs))]


def test_contract(spark):
    rows = samples.texts()
    pairs = [(r[0], fingerprint(r[1])) for r in rows]
    want = [(d, format(fp, "016x"), c) for (d, fp), c in zip(pairs, components(pairs, 2), strict=True)]
    found = simhash.near_duplicates(samples.frame(spark))
    samples.same(found.select("doc_id", simhash.as_hex(F.col("_fp0")), "component_id").collect(), want)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("radius", "lanes", "tile_rows", "visitors"), [(2, 4, 8, 16), (2, 4, 10_000, 10_000), (3, 2, 5, 7), (9, 1, 20, 30)])
def test_links_lose_nothing(spark, radius, lanes, tile_rows, visitors):
    """Split tiles, shared visitors, chains and a hot cell: the same groups as all pairs."""
    rng = np.random.default_rng(radius)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set(seeds) | {0, (1 << 64) - 1}
    for s in seeds:
        x = s
        for _ in range(25):  # chains, and clouds around their seeds
            x ^= 1 << int(rng.integers(0, 64))
            fps |= {x, s ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))}
    fps = sorted(fps)
    rows = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, _fp0 long")
    got = simhash.grouped(rows, "doc_id", 1, radius, lanes, tile_rows=tile_rows, visitors=visitors)
    want = components(list(enumerate(fps)), radius)
    samples.same(got.select("doc_id", "component_id").collect(), list(enumerate(want)))


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_keep_one(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s") for i, t in enumerate(base[:5])]  # copies
    near = [t.replace(t.split()[150], "changed", 1) for t in base[5:10]]
    rows += [(200 + i, t, "en", "s") for i, t in enumerate(near)]
    rows += [rows[15], rows[15], (None, base[16], "en", "s"), (None, "all alone " * 60, None, None)]
    docs = samples.frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    samples.same([(r.doc_id,) for r in kept.collect()], [(i,) for i in range(20)] + [(None,)])


def replaced(words, jaccard, rng, at=0, size=5):
    """``words`` with one stretch of new ones, so that the shingle sets have about this similarity."""
    n = len(words) - size + 1
    gone = round(n * (1 - jaccard) / (1 + jaccard)) - size + 1
    return [*words[:at], *[f"n{rng.integers(1 << 40)}" for _ in range(gone)], *words[at + gone :]]


def jaccard(a, b, size=5):
    x, y = ({tuple(t[i : i + size]) for i in range(len(t) - size + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_compares_sets(spark):
    """Texts of similarity 0.8 and more are one group, texts below are not, however near their fingerprints."""
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for i, share in enumerate(np.repeat([0.82, 0.85, 0.9, 0.55, 0.6, 0.7, 0.75], 20)):
        base = [f"w{rng.integers(1 << 40)}" for _ in range(400)]
        other = replaced(base, share, rng, 150)
        assert (jaccard(base, other) >= 0.8) == (share > 0.8)
        rows += [(2 * i, " ".join(base), "en", "s"), (2 * i + 1, " ".join(other), "en", "s")]
        want |= {2 * i} if share > 0.8 else {2 * i, 2 * i + 1}
    # One shingle has most of the votes of all of these if it counts more than once.
    for i in range(5):
        rows.append((1000 + i, "again " * 100 + " ".join(f"v{rng.integers(1 << 40)}" for _ in range(60)), "en", "s"))
        want.add(1000 + i)
    assert {r.doc_id for r in simhash.keep_one(samples.frame(spark, rows)).collect()} == want


def test_refuted_links_hide_none(spark):
    """Two texts that are alike only by a third one: whichever link a tile reports, all three are one group."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        base = [f"w{rng.integers(1 << 40)}" for _ in range(400)]
        ends = replaced(base, 0.88, rng, 40), replaced(base, 0.88, rng, 300)
        assert jaccard(*ends) < 0.8 <= min(jaccard(base, e) for e in ends)
        rows += [(3 * i + k, " ".join(t), "en", "s") for k, t in enumerate((*ends, base))]
    assert {r.doc_id for r in simhash.keep_one(samples.frame(spark, rows)).collect()} == set(range(0, 120, 3))


def test_sizes_too_far_apart_are_not_compared(spark):
    """Every two sets whose sizes may go with the similarity are compared, split tiles or not, and few of the others."""
    sizes = [0, 1, 2, 4, 5, 8, 10, 11, 80, 99, 100, 125, 126, 400, 500, 501, 10_000, 12_500, 1 << 40]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(sizes)]
    classes = spark.createDataFrame(rows, "node long, _fp0 long, _fp1 long, _size long, label long")
    may = {(i, j) for i, a in enumerate(sizes) for j, b in enumerate(sizes) if i < j and 5 * a >= 4 * b}
    for tile_rows, visitors in ((1000, 1000), (1, 1)):
        found = simhash.links(classes, 2, 30, 1, tile_rows, visitors, labelled=True, similar=0.8)
        got = {(min(r), max(r)) for r in found.collect()}
        assert may <= got
        assert all(a == 0 or 1.6 * a >= b for a, b in ((sizes[i], sizes[j]) for i, j in got))


def test_empty(spark):
    assert simhash.near_duplicates(samples.empty(spark)).count() == 0
    assert simhash.keep_one(samples.empty(spark)).count() == 0
