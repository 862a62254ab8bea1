import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import lexical
from tests.llm import samples

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERY_SCHEMA = "item_id string, text string, doc_id string, score string, rank string"


def brute(docs, items, k=10):
    texts = [(i, Counter(TERM.findall(samples.low(t)))) for i, t, *_ in docs]
    held = Counter(term for _, words in texts for term in words)
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(sum(w.values()) for _, w in texts)
    out = []
    for item, text in items:
        found = []
        for doc_id, words in texts:
            score = 0
            for term in TERM.findall(samples.low(text)):
                if tf := words[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    m = 100 - 75 + (75 * sum(words.values()) * n_docs) // n_terms
                    score += weight * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort()
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(found[:k], 1)]
    return out


def items_of(rows, rng):
    texts = [r[1] for r in rows if r[1]]
    items = [(f"q{i}", " ".join(rng.choice(texts)[:2000].split(" ")[i : i + rng.randint(1, 25)])) for i in range(30)]
    return items + [("null", None), ("empty", ""), ("none", "zzzzqq yyyxx"), ("again", "the sea"), ("again", "the sea"), ("again", "rain"),
                    (None, "été 日本"), ("many", "the " * 50 + "tin"), ("marks", "?! -- ##")]


def ask(spark, rows, items, **options):
    queries = spark.createDataFrame([(*q, "x", "y", "z") for q in items], QUERY_SCHEMA)
    return [tuple(r) for r in lexical.search(samples.frame(spark, rows, options.pop("partitions", 5)), queries, **options).collect()]


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 400])
def test_against_brute_force(spark, block):
    rows = samples.texts()
    items = items_of(rows, random.Random(3))
    samples.same(ask(spark, rows, items, block_bytes=block), brute(rows, items))


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_ties(spark, k):
    rows = [(i % 40, "one two three" if i % 3 else "two two", "en", "s") for i in range(120)]
    rows += [(200 + i, "four five", "en", "s") for i in range(130)]
    rows += [(None, "one two three", "en", "s")] * 2
    items = [("a", "one"), ("b", "two three"), ("c", "two two five"), ("d", "four")]
    samples.same(ask(spark, rows, items, k=k, partitions=7), brute(rows, items, k))


def test_empty(spark):
    rows = samples.texts()
    none = spark.createDataFrame([], QUERY_SCHEMA)
    found = lexical.search(samples.frame(spark, rows), none)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    assert ask(spark, [], [("a", "the")]) == []
    assert ask(spark, [(1, None, "en", "s"), (2, "?", "en", "s")], [("a", "the")]) == []


def slice_of(seed, n=400):
    """Documents in which some words are everywhere and some are rare."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    shares = 1 / np.arange(1, 61) ** 1.3
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=shares / shares.sum())) for _ in range(n)]
    return texts, rng


@pytest.mark.parametrize("seed", range(6))
def test_accumulators_are_limited_and_exact(seed):
    import pyarrow as pa

    from docloom.llm.textscan import text_bytes

    texts, rng = slice_of(seed)
    asked = [" ".join(rng.choice([f"w{i}" for i in range(60)], rng.integers(2, 12))) for _ in range(40)]
    block = lexical.Block.of(asked)
    data, offsets = text_bytes(pa.array(texts))
    term, document, tf, length = lexical.occurrences(data, offsets, block)
    counts = lexical.Counts(len(texts), int(length.sum()), np.bincount(term, minlength=len(block.terms)))
    postings = lexical.Postings.of(data, offsets, block, counts)
    weights, work, holders = counts.weights(), lexical.Work(), 0
    for terms, times in block.queries:
        full = np.zeros(len(texts), np.int64)
        mine = np.isin(term, terms)
        worth = dict(zip(terms.tolist(), (times * weights[terms]).tolist(), strict=True))
        np.add.at(full, document[mine], [worth[t] * v for t, v in zip(term[mine].tolist(), postings.impacts[mine].tolist(), strict=True)])
        holders += np.count_nonzero(full)
        ids, null = np.arange(len(texts)), np.zeros(len(texts), bool)
        want = lexical.best(full, ids, null, 10)
        got = lexical.accumulate(postings, terms, times, weights, counts.frequency, 10, 0, work)
        assert (lexical.best(got, ids, null, 10) == want).all() and (got[want] == full[want]).all()
        least = int(full[want[-1]])
        known = lexical.accumulate(postings, terms, times, weights, counts.frequency, 10, least)
        assert (known[want] == full[want]).all() and (known <= full).all()
    assert work.opened < 0.9 * holders and work.updates < work.read


def test_steps_of_the_ranking(spark):
    hits = spark.range(30_000).selectExpr("id % 3 AS _query", "id AS _task", "id AS _id", "id % 7 AS _score")
    got = lexical._ranked(hits, 4).collect()
    want = [(q, [i for i in range(30_000) if i % 3 == q and i % 7 == 6][:4]) for q in range(3)]
    assert sorted((r._query, r["rank"], r._id) for r in got) == [(q, n, i) for q, ids in want for n, i in enumerate(ids, 1)]
