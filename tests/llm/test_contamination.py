import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import contamination
from tests.llm import samples

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "The sea of rain, the tin of x1: the sea naïve the rain of tin!"), (20, "the of sea"), (3, None), (4, " ., "), (None, "lo lo"),
    (5, "THE OF SEA"), (1, "x1 x1 x1"), (6, "日本 été"), (7, "the the the the the the the the the the the the"),
]


def split(text):
    return WORDS.findall(samples.low(text))


def brute(text, window):
    words, hit, items = split(text), set(), set()
    for item, content in ITEMS:
        own = split(content)
        size = min(window or len(own), len(own))
        for k in range(len(own) - size + 1 if own and item is not None else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[k : k + size]:
                    hit |= set(range(p, p + size))
                    items.add(str(item))
    return len(words), len(hit), tuple(sorted(items))


def documents():
    rows = [r for r in samples.texts() if r[0] != 1004]
    for i, (_, text) in enumerate(ITEMS):
        rows.append((2000 + i, f"before it {text} and after {text or ''}", "en", "s1"))
    return [*rows, (3000, "sea THE of-rain; the tin of x1 the sea naïve the rain", "en", "s"), (3001, "of sea", "en", "s")]


@pytest.mark.parametrize(("window", "block_bytes"), [(10, 1 << 20), (10, 20), (4, 1 << 20), (None, 1)])
def test_exact(spark, window, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = samples.frame(spark, documents())
    found = contamination.with_findings(docs, items, window=window, block_bytes=block_bytes)
    assert found.columns == [*docs.columns, "_found"]
    got = [(r.doc_id, r._found.n_words, r.hit, tuple(r._found.items)) for r in found.withColumn("hit", contamination.n_hit(F.col("_found.spans"))).collect()]
    samples.same(got, [(r[0], *brute(r[1], window)) for r in documents()])


def test_partial_containment(spark):
    """At 0.8, against counting the shingles of every stretch."""
    item = [f"w{i}" for i in range(30)]
    variants = [item, item[:15] + ["other"] + item[16:], item[:10] + ["a"] + item[11:20] + ["b"] + item[21:], item[3:], item[8:], item[::-1]]
    rows = [(i, " ".join(["pad"] * i + v + ["end"]), "en", "s") for i, v in enumerate(variants)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = contamination.with_findings(samples.frame(spark, rows), items, window=None, containment=0.8)
    wanted = {tuple(item[i : i + 5]) for i in range(26)}
    for row in found.collect():
        words = row.text.split()
        best = max(
            len({tuple(words[i : i + 5]) for i in range(a, min(a + 26, len(words) - 4))} & wanted) for a in range(len(words))
        )
        assert bool(row._found.items) == (best >= 21), row.doc_id


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination.with_findings(samples.empty(spark), items).count() == 0
    nothing = contamination.with_findings(samples.frame(spark), items.limit(0))
    assert nothing.filter(F.size("_found.items") > 0).count() == 0 and nothing.count() == len(samples.texts())
