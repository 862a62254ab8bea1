import random

import pytest

from docloom.operators import blocks, fulltext
from docloom.schemas import CHUNK_ID_STRIDE

CHUNKS = "chunk_id long, file_id long, snippet string"


def corpus(seed, files=500):
    """Common words everywhere; a few files full of the asked ones, which are the best matches."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shares = [1 / (i + 1) for i in range(40)]
    rows = []
    for f in range(files):
        for c in range(rng.randint(1, 6)):
            text = rng.choices(words, shares, k=rng.randint(3, 30))
            if f % 120 == 7:
                text = ["w0"] * 9 + ["w1"] * 7 + ["w2"] * 5
            rows.append((f * CHUNK_ID_STRIDE + c, f, " ".join(text)))
    rows += [(files * CHUNK_ID_STRIDE + c, files, "w0 w1 tail") for c in range(900)]  # a file longer than a block, all ties
    return rows


ASKED = ["w0", "w0 w1", "w2 w1 w0", "w0 w0 w3", "w30 w0", "w9 nowhere", "tail", "", "w39", "w5 w6 w7"]


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.file_id, r.bm25) for r in df.collect())


@pytest.mark.parametrize(("k", "size"), [(3, 8), (10, 64), (50, 16), (2000, 64)])
def test_same_as_scoring_everything(spark, k, size):
    index = fulltext.written_index(spark.createDataFrame(corpus(k), CHUNKS).repartition(4))
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")
    reads = blocks.Reads()
    got = rows_of(blocks.search(queries, blocks.store(index, 501, size), k, reads=reads))
    assert got == rows_of(fulltext.bm25_search(queries, index, k))
    if k == 3:
        assert 0 < reads.read < 0.7 * reads.of and reads.rounds > 1


def test_restricted(spark):
    index = fulltext.written_index(spark.createDataFrame(corpus(1), CHUNKS).repartition(4))
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")

    def even(rows):
        return rows.filter("file_id % 2 = 0")

    got = rows_of(blocks.search(queries, blocks.store(index, 501, 32), 5, even))
    assert got == rows_of(fulltext.bm25_search(queries, index, 5, even))


def test_blocks_are_bounded_and_whole(spark):
    index = fulltext.written_index(spark.createDataFrame(corpus(2), CHUNKS).repartition(4))
    stored = blocks.store(index, 501, 32)
    assert stored.blocks.selectExpr("sum(n)").first()[0] == index.postings.count()
    assert stored.blocks.selectExpr("max(n)").first()[0] <= 32 * 6
    head = stored.blocks.select("term", "block", "most_tf")
    assert "entries" not in head._jdf.queryExecution().executedPlan().toString()


def test_postings_are_dealt_once(spark, monkeypatch):
    index = fulltext.written_index(spark.createDataFrame(corpus(2, 100), CHUNKS).repartition(4))
    plans, write = [], blocks.written

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *rest)

    monkeypatch.setattr(blocks, "written", watched)
    whole = blocks.store(index, 101, 32).blocks
    monkeypatch.setattr(blocks, "PART_CHUNKS", 100)
    parted = blocks.store(index, 101, 32).blocks
    assert [plan.count("Exchange") for plan in plans] == [1, 1]
    heads = ["term_bucket", "term", "block", "n", "most_tf", "least_len"]
    assert whole.select(*heads).exceptAll(parted.select(*heads)).isEmpty() and whole.count() == parted.count()


def test_empty(spark):
    index = fulltext.written_index(spark.createDataFrame(corpus(3, 20), CHUNKS))
    none = spark.createDataFrame([], "query_id long, text string")
    assert blocks.search(none, blocks.store(index, 21)).count() == 0
    bare = fulltext.written_index(spark.createDataFrame([], CHUNKS))
    asked = spark.createDataFrame([(1, "w0")], "query_id long, text string")
    assert blocks.search(asked, blocks.store(bare, 0)).count() == 0
