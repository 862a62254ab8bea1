"""SQLite's FTS5, present in the standard library, is the judge of matching and ranking here."""

import random
import sqlite3
import time
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions.tokens import tokenize
from docloom.operators import fulltext
from docloom.sources import sizes

WORDS = ["the", "of", "cat", "dog", "hello", "help", "hel", "world", "Élan", "über", "naïve", "x1", "a_b", "zoo"]


@pytest.fixture(scope="module")
def snippets():
    rng = random.Random(5)
    out = []
    for i in range(400):
        n = rng.randint(0, 25)
        out.append(" ".join(rng.choice(WORDS[: 4 + i % 11]) for _ in range(n)))
    # One word in a third of all places.
    out += ["the " * rng.randint(1, 30) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def fts(snippets):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(s)")
    con.executemany("INSERT INTO t(rowid, s) VALUES (?, ?)", enumerate(snippets))

    def ask(match):
        rows = con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall()
        return {r: round(b, 6) for r, b in rows}

    return ask


@pytest.fixture(scope="module")
def index(spark, snippets):
    chunks = spark.createDataFrame(
        [(i, i // 3, s) for i, s in enumerate(snippets)], "chunk_id long, file_id long, snippet string"
    )
    return fulltext.written_index(chunks.repartition(4))


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def by_query(matches):
    out = {}
    for r in matches.collect():
        out.setdefault(r.query_id, {})[r.chunk_id] = round(r.bm25, 6)
    return out


def close(got, want):
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=2e-6)


def test_tokens_are_those_of_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(s)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    texts = [chr(c) for c in (*range(0x20, 0x2E0), *range(0x370, 0x530), *range(0x1E00, 0x1F00), 0x4E00, 0x1F600, 0xE000)]
    texts += ["parse_json(a-b)", "Éléphant", "éa", "x² ½", "don't", "日本 語", "ÀÇÑ ß"]
    con.executemany("INSERT INTO t(rowid, s) VALUES (?, ?)", enumerate(texts, 1))
    want = {i: [] for i in range(1, len(texts) + 1)}
    for term, doc, _, offset in con.execute("SELECT * FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    df = spark.createDataFrame(list(enumerate(texts, 1)), "i int, s string")
    got = {r.i: r.t for r in df.select("i", tokenize(F.col("s")).alias("t")).collect()}
    different = {texts[i - 1]: (got[i], want[i]) for i in want if got[i] != want[i]}
    # Code points that are younger than SQLite's tables.
    young = {t for t in different if unicodedata.ucd_3_2_0.category(t) == "Cn"}
    assert {k: v for k, v in different.items() if k not in young} == {}


def test_postings(spark):
    chunks = spark.createDataFrame([(7, 1, "b a b"), (8, 1, ""), (9, 2, "...")], "chunk_id long, file_id long, snippet string")
    rows = sorted(fulltext.postings(chunks).collect())
    assert [(r.term, r.chunk_id, r.chunk_len, r.positions, r.tf) for r in rows] == [
        ("a", 7, 3, [1], 1), ("b", 7, 3, [0, 2], 2),
    ]
    stats = fulltext.corpus_stats(chunks).first()
    assert (stats.n_chunks, stats.n_tokens, stats.avg_len) == (3, 3, 1.0)


SEARCHES = ["the", "hello world", "the the of", "cat", "naive uber", "zoo the", "missing", "the missing", "  ", "ELAN", "the of cat dog"]


def test_postings_of_a_long_snippet(spark):
    """What a snippet costs follows its length: comparing each of its words with all others would take minutes."""
    words = [f"w{i}" for i in range(40_000)]
    text = " ".join([*words, *words[:1000]])
    chunks = spark.createDataFrame(
        [(1, 7, text), (2, 7, None), (3, 8, ""), (4, 8, "b a b")], "chunk_id long, file_id long, snippet string"
    ).coalesce(1)
    began = time.monotonic()
    got = {(r.chunk_id, r.term): (r.file_id, r.chunk_len, r.positions, r.tf) for r in fulltext.postings(chunks).collect()}
    assert time.monotonic() - began < 30
    expected = {(1, w): (7, 41_000, [i, 40_000 + i] if i < 1000 else [i], 1 + (i < 1000)) for i, w in enumerate(words)}
    assert got == expected | {(4, "a"): (8, 3, [1], 1), (4, "b"): (8, 3, [0, 2], 2)}
    assert fulltext.postings(chunks.limit(0)).count() == 0


def test_all_words(spark, index, fts):
    got = by_query(fulltext.bm25_search(queries(spark, SEARCHES), index, top_k=1000))
    for i, text in enumerate(SEARCHES):
        close(got.get(i, {}), fts(text) if text.strip() else {})


def test_all_words_when_nothing_is_small(spark, index, fts, monkeypatch):
    monkeypatch.setattr(sizes.settled, "__defaults__", (2,))
    got = by_query(fulltext.bm25_search(queries(spark, SEARCHES), index, top_k=1000))
    for i, text in enumerate(SEARCHES):
        close(got.get(i, {}), fts(text) if text.strip() else {})
    phrases = ["hello world", "the the", "the of cat"]
    asked = fulltext.query_phrase(queries(spark, phrases))
    hits = fulltext.phrase_hits(asked, index)
    got = by_query(fulltext.match_all(asked, hits, index.stats))
    for i, text in enumerate(phrases):
        close(got.get(i, {}), fts(f'"{text}"'))


def test_same_words_share_one_match(spark, index):
    got = by_query(fulltext.bm25_search(queries(spark, ["cat dog", "Dog  cat", "cat dog!"]), index, 1000))
    assert got[0] and got[0] == got[1] == got[2]


def test_top_k_and_ties(spark, index):
    rows = fulltext.bm25_search(queries(spark, ["the"]), index, top_k=5).orderBy("rank").collect()
    every = fulltext.bm25_search(queries(spark, ["the"]), index, top_k=1000).collect()
    best = sorted((r.bm25, r.chunk_id) for r in every)[:5]
    assert [(r.bm25, r.chunk_id) for r in rows] == best
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5]


def test_any_word(spark, index, fts):
    texts = ["hello cat", "the missing", "missing"]
    terms = fulltext.query_terms(queries(spark, texts))
    got = by_query(fulltext.match_any(terms, fulltext.term_hits(terms, index), index.stats))
    for i, text in enumerate(texts):
        close(got.get(i, {}), fts(" OR ".join(text.split())))


def test_not(spark, index, fts):
    terms = fulltext.query_terms(queries(spark, ["hello", "cat"]))
    found = fulltext.match_any(terms, fulltext.term_hits(terms, index), index.stats)
    unwanted = spark.createDataFrame([(0, "the"), (1, "dog")], "query_id long, phrase string")
    excluded = fulltext.term_hits(unwanted, index).join(unwanted, "phrase")
    got = by_query(fulltext.match_not(found, excluded))
    close(got[0], fts("hello NOT the"))
    close(got[1], fts("cat NOT dog"))


PHRASES = ["hello world", "the of", "the the", "the the the", "cat dog cat", "a_b", "zoo", "of missing", "dog the cat of"]


def test_phrases(spark, index, fts):
    asked = fulltext.query_phrase(queries(spark, PHRASES))
    got = by_query(fulltext.match_all(asked, fulltext.phrase_hits(asked, index), index.stats))
    for i, text in enumerate(PHRASES):
        close(got.get(i, {}), fts(f'"{text}"'))


def test_phrase_and_word(spark, index, fts):
    asked = spark.createDataFrame([(0, "hello world", 1), (0, "the", 1)], "query_id long, phrase string, n_times int")
    got = by_query(fulltext.match_all(asked, fulltext.phrase_hits(asked, index), index.stats))
    close(got.get(0, {}), fts('"hello world" the'))


def test_prefixes(spark, index, fts):
    prefixes = ["hel", "h", "zzz", "elan", "t"]
    asked = fulltext.query_phrase(queries(spark, prefixes))
    got = by_query(fulltext.match_any(asked, fulltext.prefix_hits(asked, index), index.stats))
    for i, prefix in enumerate(prefixes):
        close(got.get(i, {}), fts(prefix + "*"))


def test_first_token(spark, index, fts):
    texts = ["the", "hello", "the of"]
    asked = fulltext.query_phrase(queries(spark, texts))
    hits = fulltext.phrase_hits(asked, index)
    got = by_query(fulltext.match_all(asked, fulltext.first_token_hits(hits), index.stats))
    close(got.get(0, {}), fts("^the"))
    close(got.get(1, {}), fts("^hello"))
    close(got.get(2, {}), fts('^"the of"'))


NEAR = [("the", "of", 10), ("hello", "world", 0), ("cat", "dog", 2), ("the", "cat", 1), ("the of", "cat", 3), ("zoo", "missing", 5)]


def test_near(spark, index, fts):
    pairs = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(NEAR)], "query_id long, left string, right string, distance int"
    )
    phrases = pairs.select(F.explode(F.array("left", "right")).alias("phrase"))
    hits = fulltext.phrase_hits(phrases, index)
    got = by_query(fulltext.match_near(pairs, hits, index.stats))
    for i, (left, right, distance) in enumerate(NEAR):
        close(got.get(i, {}), fts(f'NEAR("{left}" "{right}", {distance})'))


def test_restriction_leaves_frequencies_alone(spark, index, fts):
    def restrict(rows):
        return rows.filter("file_id < 50")

    got = by_query(fulltext.bm25_search(queries(spark, ["hello the"]), index, 1000, restrict))
    close(got[0], {c: b for c, b in fts("hello the").items() if c // 3 < 50})


GROUPS = [
    (["the", "of", "cat"], 3), (["dog", "the", "of", "cat"], 5), (["hello", "the", "the"], 2), (["of cat", "the", "dog"], 4),
    (["the of", "cat dog", "hello"], 10), (["elan", "uber", "naive"], 6), (["the", "nowhere", "of"], 9), (["cat", "dog"], 0),
    (["the", "the", "the", "the"], 1), (["x1", "a b", "zoo", "world"], 20),
]


def test_near_of_many_phrases(spark, index, fts):
    groups = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(GROUPS)], "query_id long, phrases array<string>, distance int")
    phrases = groups.select(F.explode("phrases").alias("phrase")).distinct()
    hits = fulltext.phrase_hits(phrases, index)
    got = by_query(fulltext.match_near_group(groups, hits, index.stats))
    for i, (group, distance) in enumerate(GROUPS):
        quoted = " ".join(f'"{p}"' for p in group)
        assert got.get(i, {}) == fts(f"NEAR({quoted}, {distance})"), group
    assert sum(len(v) > 0 for v in got.values()) >= 7


def test_occurrences_that_take_part():
    """Those that FTS5 highlights."""
    rng = random.Random(2)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(s)")
    for _ in range(600):
        phrases, distance = "abcd"[: rng.choice([2, 2, 3, 4])], rng.randint(0, 4)
        words = [rng.choice("abcdx") for _ in range(rng.randint(1, 25))]
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (" ".join(words),))
        match = f"NEAR({' '.join(phrases)}, {distance})"
        row = con.execute("SELECT highlight(t, 0, '<', '>') FROM t WHERE t MATCH ?", (match,)).fetchone()
        want, inside = [], False
        for i, word in enumerate(row[0].split() if row else []):
            inside = inside or word.startswith("<")
            if inside:
                want.append(i)
            inside = inside and not word.endswith(">")
        starts = [[i for i, w in enumerate(words) if w == p] for p in phrases]
        kept = fulltext.near_sweep(starts, [1] * len(phrases), distance)
        assert sorted({i for own in kept for i in own}) == want, (words, match)


def test_corpus_stats_from_the_postings(spark):
    """Summed up in the postings they are those of the chunks, of which some have no tokens."""
    schema = "chunk_id long, file_id long, snippet string"
    rows = [(1, 1, "the cat and the dog"), (2, 1, "..."), (3, 2, ""), (4, 2, "x1 \u00fcber")]
    for some in (rows, rows[1:3], []):
        chunks = spark.createDataFrame(some, schema)
        got = fulltext.corpus_stats(chunks, fulltext.postings(chunks))
        assert got.collect() == fulltext.corpus_stats(chunks).collect()


def test_only_groups_within_reach_are_swept(monkeypatch):
    """The sweep of a whole batch gives what sweeping each of its groups does, and sweeps those that the ends of the starts leave open."""
    rng = random.Random(9)
    groups = []
    for n in range(600):
        phrases = [rng.choice(["the", "of the", "a b c", "cat"]) for _ in range(rng.randint(1, 4))]
        starts = [sorted(rng.sample(range(60), rng.choice([1, 1, 1, 2, 5]))) for _ in phrases]
        if n % 50 == 0:
            starts[-1] = []
        members = [{"i": i, "phrase": p, "starts": s} for i, (p, s) in enumerate(zip(phrases, starts))]
        groups.append({"query_id": n, "chunk_id": n % 7, "file_id": 1, "chunk_len": 60, "distance": rng.randint(0, 9), "phrases": members})
    kind = pa.list_(pa.struct([("i", pa.int32()), ("phrase", pa.string()), ("starts", pa.list_(pa.int32()))]))
    columns = {k: pa.array([g[k] for g in groups], kind if k == "phrases" else pa.int64()) for k in groups[0]}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sweep, swept = fulltext.near_sweep, []
    expected = []
    for g in groups:
        phrases, starts = [p["phrase"] for p in g["phrases"]], [p["starts"] for p in g["phrases"]]
        kept = sweep(starts, [p.count(" ") + 1 for p in phrases], g["distance"])
        expected += [(g["query_id"], p, k) for p, k in zip(phrases, kept) if kept[0]]
    monkeypatch.setattr(fulltext, "near_sweep", lambda starts, *rest: swept.append(starts) or sweep(starts, *rest))
    got = [r for part in fulltext._sweep_groups(iter([batch.slice(0, 0), batch.slice(0, 100), batch.slice(100)])) for r in part.to_pylist()]
    assert [(r["query_id"], r["phrase"], r["starts"]) for r in got] == expected
    assert 0 < len(swept) < 300 and all(any(len(s) > 1 for s in starts) for starts in swept)
