import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from docloom.operators import fulltext, maintenance, prefixes
from docloom.sources.sizes import settled


@given(prefix=st.text(max_size=4), other=st.text(max_size=6))
def test_next_string(prefix, other):
    end = prefixes.next_string(prefix)
    inside = other >= prefix and (end is None or other < end)
    assert inside == other.startswith(prefix)
    assert (prefix + other) >= prefix and (end is None or prefix + other < end)


def strings(seed, n=600):
    rng = random.Random(seed)
    out = ["".join(rng.choice("abé￿\U0010ffff") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return [(i, None if i % 97 == 0 else s) for i, s in enumerate(out)]


@pytest.mark.parametrize("ranges", [None, 1, 7, 60])
@pytest.mark.parametrize("innermost", [False, True])
def test_pairs(spark, ranges, innermost):
    items, heads = strings(1), [(1000 + i, s) for i, s in strings(2, 40)] + [(2000, ""), (2001, "a"), (2002, "a"), (2003, None)]
    frames = [spark.createDataFrame(rows, "_key long, _string string") for rows in (items, heads)]
    got = sorted(tuple(r) for r in prefixes.prefix_pairs(*frames, innermost, ranges).collect())
    want = []
    for key, string in items:
        own = [(p, k) for k, p in heads if p is not None and string is not None and string.startswith(p)]
        if own and innermost:
            longest = max(len(p) for p, _ in own)
            own = [max(((p, k) for p, k in own if len(p) == longest), key=lambda x: x[1])]
        want += [(key, k) for _, k in own]
    assert got == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "_key long, _string string")
    some = spark.createDataFrame([(1, "a")], "_key long, _string string")
    for left, right in ((none, some), (some, none), (none, none)):
        assert prefixes.prefix_pairs(left, right).count() == 0


def test_keys_of_paths(spark):
    paths = ["/", "/a", "/a/", "/a/b", "/a-b", "/ab", "a", "a/b", "/a\x01b", "/a\x01b/c", "/a\x02", "/a\x02\x02b", "/a\x02/b", ""]
    keys = [r.k for r in spark.createDataFrame([(p,) for p in paths], "path string").select(prefixes.path_key("path").alias("k")).collect()]
    for path, key in zip(paths, keys, strict=True):
        for folder, start in zip(paths, keys, strict=True):
            root, plain = folder.rstrip("/"), path.rstrip("/")
            assert key.startswith(start) == (plain == root or plain.startswith(root + "/")), (path, folder)


LOCATIONS = "location_id long, path string, enabled boolean, added_at double"


def test_many_nested_roots(spark):
    """Roots inside one another, far more than a row could look up: the innermost owns, and no row is multiplied by its depth."""
    rng = random.Random(7)
    folders = {"/r"}
    while len(folders) < 20_000:
        folders.add(rng.choice(list(folders)[:200] if len(folders) > 200 else list(folders)) + f"/f{rng.randint(0, 999)}")
    deep = "/deep" + "".join(f"/{i}" for i in range(300))
    folders |= {deep.rsplit("/", n)[0] for n in range(300)}
    roots = sorted(folders)
    locations = spark.createDataFrame([(i, p, True, 0.0) for i, p in enumerate(roots)], LOCATIONS).repartition(4)
    paths = [rng.choice(roots) + f"/x{i}.md" for i in range(3000)] + [deep + "/y.md", "/r", "/rr/x.md", "/other.md"]
    number = {p: i for i, p in enumerate(roots)}

    def owner(path):
        while path:
            if path in number:
                return number[path]
            path = path.rpartition("/")[0]
        return None

    frame = spark.createDataFrame([(p, 1) for p in paths], "path string, size long").repartition(3)
    found = maintenance.assign_location(frame, locations)
    got = {r.path: r.location_id for r in found.collect()}
    assert got == {p: owner(p) for p in paths}
    assert "Generate explode(transform" not in found._jdf.queryExecution().executedPlan().toString()


def test_same_for_few_and_many(spark):
    rows = [(1, "/a", True, 0.0), (2, "/a/b/", True, 0.0), (3, "/", True, 0.0), (4, "/a-b", True, 0.0), (5, "rel", True, 0.0)]
    locations = spark.createDataFrame(rows, LOCATIONS)
    paths = [("/a/x",), ("/a/b/c",), ("/a/b",), ("/a-b/x",), ("/z",), ("rel/x",), ("relx",), ("/a/bc",), ("/a/x",)]
    frame = spark.createDataFrame(paths, "path string")
    few = sorted(map(repr, maintenance.assign_location(frame, locations).select("path", "location_id").collect()))
    assert few == sorted(map(repr, maintenance.assign_in_order(frame, locations).select("path", "location_id").collect()))
    assert len(few) == 9


CHUNKS = "chunk_id long, file_id long, snippet string"


def test_prefix_reads_an_interval(spark):
    rng = random.Random(3)
    rows = [(i, i, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(8))) for i in range(400)]
    index = fulltext.written_index(spark.createDataFrame(rows, CHUNKS).repartition(4))
    asked = ["ab", "abc", "e", "zz", "abcde"]
    phrases = spark.createDataFrame([(i, p, 1) for i, p in enumerate(asked)], "query_id long, phrase string, n_times int")
    wanted = settled(phrases.select("phrase").distinct(), "prefixes")
    terms = {t for _, _, s in rows for t in s.split()}
    got = {(r.phrase, r.term) for r in fulltext.prefix_terms(wanted, index).collect()}
    assert got == {(p, t) for p in asked for t in terms if t.startswith(p)}
    plan = index.terms.filter(prefixes.in_intervals(index.terms["term"], asked))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(term,ab)" in pushed and "LessThan(term,ac)" in pushed and "abc" not in pushed
    hits = {(r.phrase, r.chunk_id): (r.starts, r.tf) for r in fulltext.prefix_hits(phrases, index).collect()}
    want = {}
    for i, _, snippet in rows:
        for p in asked:
            if starts := [n for n, t in enumerate(snippet.split()) if t.startswith(p)]:
                want[p, i] = starts, len(starts)
    assert hits == want
