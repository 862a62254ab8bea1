import random

import pytest

from docloom.llm import url_filter
from docloom.llm.queries import URL_RULES

URLS = [
    "http://www.example.com/en/x?y=1", "https://EXAMPLE.com/en/", "http://a.example.com/en", "http://example.com/EN/", "http://com/", "http://x.net/es/#a",
    "http://net/fr/", "http://notnet/fr/", "http://x.notnet.org/es/", "ftp://a.b.net/es", "no scheme", None, "", "://", "http://", "http://a.com?x=/en/",
    "http://example.com/en/" + "long/" * 5000, "http://wwwexample.com/en/", "http://x.www.example.com/en/", "http://u@h.com:80/en/", "a\nb://x.net/es/é", "http://.net/es/",
    "http://x.net//es/", "http://www.example.com/en/x?y=1",
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("per_shard", [1, 2, 1000])
def test_rules(spark, per_shard):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string")
    got = url_filter.judge(pages, url_filter.build_index(rules, per_shard), "page_id", "url").collect()
    assert sorted(map(tuple, got)) == [(i, *brute(u, URL_RULES)) for i, u in enumerate(URLS)]


def test_many_rules(spark):
    rng = random.Random(2)
    hosts = [f"{a}{b}.{c}" for a in "abcdefgh" for b in "xyz" for c in ("com", "org")]
    rules = list({(h, p): (h, p, v) for h, p, v in ((rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b/"]), rng.choice(["allow", "block"])) for _ in range(300))}.values())
    urls = [f"http://{rng.choice(['', 'www.', 'm.x.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/ab', '/a/b/c'])}" for _ in range(500)]
    index = url_filter.build_index(spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string"), 40)
    assert len(index.shards) > 1
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "i long, url string"), index, "i", "url").collect()
    # Where keys of equal length fit, they are the same string; a block wins over an allow.
    for row in got:
        host, path, rule, verdict = brute(urls[row.i], [(h, p, v) for h, p, v in rules])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        of_key = {v for h, p, v in rules if h + p == rule}
        assert row.verdict == ("allow" if rule is None else "block" if "block" in of_key else "allow")


def test_equal_digests(spark, monkeypatch):
    """Different strings under one digest cannot decide for each other."""
    monkeypatch.setattr(url_filter, "_mapped", lambda path: (
        url_filter.np.array([5, 5]), url_filter.np.array([0, 2, 4]), url_filter.np.array([1, 0], "u1"), url_filter.np.frombuffer(b"aabb", "u1"),
    ))
    index = url_filter.UrlIndex((url_filter.Shard("x", 2, 5, 5),), (0,))
    assert url_filter._probe(index, [b"bb", b"cc", b"aa"], url_filter.np.array([5, 5, 5])).tolist() == [0, -1, 1]


def test_empty(spark):
    index = url_filter.build_index(spark.createDataFrame([], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert tuple(url_filter.judge(pages, index, "page_id", "url").first()) == (1, "a.com", "/", None, "allow")
    assert url_filter.judge(pages.limit(0), index, "page_id", "url").count() == 0
