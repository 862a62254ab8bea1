import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx


def cut_at_word(text, limit):
    """A plain restatement of truncate_words."""
    if len(text) <= limit:
        return text
    head = text[:limit].rstrip()
    space = head.rfind(" ")
    return (head[:space] if space > limit * 0.7 else head) + "…"


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_truncate_words(spark):
    rng = random.Random(1)
    texts = ["", "a" * 150, "a" * 151, "a" * 149 + " b", " " * 200, "é" * 160, "x" * 106 + " " + "y" * 80]
    texts += ["x" * 105 + " " + "y" * 80, "word " * 40, "😀 " * 100]
    texts += [
        "".join(rng.choice("ab   \n\té\u2003\x1c") for _ in range(rng.randint(100, 330)))
        for _ in range(300)
    ]
    for limit in (150, 300):
        got = column(spark, texts, lambda c: tx.truncate_words(c, limit))
        assert got == [cut_at_word(t, limit) for t in texts]


def test_strip_is_unicode_aware(spark):
    texts = ["\u3000 a b\x1c\n", "\x85x\xa0", " \n\t ", "", "a" + " " * 50 + "b"]
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert column(spark, texts, tx.rstrip) == [t.rstrip() for t in texts]
    assert column(spark, texts, tx.is_blank) == [not t.strip() for t in texts]


@pytest.mark.parametrize(
    "path, category, language",
    [
        ("/a/b.md", "text", None),
        ("/a/b.PY", "code", "python"),
        ("/a/b.tar.hxx", "code", "cpp"),
        ("/a/.md", None, None),
        ("/a.md/b", None, None),
        ("/a/b.", None, None),
        ("c.tsx", "code", "typescript"),
        ("c.pdf", "pdf", None),
        ("c.odt", "office", None),
        ("c.webp", "image", None),
        ("c.mkv", "video", None),
        ("C:\\x\\y.rb", "code", "ruby"),
    ],
)
def test_categories(spark, path, category, language):
    assert column(spark, [path], tx.category_of) == [category]
    assert column(spark, [path], tx.language_of) == [language]


def test_decode_drops_bad_bytes_and_normalises_line_ends(spark):
    raw = [b"a\xffb\r\nc\rd\n", "é�".encode(), b"\xc3", b""]
    want = [b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for b in raw]
    assert column(spark, raw, tx.decode_text, "binary") == want


def test_highlight_marks_in_turn(spark):
    def mark(query):
        return lambda c: tx.highlight(c, F.lit(query))

    assert column(spark, ["Hello hello x"], mark("hello x")) == [
        "<mark>Hello</mark> <mark>hello</mark> x"
    ]
    assert column(spark, ["c++ (a.b) $1"], mark("c++ a.b $1")) == [
        "<mark>c++</mark> (<mark>a.b</mark>) <mark>$1</mark>"
    ]
    assert column(spark, ["École"], mark("école")) == ["<mark>École</mark>"]
    assert column(spark, ["plain"], mark("  ")) == ["plain"]
    assert column(spark, [r"a\Eb"], mark(r"\Eb")) == [r"a<mark>\Eb</mark>"]


def test_relative_age(spark):
    ages = [0.0, 59.0, 60.0, 3599.0, 3600.0, 86399.0, 86400.0, 604799.0, 604800.0]
    got = column(spark, ages, lambda c: tx.relative_age(F.lit(1e9) - c, F.lit(1e9)), "double")
    assert got == [
        "just now", "just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "6d ago", "2001-09-02",
    ]


def test_scores(spark):
    assert column(spark, [0.0, 1.0, 2.0, 2.5], tx.vector_score, "double") == [1.0, 0.5, 0.0, 0.0]
    assert column(spark, [-5.0, 0.0, 1.0], tx.keyword_score, "double") == [1.0, 1.0, 0.5]
    assert column(spark, [1.0, 0.456], tx.percent_score, "double") == ["100%", "46%"]


def test_position_meta(spark):
    meta = column(spark, ['say "hi"'], lambda c: tx.position_meta(line=F.lit(3), header=c))
    assert column(spark, meta, lambda c: tx.position_field(c, "line")) == ["3"]
    assert column(spark, meta, lambda c: tx.position_field(c, "header")) == ['say "hi"']


def test_running_sums(spark):
    arrays = [[], [5], list(range(700)), [1] * 256, [2] * 257]
    rows = spark.createDataFrame([(a,) for a in arrays], "a array<int>").select(tx.running_sums(F.col("a")).alias("s")).collect()
    assert [r.s for r in rows] == [[sum(a[:i]) for i in range(len(a))] for a in arrays]
