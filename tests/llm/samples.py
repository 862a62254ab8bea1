"""Documents with every awkward case, and plain restatements of the contracts."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: Names that the operators use inside, as further columns of the input.
CLASHES = ("id", "fp", "node", "cell", "n_words", "key", "line", "pos", "length", "size", "spans", "items", "words", "counts", "h1", "rule")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES],
])

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHARED = "This line, of more than twenty characters, is shared."


def texts(seed: int = 0, n: int = 60) -> list[tuple[int | None, str | None, str | None, str | None]]:
    rng = random.Random(seed)
    words = ["the", "of", "sea", "été", "über", "x1", "Ba,", "lo.", "naïve", "日本", "a|b", "##", "kilo-", "THE", "rain", "tin"]
    rows: list[tuple[int | None, str | None, str | None, str | None]] = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 3, 9, 30, 80])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(size))
        if i % 4 == 0:
            text += f"\n  {SHARED.upper() if i % 8 else SHARED}\t\nmore\n"
        rows.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None])))
    rows += [(6, rows[2][1], "en", "s1"), (6, rows[2][1], "en", "s1")]  # a row that repeats
    rows += [(9, "the same id with another text " * 3, "en", "s1"), (None, "no id at all", "en", "s2"), (None, None, None, None)]
    rows += [(1000, None, "en", "s1"), (1001, "", "en", "s1"), (1002, " \n\t\r\x0b\x0c ", "en", "s1"), (1003, rows[20][1], "fr", "s2")]
    rows += [(1004, " ".join(rng.choice(words) for _ in range(30_000)), "en", "s3"), (1005, "x" * 70_000, "en", "s3")]
    return rows


def frame(spark, rows=None, partitions: int = 3):
    rows = texts() if rows is None else rows
    full = [(i, t, lang, source, len(t or ""), *["clash"] * len(CLASHES)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def same(got, want) -> None:
    key = repr
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert got == want, ([g for g in got if g not in want][:3], [w for w in want if w not in got][:3], len(got), len(want))
