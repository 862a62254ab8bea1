"""The pipeline next to a brute-force version of its stages."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import samples
from tests.llm.test_contamination import split
from tests.llm.test_line_dedup import brute as without_shared_lines

WORDS = "water stone letter morning garden winter silver table window summer paper river market number branch".split()


def prose(rng, n=90):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "s", "ed", "er", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents of known fate."""
    rng = random.Random(6)
    fate, rows = {}, []

    def add(text, what, lang="en"):
        rows.append((len(rows), text, lang, "s1"))
        fate[len(rows) - 1] = what

    line = "A line of licence text that many documents share with each other."
    items = [(i, prose(rng, 25)) for i in range(5)]
    for _ in range(60):
        add(f"{prose(rng, 40)}\n{prose(rng, 50)}", "kept")
    for i in range(8):
        add(f"{prose(rng)}\n{line}", "kept")
    for i in range(6):
        add(rows[i][1], "copy")
        add(rows[i + 6][1].replace(" ", " added ", 1), "copy")
    for _, text in items:
        words = text.split()
        add(f"{prose(rng, 50)} {' '.join(words[3:16])} {prose(rng, 50)}", "leak")
    add("too short", "junk")
    add(None, "junk")
    add(" ".join(w + "###%%%" for w in prose(rng).split()), "junk")
    add("again and again " * 60, "junk")
    folder = str(tmp_path_factory.mktemp("planted"))
    samples.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, fate, rows, line


def test_stages(spark, planted):
    folder, fate, rows, line = planted
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left, texts = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
        left[name] = collections.Counter(fate[i] for i in {r.doc_id for r in docs.select("doc_id").collect()})
    assert left["quality_rules"] == {"kept": 68, "copy": 12, "leak": 5}
    after = {r[0]: r[3] for r in without_shared_lines([(i, t) for i, t in texts["quality_rules"].items()])}
    assert texts["line_dedup"] == after
    assert sum(line in t for t in texts["line_dedup"].values()) == 1
    assert left["simhash_near_dedup"] == {"kept": 68, "leak": 5}
    assert left["decontamination"] == {"kept": 68} == left["packing"]


def test_run_is_its_stages(spark, planted):
    folder, fate, *_ = planted
    got = corpus_pipeline.run(spark, folder)
    assert {fate[r.doc_id] for r in got.collect()} == {"kept"}
    assert got.filter(F.col("offset") + F.col("length") > 4096).count() == 0


def test_awkward_rows(spark, tmp_path):
    samples.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    assert split("A-b") == ["a", "b"]


def test_empty(spark, tmp_path):
    samples.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
