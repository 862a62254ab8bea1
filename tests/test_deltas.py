import random

from pyspark.sql import functions as F

from docloom.operators import deltas, fulltext

CHUNKS = "chunk_id long, file_id long, snippet string"


def rows(spark, folder):
    return spark.read.parquet(f"{folder}/a/terms").count()


def frame(spark, chunks):
    return spark.createDataFrame([(i, i, s) for i, s in sorted(chunks.items())], CHUNKS).repartition(3)


def test_after_batches_as_a_fresh_build(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]

    def text():
        return " ".join(rng.choices(words, [1 / (i + 1) for i in range(3000)], k=rng.randint(0, 30)))

    now = {i: text() for i in range(1200)}
    none = frame(spark, {0: ""}).limit(0)
    stats = deltas.Statistics(spark, str(tmp_path / "a"))
    stats.append(frame(spark, now), none)
    base = rows(spark, tmp_path)
    for step in range(3):
        gone = rng.sample(sorted(now), 10)
        changed = {i: text() for i in rng.sample(sorted(set(now) - set(gone)), 10)}
        new = {10_000 * (step + 1) + i: text() for i in range(5)}
        before = rows(spark, tmp_path)
        stats.append(frame(spark, changed | new), frame(spark, {i: now[i] for i in [*gone, *changed]}))
        batch = {w for i in [*gone, *changed] for w in now[i].split()} | {w for s in (changed | new).values() for w in s.split()}
        assert rows(spark, tmp_path) - before <= len(batch) < base / 2
        now = {i: s for i, s in (now | changed | new).items() if i not in gone}
        fresh = frame(spark, now)
        for own in (stats, stats.folded(str(tmp_path / f"folded{step}"))):
            assert sorted(map(tuple, own.terms().collect())) == sorted(map(tuple, fulltext.term_stats(fulltext.postings(fresh)).collect()))
            assert tuple(own.corpus().first()) == tuple(fulltext.corpus_stats(fresh).first())


def test_everything_removed(spark, tmp_path):
    chunks = frame(spark, {1: "a b a", 2: ""})
    stats = deltas.Statistics(spark, str(tmp_path / "a"))
    stats.append(chunks, chunks.limit(0))
    stats.append(chunks.limit(0), chunks)
    assert stats.terms().count() == 0 and tuple(stats.corpus().first()) == (0, 0, None)


def test_what_a_batch_leaves_is_not_written(spark):
    old, new = frame(spark, {1: "same words here"}), frame(spark, {1: "same words there"})
    assert sorted(map(tuple, deltas.term_changes(new, old).collect())) == [("here", -1, -1), ("there", 1, 1)]
    assert tuple(deltas.corpus_changes(new, old).first()) == (0, 0)


def test_a_batch_is_cut_into_tokens_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def counted(text):
        seen.add(1)
        return text

    counted = counted.asNondeterministic()
    chunks = frame(spark, {i: "a b a" for i in range(50)}).withColumn("snippet", counted("snippet"))
    stats = deltas.Statistics(spark, str(tmp_path / "a"))
    stats.append(chunks, frame(spark, {0: "a"}))
    assert seen.value == 50
    assert tuple(stats.corpus().first()) == (49, 149, 149 / 49)
