import hashlib

from pyspark.sql import functions as F

from docloom.llm import line_dedup
from tests.llm import samples

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return samples.low(line.strip(SPACE))


def brute(rows, min_chars=20, min_documents=3):
    holders = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    owner = {k: max(d for d in h if d is not None) for k, h in holders.items() if len(h) >= min_documents}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or (doc is not None and doc >= owner[key(x)])]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def check(spark, rows, **options):
    docs = samples.frame(spark, rows)
    kept = line_dedup.with_kept_text(docs, **options)
    assert kept.columns == [*docs.columns, "_n_lines", "_n_dropped", "_kept"]
    samples.same(kept.select("doc_id", "_n_lines", "_n_dropped", "_kept").collect(), list(brute(rows, **options)))


def test_contract(spark):
    extra = [(50 + i, f"{samples.SHARED}\n\n \n{samples.SHARED} \nown {i}", "en", "s") for i in range(5)]
    check(spark, [*samples.texts(), *extra, (None, f"a\n{samples.SHARED}", None, None)])


def test_unicode_and_short_keys(spark):
    line = "ÉÀ È Straße with 20+ chars\xa0"
    rows = [(i, f"{line}\nshort\n\x0b{line.replace('S', 's')}", "en", "s") for i in range(4)] + [(9, line.lower(), "en", "s")]
    check(spark, rows)
    check(spark, rows, min_chars=3, min_documents=2)


def test_more_lines_than_a_bitmap(spark):
    long = "\n".join(samples.SHARED if i in (0, 7, 8, 32767, 32768, 40000) else str(i) for i in range(70_000))
    rows = [(1, long, "en", "s"), (2, samples.SHARED, "en", "s"), (3, f"x\n{samples.SHARED}", "en", "s")]
    check(spark, rows)
    bitmaps = line_dedup.keep_bitmaps(samples.frame(spark, rows)).filter("doc = 1").first()
    assert {k: len(v) for k, v in bitmaps.dropped.items()} == {1: 4096, 2: 905}


def test_hot_line(spark):
    rows = [(i, f"{samples.SHARED}\nown line of document {i}, and long", "en", "s") for i in range(500)]
    kept = line_dedup.with_kept_text(samples.frame(spark, rows, 8))
    assert kept.filter("_n_dropped = 1").count() == 499 and kept.filter(F.col("_kept").contains("shared")).first().doc_id == 499
    assert hashlib.sha256(b"").hexdigest() != kept.select(F.sha2("_kept", 256)).first()[0]


def test_lines_are_cut_once(spark):
    """Ranges of hashes are known beforehand, so that no sample of the lines is taken."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        read.add(1)
        return text

    rows = [(i, f"{samples.SHARED}\nown line of document {i}, and long", "en", "s") for i in range(40)]
    docs = samples.frame(spark, rows, 8).withColumn("text", passed("text"))
    gone = line_dedup.drop_positions(docs, "doc_id", "text", line_dedup.MIN_CHARS, line_dedup.MIN_DOCUMENTS)
    assert sorted(r.doc for r in gone.collect()) == list(range(39))
    assert read.value == 40


def test_empty(spark):
    assert line_dedup.with_kept_text(samples.empty(spark)).count() == 0
