import collections
import math
import re

import public_tokenizers
import sentencepiece

from docloom.llm import quality
from docloom.llm.columns import once
from tests.llm import samples


def counts(text):
    text = text or ""
    words = samples.WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if samples.WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, r, n < 50 or 100 * r > 50 * n)


def test_counts(spark):
    measured = quality.with_measures(samples.frame(spark), keep=["doc_id", "n_words"]).withColumn("failed", quality.base_failed())
    assert measured.columns == ["doc_id", "n_words", "_quality", "failed"]
    got = [(r.doc_id, *list(r._quality)[:5], r.failed) for r in measured.collect()]
    samples.same(got, [(r[0], *counts(r[1])) for r in samples.texts()])


def test_fertility(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [r for r in samples.texts() if r[0] is not None and r[0] < 180 and r[0] % 2 and r[0] != 9]
    rows += [(9001, "plain english words, again and again words", "en", "s"), (9002, "日本語 ☃ テキスト", "ja", "s")]
    got = {r.doc_id: r._quality for r in quality.with_measures(samples.frame(spark, rows)).collect()}
    for doc, text, *_ in rows:
        ids = [i for w in samples.WORD.findall(text) for i in model.encode(w)]
        q = got[doc]
        assert q.n_tokens == len(ids)
        if ids:
            assert math.isclose(q.byte_share, sum(map(model.is_byte, ids)) / len(ids))
            letters = sum(c > "\x7f" or c.isalpha() for c in text)
            assert math.isclose(q.letters_per_token, letters / len(ids))
            c = collections.Counter(ids)
            entropy = -sum(v / len(ids) * math.log2(v / len(ids)) for v in c.values())
            assert math.isclose(q.entropy, entropy / math.log2(len(c)) if len(c) > 1 else 1.0, abs_tol=1e-9)


def test_bands(spark):
    """Text among many of its kind stays, symbols do not, and every language has its own bands."""
    import random

    rng = random.Random(4)
    words = "water stone letter morning garden winter silver table window summer paper river market number branch".split()
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "ing", "s", "ed"]) for _ in range(120))
    rows = [(i, text(), "en", "s") for i in range(60)] + [(100 + i, text() + " 日本", None, "s") for i in range(20)]
    rows += [(200, " ".join(w + "###$$$" for w in text().split()), "en", "s"), (201, " ".join("%09d" % rng.randrange(10**9) for _ in range(120)), None, "s")]
    judged = quality.judge(once(quality.with_measures(samples.frame(spark, rows)), "m"))
    assert {r.doc_id for r in judged.filter("NOT _kept").collect()} == {200, 201}
    docs = samples.frame(spark, rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 80


def test_few_characters_outside_the_vocabulary(spark):
    """Among texts without byte tokens a few such characters are no fault; a text made of them is."""
    import random

    rng = random.Random(5)
    words = "water stone letter morning garden winter silver table window summer paper river market number branch".split()
    text = lambda n: [rng.choice(words) + rng.choice(["", "", "ing", "s", "ed"]) for _ in range(n)]
    rows = [(i, " ".join(text(120)), "en", "s") for i in range(60)]
    odd = ["\U0001f99c", "\u20bf", "\u9f98"]
    rows += [(100 + i, " ".join([*text(60), c, *text(60)]), "en", "s") for i, c in enumerate(odd)]
    rows += [(110, " ".join([*text(80), *odd]), "en", "s"), (111, " ".join([*text(4000), odd[0]]), "en", "s")]
    rows += [(200, " ".join(w + odd[2] * 2 for w in text(120)), "en", "s")]
    judged = quality.judge(once(quality.with_measures(samples.frame(spark, rows)), "m"))
    got = {r.doc_id: r for r in judged.filter("doc_id >= 100").collect()}
    assert all(r._quality.byte_share > 0 for r in got.values())
    assert {i for i, r in got.items() if not r._kept} == {200}
    assert quality.keep_good(samples.frame(spark, rows)).count() == 65


def test_very_long_text_of_many_words(spark):
    """More distinct words than fit into packed windows go the other way."""
    import numpy as np

    codes = np.array([0, 1, 2, 3, 0, 1, 2, 5, 6, 7])
    first = np.array([0, 10])
    assert quality._repeat_words(codes, first, 10).tolist() == quality._repeat_words(codes, first, 1 << 22).tolist() == [6]


def test_empty(spark):
    assert quality.keep_good(samples.empty(spark)).count() == 0
    judged = quality.judge(once(quality.with_measures(samples.frame(spark, [(1, None, None, None)])), "m")).first()
    assert judged._base_failed and not judged._kept
