import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import bpe_automaton, queries
from tests.llm import samples

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe_automaton.Codec(PATH)


AWKWARD = [
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "<|endoftext|><|endoftext|>", "Élan Élan İstanbul ΣΑΣ ß ﬁ Å", "日本語 が",
    "'S don't I'LL we've x'd", "12345 x²½ ٣", "tab\t\n  x", "🦜🦜 ‍", "ha" * 300 + "h", "a" * 701, "||| ____ ...", " ", "",
    "aaaa aaa aa a", "\0 \x01",
]


def test_awkward_texts(tokenizer, codec):
    for text in AWKWARD:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("aeinorst' hlAé.|"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(tokenizer, codec, text):
    assert codec.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def merged(word, merges, end):
    """Apply every merge in order, from left to right."""
    tokens = [*word[:-1], word[-1] + end]
    for u, v in merges:
        i, out = 0, []
        while i < len(tokens):
            if tokens[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


@pytest.mark.parametrize("end", ["", "$"])
@pytest.mark.parametrize("seed", range(12))
def test_random_merges(seed, end):
    """The paths of the automaton are the encodings, also with merges of equal halves and with merges that never apply."""
    rng = random.Random(seed)
    symbols = ["a", "b", "c"] + (["a$", "b$", "c$"] if end else [])
    known, merges = list(symbols), []
    while len(merges) < 14:
        u, v = rng.choice(known), rng.choice(known)
        if "$" in u or u + v in known:
            continue
        merges.append((u, v))
        known.append(u + v)
    automaton = bpe_automaton.Automaton(symbols, merges, end)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        want = merged(word, merges, end)
        path = automaton.path(word)
        assert [automaton.labels[x] for x in path] == want, (merges, word)
        assert all(automaton.allows(a, b) for a, b in zip([bpe_automaton.ANYTHING, *path], path, strict=False))
    # Every path of two arcs is the encoding of what it spells.
    for x in known:
        for y in known:
            if x in automaton.state and (not end or y.endswith(end)):
                ok = automaton.allows(automaton.number[x], automaton.number[y])
                real = merged((x + y).replace("$", ""), merges, end) == [x, y]
                alive = merged(x, merges, "") == [x]
                assert ok == real or not alive


def test_improper_vocabularies():
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(["a", "b"], [("ab", "a"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(["a", "b"], [("a", "b"), ("ab", "b"), ("b", "b"), ("a", "bb")])


def test_long_word(tokenizer, codec):
    rng = random.Random(1)
    word = "".join(rng.choice("theandrsi") for _ in range(50_000))
    assert codec.encode(word) == tokenizer.encode(word, add_special_tokens=False).ids


def test_documents(spark, tokenizer):
    rows = samples.texts() + [(2000 + i, t, "en", "s1") for i, t in enumerate(AWKWARD)]
    docs = samples.frame(spark, rows)
    encoded = bpe_automaton.encode(docs, add=tuple(bpe_automaton.OUTPUTS))
    assert encoded.columns == [*docs.columns, *bpe_automaton.OUTPUTS]
    got = encoded.collect()
    want = {}
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids
        want[row[1]] = len(ids), ids, " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, rows))
    for r in got:
        assert (r["_n_tokens"], r["_ids"], r["_id_text"], r["_decoded"]) == want[r["text"]]
        assert r["fp"] == "clash"
    back = bpe_automaton.decode(encoded.select("text", "_ids")).collect()
    assert all(r["_decoded"] == want[r["text"]][3] for r in back) and len(back) == len(rows)


def test_decode_nulls_and_errors(spark):
    ids = spark.createDataFrame([(1, [320, 1125]), (2, None), (3, [])], "k long, _ids array<int>")
    got = {r.k: r._decoded for r in bpe_automaton.decode(ids).collect()}
    assert got[2] is None and got[3] == "" and got[1].count(" ") == 1
    for wrong in (-1, 49_408):
        with pytest.raises(Exception):  # noqa: B017
            bpe_automaton.decode(spark.createDataFrame([(1, [wrong])], "k long, _ids array<int>")).collect()


def test_empty(spark):
    assert bpe_automaton.encode(samples.empty(spark)).count() == 0
    assert bpe_automaton.decode(spark.createDataFrame([], "_ids array<int>")).count() == 0


def test_query(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    samples.same(queries.QUERIES["op11_bpe_automaton"](spark, folder).collect(), want)
