import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import textscan, vocab

ODD = [
    "", "a", " a", "a ", "  a  b\n\nc \n", "x  y   z", "'s 's 're it's  'll", "tab\tb \t c\r\n d", "\0 a\0b \0", "　  a   b", "日本語 テキスト 。", "a.\0 .'s b",
    "<|endoftext|> a<|endoftext|>b", "<|ENDOFTEXT|> A", "é ́x Á É", "x" * 5000 + " y", "  ", "\n", "\u0085 a\u0085  b", "​ a​  b", "İ ß ſ K", "A.B, c.,d e,\n f.'s",
]
ALPHABET = " \t\n 　 '.,abZé日́\0s<|>1 "
TOKENISERS = {"byte_bpe_50k.json": (vocab.byte_bpe, vocab.encode_texts), "word_bpe_49k.json": (vocab.word_bpe, vocab.encode_caseless)}
MADE = {}


def compare(name, texts, limit=textscan.SLICE_BYTES):
    make, encode = TOKENISERS[name]
    path = public_tokenizers.path(name)
    if name not in MADE:
        MADE[name] = Tokenizer.from_file(path), vocab.Memory(make(path))
    tokenizer, memory = MADE[name]
    got = []
    for _, data, offsets in textscan.slices(pa.RecordBatch.from_pydict({"t": texts}), "t", limit):
        ids, at = encode(data, offsets, memory)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", TOKENISERS)
def test_same_ids(name):
    rng = random.Random(1)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    compare(name, [*ODD, None, *made])
    compare(name, [*ODD, *made[:300]], 50)


@pytest.mark.parametrize("name", TOKENISERS)
@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(name, text):
    compare(name, [text])


def test_memory_forgets(monkeypatch):
    monkeypatch.setattr(vocab, "REMEMBERED", 20)
    MADE.clear()
    compare("byte_bpe_50k.json", [f"word{i} other{i // 2}, more" for i in range(200)], 100)
    assert len(MADE["byte_bpe_50k.json"][1].places) <= 40
    MADE.clear()
