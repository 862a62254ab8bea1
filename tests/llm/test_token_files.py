import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import codec, token_files
from tests.llm import samples


@pytest.mark.parametrize(("n", "vocabulary"), [(0, 10), (1, 10), (5, 2), (63, 65536), (64, 3), (65, 50257), (1000, 50257), (5000, 7), (70_000, 50257)])
@pytest.mark.parametrize("kind", ["even", "one", "skewed", "periodic"])
def test_round_trip(n, vocabulary, kind):
    rng = np.random.default_rng(n)
    ids = {
        "even": rng.integers(0, vocabulary, n), "one": np.full(n, vocabulary - 1), "skewed": np.minimum((rng.pareto(1, n) * 3).astype(int), vocabulary - 1),
        "periodic": np.arange(n) % min(vocabulary, 11),
    }[kind].astype(np.uint16)
    block = codec.encode(ids, vocabulary)
    assert (codec.decode(block) == ids).all()
    if n >= 5000 and kind != "even":
        assert len(block) < n  # well below the two bytes of an id


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 299), max_size=400))
def test_any_ids(ids):
    assert codec.decode(codec.encode(np.array(ids, np.uint16), 300)).tolist() == ids


def test_damage_is_found():
    block = bytearray(codec.encode(np.arange(1000, dtype=np.uint16), 2000))
    for at in (codec.HEADER_BYTES + 3, len(block) - 1):
        block[at] ^= 1
        with pytest.raises(ValueError):
            codec.decode(bytes(block))
        block[at] ^= 1
    with pytest.raises(ValueError):
        codec.decode(bytes(block[:-1]))


def expected(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [e.ids + [0] for e in tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    return [(r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes()), np.array(i, "<u4").tobytes()) for r, i in zip(rows, ids, strict=True)]


@pytest.mark.parametrize(("file_ids", "block_ids"), [(1 << 24, 1 << 20), (500, 1 << 20)])
def test_files(spark, file_ids, block_ids):
    rows = samples.texts()
    folder = token_files.new_folder(spark)
    manifest = token_files.write(samples.frame(spark, rows), folder, file_ids=file_ids)
    got = token_files.read(manifest, with_ids=True).collect()
    samples.same([(r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got], expected(rows))
    # Ascending ids, one after the other without a gap; a null id comes first.
    got.sort(key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    fs, path = pafs.FileSystem.from_uri(folder)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path))]
    assert len(names) == manifest.count() and all(n.endswith(".tokens") and not n.startswith(".") for n in names)
    assert file_ids > 1000 or len(names) > 5


def test_long_document_spans_blocks(spark, monkeypatch):
    rows = [(1, "a b", "en", "s"), (2, "word " * 400_000 + "tail", "en", "s"), (3, "c", "en", "s")]
    docs = samples.frame(spark, rows, 1)
    got = token_files.read(token_files.write(docs, token_files.new_folder(spark), file_ids=100)).collect()
    samples.same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [w[:3] for w in expected(rows)])
    long = samples.frame(spark, [(i, "one two three " * 90_000, "en", "s") for i in range(17)], 1)
    got = token_files.read(token_files.write(long, token_files.new_folder(spark))).collect()
    assert len({(r.n_tokens, r.ids_crc32) for r in got}) == 1 and len(got) == 17 and sum(r.n_tokens for r in got) > codec.BLOCK_IDS


def test_damaged_file(spark):
    folder = token_files.new_folder(spark)
    token_files.write(samples.frame(spark), folder)
    fs, path = pafs.FileSystem.from_uri(folder)
    name = fs.get_file_info(pafs.FileSelector(path))[0].path
    with fs.open_input_file(name) as f:
        data = f.read()
    with fs.open_output_stream(name) as f:
        f.write(data[:-3])
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(f"file://{name}")


def test_empty(spark):
    manifest = token_files.write(samples.empty(spark), token_files.new_folder(spark))
    assert token_files.read(manifest).count() == 0
