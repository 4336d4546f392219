"""The encoders against their libraries, on prose of the test tables and on awkward texts."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
from quadrille.llm import encoders  # noqa: E402

AWKWARD = ["", " ", "  ", "\n", " \n ", "a\n\nb", "it's WE'LL 'tis don''t", "x\x1cy\x85z\xa0q", "ΣΑΣ İstanbul ﬁ", "▁▁a ▁", "<|endoftext|> a", "<s>a</s>", "日本語 text", "é é", "½²3 12345", "\r\n\tq", "😀 z", "a" * 3000, "ÀÞ×÷ŸſŐ"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab'sTé \n\t.,!0²ß\x00\xa0▁") for _ in range(rng.randrange(40))) for _ in range(300)]
    return AWKWARD + made + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()


def test_word_ids():
    e = encoders.WordEncoder(P.path("word_bpe_49k.json"))
    assert e.by_word
    ids, sizes = e.encode(texts())
    want = [x.ids for x in e.library.encode_batch(texts(), add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want]
    assert np.array_equal(ids, np.concatenate([np.array(x, np.uint32) for x in want]))


def test_piece_counts():
    e = encoders.PieceEncoder(P.path("piece_bpe_32k.model"))
    assert e.counts(texts()) == [len(x) for x in e.library.encode(texts())]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_small_tables_and_chunks(monkeypatch, name):
    monkeypatch.setattr(encoders, "MAX_UNITS", 50)
    monkeypatch.setattr(encoders, "CHUNK_CHARS", 100)
    e = encoders.load(P.path(name)).__class__(P.path(name))
    lib = e.library
    want = [len(x.ids) for x in lib.encode_batch(texts(), add_special_tokens=False)] if name.endswith("json") else [len(x) for x in lib.encode(texts())]
    assert e.counts(texts()) == want
    assert e.counts([]) == []


def test_another_normaliser_goes_to_the_library(tmp_path):
    import json

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert encoders.load(P.path("word_bpe_49k.json")).by_word
    spec["normalizer"]["normalizers"][1]["content"] = "x"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    coder = encoders.WordEncoder(str(other))
    assert not coder.by_word
    flat, _ = coder.encode(["some words here"])
    assert flat.tolist() == coder.library.encode("some words here", add_special_tokens=False).ids
