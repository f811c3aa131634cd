import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from firnline.llm import sp_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = sp_codec.codec(MODEL)
PIECES = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "漢", "😀", "\u0000", "<s>", "<0x0A>", "1", "\r\n", "ﬁ", "tion", "of", ".", "aa"])


def same(text):
    ids = LIBRARY.encode(text)
    assert CODEC.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    whole = [1, *ids, 2]
    assert CODEC.decode(struct.pack(f"<{len(whole)}I", *whole)) == LIBRARY.decode(whole)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_as_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258)), max_size=10))
def test_any_ids_decode_alike(ids):
    assert CODEC.decode(struct.pack(f"<{len(ids)}I", *ids)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, " " * 300 + "x", "the" * 4000, "\n" * 50, "zq" * 3000 + " end"])
def test_long_runs(text):
    same(text)


def test_small_caches_give_the_same(monkeypatch):
    monkeypatch.setattr(sp_codec, "CACHE_WORDS", 3)
    monkeypatch.setattr(sp_codec, "CACHE_PAIRS", 5)
    small = sp_codec.PieceCodec(MODEL)
    text = "the cat sat on the mat and then the cat went away again"
    assert small.encode(text) == CODEC.encode(text)


def test_documents(odd, empty):
    for r in sp_codec.encode_documents(odd, MODEL, keep=("doc_id", "text", "rank")).collect():
        ids = [1, *LIBRARY.encode(r.text or ""), 2]
        assert r.n_tokens == len(ids) and r.ids == struct.pack(f"<{len(ids)}I", *ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert sp_codec.encode_documents(empty, MODEL).count() == 0
    with pytest.raises(ValueError):
        sp_codec.encode_documents(odd, MODEL, keep=("doc_id", "ids"))
