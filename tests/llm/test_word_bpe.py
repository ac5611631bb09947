"""Fragments between certain cuts against the library's call, whole and in chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coinloom.llm import word_bpe

from .conftest import EDGE_TEXTS

PATH = word_bpe.default_path()
ODD = st.text(alphabet=st.sampled_from("abcqjxz'sStTdLl012 \t\n\x0b\x1c\x1f\x85\xa0.,!<|>é\u0301ßΣİﬁ漢각ᄀ\u2003\u200b\ufeff🙂½٣") | st.characters(exclude_categories=["Cs"]), max_size=40)
PARTS = st.lists(ODD | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "hello ", "the", "qj"]), max_size=6).map("".join)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=600, deadline=None)
@given(text=PARTS, size=st.integers(1, 9))
def test_any_text_whole_and_in_chunks(library, text, size):
    codec, want = word_bpe.Codec.of(PATH), library.encode(text, add_special_tokens=False).ids
    assert ids_of(codec.encode(text)) == want
    parts = [codec.encode_fragments(t) if cut else codec.encode(t) for t, cut in codec.chunks(text, size)]
    assert ids_of(b"".join(parts)) == want
    assert word_bpe.Names.of(PATH).decode(want) == library.decode(want, skip_special_tokens=False)


def test_words_are_cut_inside():
    codec = word_bpe.Codec.of(PATH)
    cut = codec.cut("aaqjbb")
    assert len(cut) > 1 and "".join(cut) == "aaqjbb"
    assert all(a[-1] + b[0] not in codec.inside for a, b in zip(cut, cut[1:], strict=False))


def test_table_of_awkward_rows(spark, edge_docs, library):
    done = word_bpe.decode(word_bpe.encode(edge_docs, PATH, giant=1000, chunk=200), PATH).collect()
    want = []
    for doc_id, text in EDGE_TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["text"]) for r in done), key=str) == sorted(want, key=str)


def test_giants_without_white_space(spark, library):
    rows = [(1, "ab1<|endoftext|>É" * 3000), (1, "x" * 5000), (2, "word " * 3000 + "y!" * 4000 + " end"), (None, "qj" * 4000)]
    done = word_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, giant=500, chunk=300).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in done), key=str) == sorted(((i, library.encode(t, add_special_tokens=False).ids) for i, t in rows), key=str)


def test_empty_table_and_null_ids(spark, no_docs):
    assert word_bpe.decode(word_bpe.encode(no_docs, PATH), PATH).collect() == []
    rows = word_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).collect()
    assert {(r["text"], r["n_tokens"]) for r in rows} == {("", 0)}


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        word_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
