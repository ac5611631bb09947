"""Ids against the library's own, the round trip through ORC, and what readers may skip."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coinloom.llm import token_files, tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(library, text) -> list[int]:
    return library.encode(text or "", add_special_tokens=False).ids


SPACES = [" ", "  ", "\n", "\t", "\r\n", " \n ", " ", " ", "​", "\x1c", "\x85", "　"]
PIECES = st.sampled_from([*SPACES, "the", "The", "don't", "'s", "123", "1", ".", ",", "...", "é", "日本", "😀", "a,b", "<|endoftext|>", "x_y", "-", "word,", "word.", "Q.", "été", "çà,", "Łódź", "ﬁ", "straße", "ω"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=4))
def test_ids_equal_the_library(library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder.of(PATH).encode(texts)]
    assert got == [plain(library, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(library, text):
    assert np.frombuffer(tokens.Encoder.of(PATH).encode([text])[0], "<u4").tolist() == plain(library, text)


def expected(library, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*plain(library, text), tokens.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, docs, scratch):
    token_files.write(docs, scratch.path("tokens"), PATH)
    rows = token_files.with_starts(token_files.digest(spark, scratch.path("tokens"))).collect()
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])


def test_whole_table(spark, docs, scratch, library):
    assert run(spark, docs, scratch) == expected(library, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_edges(spark, edge_docs, no_docs, scratch, library):
    assert run(spark, edge_docs, scratch) == expected(library, [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()])
    assert run(spark, no_docs, scratch) == []


def test_lookup_reaches_the_files_metadata(spark, docs, scratch):
    token_files.write(docs, scratch.path("tokens"), PATH)
    found = token_files.read(spark, scratch.path("tokens")).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in found._jdf.queryExecution().toString()
    assert found.count() == docs.where("doc_id = 7").count()
