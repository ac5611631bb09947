"""Ids and texts against the library, giant documents included."""

from __future__ import annotations

import random

import pytest

from coinloom.llm import sentencepieces as sp

PATH = sp.default_path()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(encoded, library):
    """encoded: rows with text and ids."""
    for r in encoded:
        assert r["ids"] == library.encode(r["text"] or ""), r["doc_id"]


def run(docs, scratch):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    return texts, sp.encode(docs, scratch, PATH).collect()


def test_whole_table(docs, scratch, library):
    texts, rows = run(docs, scratch)
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]][0])


def awkward(seed: int, n: int) -> str:
    rng = random.Random(seed)
    pieces = ["a", "aa", "the", " ", "  ", "ing", "é", "日", "😀", "1", "0", "\n", "=", "----", "e", "s"]
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("size", [64, 257])
def test_chunks_cut_anywhere(spark, scratch, library, monkeypatch, size):
    """With chunks of a few characters, in blocks of a few chunks, the ids stay the library's."""
    monkeypatch.setattr(sp, "GIANT", 100)
    monkeypatch.setattr(sp, "CHUNK", size)
    monkeypatch.setattr(sp, "BLOCK", 3)
    texts = [awkward(s, 900) for s in range(12)] + ["a" * 2000, "the" * 700, " " * 800, "=" * 999, "ab" * 500]
    model = sp.Model(PATH)
    for text in texts:
        whole = model.normal(text)
        parts = [(k, whole, a, min(a + size, len(whole))) for k, a in enumerate(range(0, len(whole), size))]
        entries = [[(0, 0)]] + [model.states(whole, a) for _, _, a, _ in parts[1:]]
        leaves = [*entries[1:], [s for s in model.states(whole, len(whole)) if s[1] == 0]]
        tables = [model.matrix(whole, a, b, x, y) for (_, _, a, b), x, y in zip(parts, entries, leaves, strict=True)]
        front = tables[0].max(axis=0, keepdims=True)
        ahead = [0]
        back = [tables[-1].max(axis=1, keepdims=True)]
        for t in tables[-2:0:-1]:
            back.insert(0, sp.product(t, back[0]))
        for k in range(1, len(parts)):
            ahead.append(entries[k][int((front.ravel() + back[k - 1].ravel()).argmax())][1])
            front = sp.product(front, tables[k])
        ids = []
        for k, (_, _, a, b) in enumerate(parts):
            reach = ahead[k + 1] if k + 1 < len(parts) else 0
            ids += model.inner.encode(whole[a + ahead[k] : b + reach])
        assert ids == library.encode(text), text[:40]


def test_giant_documents(spark, scratch, library):
    texts = [awkward(s, 60_000) for s in range(3)] + ["x" * 70_000, "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = sp.encode(docs, scratch, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]])


def test_decode_is_the_round_trip(docs, scratch, library):
    encoded = sp.encode(docs, scratch, PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in sp.decode(encoded, PATH).collect():
        assert r["text"] == library.decode(library.encode(texts[r["doc_id"]]))


def test_edges(edge_docs, no_docs, scratch, library):
    texts, rows = run(edge_docs, scratch)
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r["ids"] in [library.encode(t) for t in texts[r["doc_id"]]]
    assert sp.decode(sp.encode(no_docs, scratch, PATH), PATH).count() == 0
