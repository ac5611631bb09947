"""Held-out accuracy, and the order of rows not mattering."""

from __future__ import annotations

import random

import numpy as np
import pytest

from coinloom.llm import language
from coinloom.llm.common import held_out

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return docs, language.learn(docs.where(~held_out("doc_id", 3, 1)))


def test_held_out_accuracy(tables):
    docs, profiles = tables
    rows = language.predict(docs.where(held_out("doc_id", 3, 1)), profiles, "text", "doc_id", "lang").collect()
    known = [r for r in rows if r["lang"] is not None and r["lang_pred"] != language.UNKNOWN]
    right = np.mean([r["lang_pred"] == r["lang"] for r in known])
    print("accuracy", right, len(known))
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_learning_does_not_depend_on_the_order_of_rows(tables):
    docs, profiles = tables
    again = language.learn(docs.where(~held_out("doc_id", 3, 1)).repartition(7))
    assert again.languages == profiles.languages and np.array_equal(again.prototypes, profiles.prototypes)


def test_binding_is_the_product_of_rotated_letters():
    def sign(c):
        return language.signs_of(np.array([ord(c) if c else 0]))[0].astype(int)

    for text in ("ab", "été", "привет", "日本", "aé"):
        letters = ["", *text, ""]
        vector = sum(np.roll(sign(x), 2) * np.roll(sign(y), 1) * sign(z) for x, y, z in zip(letters, letters[1:], letters[2:], strict=False))
        assert np.allclose(language.bundle(text), vector / np.linalg.norm(vector), atol=1e-5), text
    assert np.allclose(language.bundle("Ab, ab"), language.bundle("ab--ab"))


def test_every_letter_has_a_vector_of_its_own():
    signs = language.signs_of(np.arange(0x400, 0x500)).astype(int)
    near = np.abs(signs @ signs.T) - language.DIMENSIONS * np.eye(len(signs), dtype=int)
    assert near.max() < 0.3 * language.DIMENSIONS


def test_languages_of_one_script_that_is_not_latin(spark):
    """Two invented languages over the same Cyrillic letters, and two over Greek ones, with other pairs of letters in use."""
    rng, rows = random.Random(8), []
    for lang, letters, seed in (("c1", "абвгдежзик", 1), ("c2", "абвгдежзик", 2), ("g1", "αβγδεζηθικ", 3), ("g2", "αβγδεζηθικ", 4)):
        own = random.Random(seed)
        then = {x: own.sample(letters, 3) for x in letters}
        for _ in range(60):
            words = []
            for _ in range(40):
                word = rng.choice(letters)
                while len(word) < rng.randrange(3, 8):
                    word += rng.choice(then[word[-1]])
                words.append(word)
            rows.append((len(rows), lang, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    profiles = language.learn(docs.where("doc_id % 2 = 0"))
    out = language.predict(docs.where("doc_id % 2 = 1"), profiles, "text", "lang").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_edges(spark, edge_docs, no_docs, tables):
    profiles = tables[1]
    rows = {(r["doc_id"], r["lang_pred"]) for r in language.predict(edge_docs, profiles, "text", "doc_id").collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (12, "und")} <= rows
    assert (8, "und") not in rows
    assert language.predict(no_docs, profiles, "text", "doc_id").count() == 0
    nothing = language.learn(no_docs)
    assert nothing.languages == () and nothing.predict("some text") == ("und", 0.0)
    kept = language.keep_known(edge_docs, profiles)
    assert kept.columns == edge_docs.columns and not {1, 2, 3, 12} & {r["doc_id"] for r in kept.select("doc_id").collect()}
