"""Predictions of language and quality on whole tables against plain walks of the same models."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from coinloom.llm import language, quality, queries
from coinloom.llm.common import held_out

MASK = (1 << 64) - 1


def mix(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


_signs: dict[int, np.ndarray] = {}


def signs(point: int) -> np.ndarray:
    if point not in _signs:
        raw = b"".join(mix((mix(point + 1) + lane * 0x9E3779B97F4A7C15) & MASK).to_bytes(8, "little") for lane in range(1, language.DIMENSIONS // 64 + 1))
        _signs[point] = np.array([2 * (byte >> (7 - bit) & 1) - 1 for byte in raw for bit in range(8)], np.float64)
    return _signs[point]


def profile(text: str | None) -> np.ndarray | None:
    """Sum over three-grams around letters of the product of signs, shifted by their place."""
    letters = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
    if not any(letters):
        return None
    grams = Counter((a, b, c) for a, b, c in zip(letters, letters[1:], letters[2:], strict=False) if b)
    vector = np.zeros(language.DIMENSIONS)
    for (a, b, c), n in grams.items():
        vector += n * np.roll(signs(a), 2) * np.roll(signs(b), 1) * signs(c)
    return vector / np.linalg.norm(vector)


@pytest.fixture(scope="module")
def table(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()


def test_languages_by_plain_prototypes(spark, sf_dir, table):
    vectors = {i: profile(text) for i, text, _ in table}
    sums: dict[str, np.ndarray] = {}
    for i, _, lang in table:
        if lang is not None and vectors[i] is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            sums[lang] = sums.get(lang, 0) + vectors[i]
    prototypes = {lang: v / np.linalg.norm(v) for lang, v in sums.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op6_language(spark, sf_dir).collect()}
    assert set(got) == set(vectors)
    for i, vector in vectors.items():
        if vector is None:
            assert got[i] == (language.UNKNOWN, 0.0)
            continue
        cosine = {lang: float(p @ vector) for lang, p in prototypes.items()}
        best = max(cosine.values())
        assert got[i][1] == pytest.approx(max(0.0, best), abs=1e-3)
        assert cosine[got[i][0]] == pytest.approx(best, abs=1e-3)


def plain_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    space = b" \t\r\x0b\x0c\n"
    words = [w for w in raw.translate(bytes(32 if b in space else b for b in range(256))).split(b" ") if w]
    if not words:
        return [0.0] * len(quality.STATISTICS)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    n, count = len(words), Counter(low)
    pairs = len(set(zip(low, low[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    ink = max(1, sum(map(len, words)))

    def of(chars: bytes) -> int:
        return sum(b in chars for b in raw)

    marks = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-!|")
    return [
        float(np.log1p(len(raw))), ink / n, of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / ink, of(b"0123456789") / ink, of(marks) / ink, of(b".,;:?'\"()-") / n, of(b"!") / n, of(b"|") / n,
        n / (1 + of(b"\n")), len(count) / n, pairs, sum(len(w) <= 3 for w in words) / n, max(count.values()) / n,
    ]


def test_quality_by_a_plain_walk_of_the_rules(spark, sf_dir, docs, table):
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0)))
    assert model.rules
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in queries.op3_quality(spark, sf_dir).collect()}
    for i, text, _ in table:
        own = plain_statistics(text)
        total = model.intercept + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((own[at] > cut) == above for at, above, cut in rule))
        score = 1 / (1 + np.exp(-total))
        assert got[i] == (pytest.approx(score, abs=1e-9), int(score >= quality.THRESHOLD))
