"""Hyperdimensional language profiles.

Every letter of any script has a vector of DIMENSIONS random signs of its own, drawn from a hash
of its code point. A letter three-gram is the product of its letters' vectors, each rotated by
its place (binding); a document is the sum of its three-grams (bundling), and a language's
prototype the sum of its documents' unit vectors. The language of a document is that of the
prototype with the largest cosine.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every text when
nothing could be learned. Null ids pass through; rows with a null language are not learned
from; the first of tied languages by name wins; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored by ``predict`` and kept by ``keep_known``.
Texts are read whole, with memory in proportion to the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, spare

DIMENSIONS, GRAM = 512, 3
#: Symbols of the table of three-grams: all that is no letter, then a to z. Grams with other letters are bound when met.
COMMON = 27
GRAMS_AT_ONCE = 1024
#: At most about so many documents are learned from, chosen by a hash of their id.
SAMPLE = 20_000
UNKNOWN = "und"
_SCALE = 1 << 24

_tables: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def signs_of(points: np.ndarray) -> np.ndarray:
    """A row of DIMENSIONS signs for each code point; 0 stands for all that is no letter."""
    lanes = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = mix64(mix64(points.astype(np.uint64)[:, None] + np.uint64(1)) + lanes[None, :])
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bind(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """The vectors of three-grams, from rows of their letters' signs."""
    return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third


def _gram_table() -> np.ndarray:
    """The bound vector of every three-gram of common symbols."""
    if "grams" not in _tables:
        signs = signs_of(np.array([0, *range(97, 123)]))
        a, b, c = (x.ravel() for x in np.indices((COMMON,) * GRAM))
        _tables["grams"] = bind(signs[a], signs[b], signs[c])
    return _tables["grams"]


def bundle(text: str | None) -> np.ndarray | None:
    """The unit vector of a text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = np.where(_is_letter()[points], points, 0)
    if not letters.any():
        return None
    letters = np.concatenate(([0], letters, [0]))
    common = np.where(letters == 0, 0, letters - 96)
    common[(common < 0) | (common >= COMMON)] = -1
    x, y, z = (letters[k : len(letters) - 2 + k] for k in range(3))
    i, j, k = (common[n : len(common) - 2 + n] for n in range(3))
    held = y > 0
    plain = held & (i >= 0) & (j >= 0) & (k >= 0)
    vector = np.zeros(DIMENSIONS, np.float32)
    counts = np.bincount((i[plain] * COMMON + j[plain]) * COMMON + k[plain], minlength=COMMON**GRAM)
    seen = np.flatnonzero(counts)
    for n in range(0, len(seen), GRAMS_AT_ONCE):  # bounds the copy of table rows
        some = seen[n : n + GRAMS_AT_ONCE]
        vector += counts[some].astype(np.float32) @ _gram_table()[some].astype(np.float32)
    rare = held & ~plain
    if rare.any():
        grams, counts = np.unique((x[rare] << 42) | (y[rare] << 21) | z[rare], return_counts=True)
        for n in range(0, len(grams), GRAMS_AT_ONCE):
            some = grams[n : n + GRAMS_AT_ONCE]
            bound = bind(*(signs_of((some >> shift) & 0x1FFFFF) for shift in (42, 21, 0)))
            vector += counts[n : n + GRAMS_AT_ONCE].astype(np.float32) @ bound.astype(np.float32)
    norm = float(np.linalg.norm(vector))
    return vector / norm if norm else vector


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # a unit row per language

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = bundle(text)
        if vector is None or not self.languages:
            return UNKNOWN, 0.0
        cosine = self.prototypes @ vector
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(1.0, max(0.0, cosine[best])))


def learn(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Profiles:
    """Prototypes from the rows of docs with a language, at most about sample of them.

    Vectors are summed as whole numbers, so that the order of rows doesn't matter.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = rows.count()
    if total > sample:
        part = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 30))
        rows = rows.where(part < int((1 << 30) * sample / total))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = bundle(text)
                if vector is not None:
                    sums.setdefault(of, np.zeros(DIMENSIONS, np.int64))
                    sums[of] += np.rint(vector * _SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    parts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(vectors, "lang string, sums array<long>")
    summed = parts.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    model: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages times DIMENSIONS numbers
        model.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["value"]
    languages = tuple(sorted(model))
    prototypes = np.array([model[x] / (np.linalg.norm(model[x]) or 1) for x in languages], np.float32).reshape(len(languages), DIMENSIONS)
    return Profiles(languages, prototypes)


def prediction(profiles: Profiles, text: str = "text"):
    """Column: struct of lang_pred and score."""

    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(each, "lang_pred string, score double")(F.col(text))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", *keep: str) -> DataFrame:
    """The columns to keep, lang_pred and score, for each row of docs."""
    return docs.select(*keep, prediction(profiles, text).alias("predicted")).select(*keep, "predicted.*")


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of docs whose language can be told: not those without any letter."""
    mark = spare(docs, "_predicted_language")
    return docs.withColumn(mark, prediction(profiles, text)["lang_pred"]).where(F.col(mark) != UNKNOWN).drop(mark)
