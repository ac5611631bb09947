"""Printed rows of a page from positioned words.

A page is words with x and y extents. Words that share enough height form a band; gaps in x that
no band crosses cut a page into zones, which are banded on their own.

A page is small, so its words become one row; rows pass through Python in Arrow batches, since a
group for each page would cost far more than its words do.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id string, page int, row int, text string, words array<struct<text:string,x0:double,x1:double>>"
_WORDS = pa.list_(pa.struct([("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64())]))
_ARROW = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("row", pa.int32()), ("text", pa.string()), ("words", _WORDS)])
#: A gutter is as wide as so many spaces, a band no taller than so many words, and
#: words share a band from this share of the shorter one's height on.
GUTTER_SPACES, BAND_HEIGHTS, SHARED = 4, 2, 0.25
#: Pages that Python holds at a time.
PAGES = 256


class Word(NamedTuple):
    position: int
    text: str
    x0: float
    x1: float
    y0: float
    y1: float


def _middle(values: list[float]) -> float | None:
    return sorted(values)[len(values) // 2] if values else None


def _bands(words: list[Word], tallest: float) -> list[list[Word]]:
    """From the top down; a word joins the present band if heights overlap and the band stays low."""
    bands: list[list[Word]] = []
    low = high = 0.0
    for w in sorted(words, key=lambda w: (-w.y1, w.x0, w.position)):
        overlap, shorter = min(w.y1, high) - max(w.y0, low), min(w.y1 - w.y0, high - low)
        new_low, new_high = min(low, w.y0), max(high, w.y1)
        if bands and overlap > shorter * SHARED and new_high - new_low <= tallest:
            low, high = new_low, new_high
            bands[-1].append(w)
        else:
            low, high = w.y0, w.y1
            bands.append([w])
    return bands


def _cuts(words: list[Word], bands: list[list[Word]], gutter: float) -> list[float]:
    """Where zones begin, from left to right."""
    if gutter <= 0:
        return []
    by_x = sorted(words, key=lambda w: w.x0)
    reach = accumulate((w.x1 for w in by_x), max)
    spans = [(min(w.x0 for w in b), max(w.x0 for w in b)) for b in bands]
    wide = (w.x0 for w, r in zip(by_x[1:], reach, strict=False) if w.x0 - r >= gutter)
    return [x for x in wide if not any(first < x <= last for first, last in spans)]


def _place(words: list[dict]) -> list[Word]:
    """Words without a place stand at the right edge of the last placed one, or the next; none if none has a place."""
    known = {c: [w[c] is not None and w[c] == w[c] for w in words] for c in ("x0", "x1", "y0", "y1")}
    placed = [i for i in range(len(words)) if all(k[i] for k in known.values())]
    if not placed:
        return []
    out = []
    for i, w in enumerate(words):
        host = words[placed[max(0, bisect_right(placed, i) - 1)]]
        has_x = known["x0"][i] and known["x1"][i]
        y0, y1 = (w[c] if known[c][i] else host[c] for c in ("y0", "y1"))
        out.append(Word(w["position"], w["text"] or "", w["x0"] if has_x else host["x1"], w["x1"] if has_x else host["x1"], y0, y1))
    return out


def _rows(words: list[dict]) -> list[list[Word]]:
    """The printed rows of a page, its words in order of position."""
    page = _place(words)
    apart = ((a, b) for a, b in zip(page, page[1:], strict=False) if b.position == a.position + len(a.text) + 1)
    gaps = [b.x0 - a.x1 for a, b in apart]
    height = _middle([w.y1 - w.y0 for w in page])
    tallest = BAND_HEIGHTS * height if height else float("inf")
    bands = _bands(page, tallest)
    cuts = _cuts(page, bands, GUTTER_SPACES * (_middle([g for g in gaps if g > 0]) or 0.0))
    if cuts:
        zones: list[list[Word]] = [[] for _ in range(len(cuts) + 1)]
        for w in page:
            zones[bisect_right(cuts, w.x0)].append(w)
        bands = [b for zone in zones for b in _bands(zone, tallest)]
    return [sorted(b, key=lambda w: (w.x0, w.position)) for b in bands]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            out = []
            for page in batch.slice(at, PAGES).to_pylist():
                for i, row in enumerate(_rows(page["words"])):
                    words = [{"text": w.text, "x0": w.x0, "x1": w.x1} for w in row]
                    out.append({"doc_id": page["doc_id"], "page": page["page"], "row": i, "text": " ".join(w.text for w in row), "words": words})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def printed_rows(words: DataFrame) -> DataFrame:
    """doc_id, page, row, text and words. words: doc_id, page, position, text, x0, x1, y0, y1; y grows upward.

    A word without a place takes one from its neighbours, a page without any place gives no row, and a
    null text is empty. Words without a position are left out; other columns are ignored.
    """
    known = words.where("position is not null")
    word = F.struct(F.col("position").cast("long").alias("position"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")))
    pages = known.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    return pages.mapInArrow(_batches, SCHEMA)
