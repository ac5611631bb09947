"""Printed rows on small pages: zones, words without a place, nulls and empty pages."""

from __future__ import annotations

import pytest

from coinloom.sources.printed_rows import printed_rows

COLUMNS = "doc_id string, page int, position long, text string, x0 double, x1 double, y0 double, y1 double, row string"


def line(doc, y, start, *words):
    """Words of ten points a letter from (text, x0), one space apart in position."""
    out, at = [], start
    for text, x0 in words:
        out.append((doc, 1, at, text, float(x0), float(x0 + 10 * len(text)), float(y), float(y + 10), "own"))
        at += len(text) + 1
    return out


def rows(spark, words):
    found = printed_rows(spark.createDataFrame(words, COLUMNS)).orderBy("doc_id", "page", "row").collect()
    return [(r["doc_id"], r["row"], r["text"]) for r in found]


def test_words_that_share_height_form_a_row_from_left_to_right(spark):
    words = line("a", 100, 0, ("ONE", 0), ("TWO", 35)) + line("a", 97, 20, ("THREE", 60)) + line("a", 80, 40, ("FOUR", 0))
    assert rows(spark, words) == [("a", 0, "ONE TWO THREE"), ("a", 1, "FOUR")]


def test_a_gutter_that_no_row_crosses_parts_a_page_into_zones(spark):
    left = line("a", 100, 0, ("AB", 0), ("CD", 25)) + line("a", 80, 10, ("EF", 0), ("GH", 25))
    right = line("a", 94, 100, ("IJ", 300), ("KL", 325)) + line("a", 74, 110, ("MN", 300), ("OP", 325))
    apart = [("a", 0, "AB CD"), ("a", 1, "EF GH"), ("a", 2, "IJ KL"), ("a", 3, "MN OP")]
    shifted = [(*w[:6], w[6] - 4, w[7] - 4, w[8]) for w in right]
    assert rows(spark, left + shifted) == apart
    assert rows(spark, left + right) == [("a", 0, "AB CD IJ KL"), ("a", 1, "EF GH MN OP")]


def test_words_without_a_place_take_their_neighbours(spark):
    words = [(*w[:4], None, None, None, None, "own") if w[3] in ("TWO", "ZERO") else w for w in line("a", 100, 0, ("ZERO", 0), ("ONE", 50), ("TWO", 90), ("THREE", 200))]
    assert rows(spark, words) == [("a", 0, "ONE ZERO TWO THREE")]


def test_pages_without_a_place_give_no_row_and_nulls_are_empty(spark):
    words = [("a", 1, 0, "LOST", None, None, None, None, "own"), ("b", 1, 0, None, 0.0, 5.0, 0.0, 5.0, "own"), ("c", 1, None, "X", 0.0, 5.0, 0.0, 5.0, "own"), ("d", 1, 0, "N", float("nan"), 5.0, 0.0, 5.0, "own")]
    assert rows(spark, words) == [("b", 0, "")]
    assert rows(spark, []) == []


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_words_all_stay(spark, copies):
    assert rows(spark, line("a", 100, 0, ("ONE", 0)) * copies) == [("a", 0, " ".join(["ONE"] * copies))]


def test_many_pages_in_one_batch(spark):
    words = [w for i in range(600) for w in line(f"d{i:03}", 100, 0, ("A", 0), ("B", 20)) + line(f"d{i:03}", 80, 10, ("C", 0))]
    assert rows(spark, words) == [(f"d{i:03}", r, t) for i in range(600) for r, t in enumerate(("A B", "C"))]
