"""Held-out accuracy, and the compiled column against the rules run in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coinloom.llm import quality
from coinloom.llm.common import held_out

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    return quality.learn(docs, labels.where(~held_out("doc_id", 5, 0)))


def test_held_out_rows_are_told_apart(tables, model):
    docs, labels = tables
    rows = quality.score(docs, model, "text", "doc_id").join(labels.where(held_out("doc_id", 5, 0) & F.col("quality").isNotNull()), "doc_id").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    print("auc", auc, len(good), len(bad))
    assert auc > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.85


def test_column_equals_rules(tables, model):
    texts = [r["text"] for r in tables[0].orderBy("doc_id").limit(50).collect()]
    x = quality._statistics(pa.array(texts, pa.string()))
    want = model.intercept + sum(w * quality._holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    got = [r["score"] for r in quality.score(tables[0].orderBy("doc_id").limit(50), model, "text", "doc_id").orderBy("doc_id").collect()]
    assert np.allclose(1 / (1 + np.exp(-want)), got)
    assert 0 < len(model.rules) < 150 and len(model.describe()) == len(model.rules)


def test_one_kind_of_label_gives_its_share():
    x = np.zeros((4, len(quality.STATISTICS)))
    assert quality.fit(x, np.ones(4)).rules == ()
    assert quality.fit(x[:0], np.zeros(0)).intercept == 0


def test_edges(spark, edge_docs, no_docs, model):
    rows = quality.score(edge_docs, model, "text", "doc_id").collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(no_docs, model, "text", "doc_id").count() == 0
    assert quality.keep_good(edge_docs, model).columns == edge_docs.columns
    labels = spark.createDataFrame([(4, None), (None, 1)], "doc_id long, quality int")
    assert quality.learn(edge_docs, labels).rules == ()


def test_labels_that_nothing_tells_apart(spark):
    """Too few rows to split, equal texts, and a labelled id whose row repeats."""
    few = spark.createDataFrame([(k, f"word{k} " * (k + 3)) for k in range(8)], "doc_id long, text string")
    same = spark.createDataFrame([(k, "the same text") for k in range(60)] + [(1, "the same text")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 4 == 0) for k in range(60)], "doc_id long, good boolean").selectExpr("doc_id", "cast(good as int) AS quality")
    for docs, share in ((few, 0.25), (same, 0.25)):
        model = quality.learn(docs, labels)
        assert model.rules == () and abs(1 / (1 + np.exp(-model.intercept)) - share) < 1e-6
