"""Small tables with every awkward row, for the operators of this subpackage."""

from __future__ import annotations

import random

import pytest

#: Columns whose names the operators also use for their own.
CLASHING = ("score", "lang_pred", "node", "digest", "key", "at", "part", "row", "bucket", "size", "shard", "kept", "to", "predicted", "embedding_", "held_out", "chunks")

WORDS = "river stone lamp garden copper window paper summer engine bridge valley morning winter silver harbor candle forest mirror button ladder".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(1, 30_000)

EDGE_TEXTS = [
    (1, ""), (2, None), (3, " \t\n "), (None, prose(2, 40)), (4, LONG), (5, LONG), (6, prose(3, 60)), (6, prose(3, 60)), (7, prose(3, 60) + " end"),
    (8, "one"), (9, "two words"), (10, "Ünïcode  ßtraße 日本語 😀 text"), (11, "mail a@b.co or 10.0.0.1, card 4111 1111 1111 1111, +49 170 1234567"),
    (None, None), (12, "12345 67890 !!! ???"), (13, "one"), (-5, prose(9, 50)),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    extra = {c: "clash" for c in CLASHING}
    rows = [(i, t, "en", "src", len(t or ""), *extra.values()) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def scratch(spark):
    from coinloom.llm.common import Scratch

    return Scratch(spark)
