"""The manifest against plain Python: ranks, levels, proofs and what tampering does to them."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from coinloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        text = r[4]
        if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(r[1], []).append((r[0], H(*map(field, r)), H(*map(field, (*r[:4], text)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tries = {g: levels_of([x[1] for x in groups[g]]) for g in names}
    top = levels_of([tries[g][-1][0] for g in names])
    out = []
    for at_group, g in enumerate(names):
        for place, (doc_id, leaf, found) in enumerate(groups[g]):
            siblings, folded = [], found
            for levels, at in ((tries[g], place), (top, at_group)):
                for level in levels[:-1]:
                    run, k = level[at // 16 * 16 :][:16], at % 16
                    siblings += run[:k] + run[k + 1 :]
                    folded, at = H(*run[:k], folded, *run[k + 1 :]), at // 16
            root = top[-1][0]
            out.append((doc_id, leaf, tries[g][-1][0], root, H(*siblings), folded, folded == root))
    return sorted(out, key=str)


def found(df, scratch, **options) -> list[tuple]:
    return sorted([tuple(r) for r in merkle.verify(df, scratch, merkle.tampered(), **options).collect()], key=str)


def test_documents(spark, docs, scratch):
    got = found(docs, scratch)
    assert got == brute([tuple(r) for r in docs.select(COLUMNS).collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("case", ["many repeats of few ids", "many groups", "wide ids"])
def test_small_cells(spark, scratch, case):
    rng, rows = random.Random(7), []
    for i in range(700):
        doc_id = {"many repeats of few ids": rng.randrange(4), "many groups": i, "wide ids": rng.choice([None, rng.randint(-50, 50), rng.randint(-(2**63), 2**63 - 1)])}[case]
        source = f"s{rng.randrange(300)}" if case == "many groups" else rng.choice([None, "", "a", "ab", "é", "Z"])
        rows.append((doc_id, source, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", f"Hi {rng.randrange(90)}"])))
    rows += rows[:200] + rows[:1] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, scratch, cell=8) == brute(rows)


def test_awkward_rows_and_empty_table(edge_docs, no_docs, scratch):
    assert found(edge_docs, scratch) == brute([tuple(r) for r in edge_docs.select(COLUMNS).collect()])
    assert found(no_docs, scratch) == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_group_of(spark, scratch, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA), scratch) == brute(rows)
