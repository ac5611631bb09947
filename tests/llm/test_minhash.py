"""Components against all pairs of whole sets."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from coinloom.llm import minhash
from coinloom.llm.components import components

from .conftest import prose


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if len(words) < 2:
        return {tuple(words)} if words else set()
    return {(a, b) for a, b in zip(words, words[1:], strict=False)}


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row; rows of an id are one vertex."""
    sets = [shingles(t) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    seen = set()
    for ks in where.values():
        for i in ks:
            for j in ks:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = rows[i][0], rows[j][0]
                    if a is None or b is None:
                        continue
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        p, q = find(a), find(b)
                        parent[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def planted():
    rng, rows = random.Random(4), []
    for g in range(12):
        words = prose(100 + g, 120).split()
        for k in range(rng.choice([2, 3, 25])):
            own = list(words)
            for _ in range(rng.randrange(0, 14)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 * g + k, " ".join(own)))
    rows += [(50_000 + k, prose(7, 30)) for k in range(60)] + [(60_000 + k, prose(8, 300) + f" tail{k}") for k in range(70)]
    rows += [(70_000 + k, prose(500 + k, 40)) for k in range(60)]
    rng.shuffle(rows)
    return rows


def check(spark, rows, scratch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, scratch).collect())
    assert got == sorted(brute(rows))


def test_whole_table(spark, docs, scratch):
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], scratch)


def test_planted_groups(spark, scratch):
    check(spark, planted(), scratch)


def test_large_buckets_in_several_tiles(spark, scratch, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "TILE", 16)
    check(spark, planted(), scratch)


def test_tiles_by_bytes(spark, scratch, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "TILE_BYTES", 20_000)
    check(spark, planted(), scratch)


def test_many_repeats_of_an_id(spark, scratch):
    """Repeated rows of two near ids, and an id with several texts."""
    near = prose(40, 100)
    rows = [(1, near)] * 300 + [(2, near + " tail")] * 300 + [(3, near + " other"), (3, prose(41, 30)), (4, prose(41, 30) + " end"), (5, "")]
    check(spark, rows, scratch)


def test_long_words_are_told_apart(spark, scratch):
    """Words that every polynomial modulo 2**64 takes for each other share no shingle."""
    one = "a"
    while len(one) < 2048:
        one += one.translate({97: "b", 98: "a"})
    other = one.translate({97: "b", 98: "a"})
    rows = [(1, one), (2, other), (3, f"x {one} y"), (4, f"x {other} y"), (5, one.upper()), (6, one + "z"), (7, "a" * 64), (8, "a" * 65)]
    check(spark, rows, scratch)


def test_chain_of_links(spark, scratch):
    """Each document is near to the next alone; the chain is one component."""
    words = prose(33, 400).split()
    check(spark, [(k, " ".join(words[15 * k : 15 * k + 160])) for k in range(14)], scratch)


def test_edges(spark, edge_docs, no_docs, scratch):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(edge_docs, scratch).collect()}
    for doc_id in (1, 2, 3):
        assert (doc_id, 0, doc_id, True) in out
    assert (5, len(shingles(edge_docs.where("doc_id = 5").first()["text"])), 4, False) in out
    assert (13, 1, 8, False) in out and {r[2] for r in out if r[0] == 7} == {6}
    assert minhash.near_duplicates(edge_docs, scratch).count() == edge_docs.count()
    assert minhash.near_duplicates(no_docs, scratch).count() == 0


def test_components_of_random_graphs(spark, scratch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(50)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    found = components(spark.createDataFrame(edges, "a long, b long"), scratch, "t").collect()
    assert {(r["node"], r["component"]) for r in found} == {(x, find(x)) for x in parent if find(x) != x}


@pytest.mark.parametrize("words", [2, 5])
def test_shingle_sets_tell_texts_apart(words):
    import pyarrow as pa

    from coinloom.llm.common import shingle_sets

    texts = ["a b c", "A  B\tC", "c b a", "a b", "ab", "a", "", None, "a b c d e f", "a b c d e f a b c d e f"]
    sets = [tuple(s) for s in shingle_sets(pa.array(texts, pa.string()), words)]
    assert sets[0] == sets[1] != sets[2] and len({sets[3], sets[4], sets[5]}) == 3 and sets[6] == sets[7] == ()
    assert len(sets[9]) == (12 - words + 1 if words > 6 else 6)


def test_pairs_near_the_limit_are_found(spark, scratch):
    """Resemblance a little above and below 0.8 is told apart exactly."""
    rows = []
    for g in range(40):
        words = [f"g{g}w{k}" for k in range(181)]
        rows.append((10 * g, " ".join(words)))
        rows.append((10 * g + 1, " ".join(words[:161])))  # 160 of 180
        rows.append((10 * g + 2, " ".join(words[20:] + [f"x{g}y{k}" for k in range(20)])))
    check(spark, rows, scratch)
    assert F is not None
