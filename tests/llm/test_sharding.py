"""The laws of the tree: shares, confinement of movement, and gapless slots."""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict

import xxhash

from pyspark.sql import functions as F

from coinloom.llm import sharding


def test_growth_moves_only_into_the_new_shard(docs):
    tree = sharding.Tree.even(16)
    rows = sharding.assign(docs, tree, tree.grant("region1", "rack3", 16, 1.0)).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)


def test_shares_follow_weights_at_every_level(spark):
    tree = sharding.Tree.of({"a": {"a1": {0: 1.0, 1: 3.0}}, "b": {"b1": {2: 2.0}, "b2": {3: 1.0, 4: 1.0}}})
    n = 80_000
    count = {r["s"]: r["count"] for r in spark.range(n).groupBy(sharding.shard_of(F.col("id"), tree).alias("s")).count().collect()}
    for shard, weight in {0: 1, 1: 3, 2: 2, 3: 1, 4: 1}.items():
        assert abs(count[shard] / n - weight / 8) < 0.01
    grown = tree.grant("b", "b2", 4, 2.0)
    both = spark.range(n).select(sharding.shard_of(F.col("id"), tree).alias("s"), sharding.shard_of(F.col("id"), grown).alias("g"))
    moved = both.where("s <> g").groupBy("g").count().collect()
    assert [r["g"] for r in moved] == [4]
    assert abs(both.where("g = 4").count() / n - 3 / 10) < 0.01


def test_small_blocks_keep_slots_gapless(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    tree = sharding.Tree.even(4)
    rows = sharding.assign(docs, tree, tree).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(edge_docs, no_docs):
    tree = sharding.Tree.even(16)
    rows = sharding.assign(edge_docs, tree, tree).collect()
    assert len(rows) == edge_docs.count()
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {1}
    assert sharding.assign(no_docs, tree, tree).count() == 0


def plain_shard(doc_id, tree):
    """The descent by draws in plain Python."""

    def draw(place, weight):
        seed = xxhash.xxh64(place.encode(), seed=42).intdigest()
        bits = xxhash.xxh64(struct.pack("<q", doc_id), seed=seed).intdigest() >> 11
        return -math.log((bits + 0.5) * 2.0**-53) / weight

    def total(node):
        return sum(map(total, node.values())) if isinstance(node, dict) else node

    node, path = {f"{k}/{r}": racks for k, g in enumerate(tree.generations) for r, racks in g.items()}, ""
    while isinstance(node, dict):
        name = min((n for n in node if total(node[n]) > 0), key=lambda n: draw(f"{path}/{n}", total(node[n])))
        node, path = node[name], f"{path}/{name}"
    return int(path.rsplit("/", 1)[1])


def test_draws_equal_plain_python(spark):
    tree = sharding.Tree.of({"a": {"a1": {0: 1.0, 1: 3.0}, "a2": {5: 1.5}}, "b": {"b1": {2: 2.0}, "b2": {3: 1.0, 4: 1.0}}})
    grown = tree.grow({"b": {"b2": {4: 2.0, 7: 1.0}, "b3": {8: 3.0}}, "c": {"c1": {9: 1.0}}}).shrink("a", "a1", 1, 2.5)
    for t in (tree, grown, grown.renewed()):
        rows = spark.range(-50, 1500).select("id", sharding.shard_of(F.col("id"), t).alias("s")).collect()
        assert {r["id"]: r["s"] for r in rows} == {i: plain_shard(i, t) for i in range(-50, 1500)}


def test_an_added_subtree_takes_rows_only_into_itself(spark):
    tree = sharding.Tree.even(16)
    grown = tree.grow({"region1": {"rack3": {16: 1.0}, "rack9": {17: 2.0, 18: 1.0}}})
    both = spark.range(60_000).select(sharding.shard_of(F.col("id"), tree).alias("s"), sharding.shard_of(F.col("id"), grown).alias("g"))
    moved = {r["g"]: r["count"] for r in both.where("s <> g").groupBy("g").count().collect()}
    assert set(moved) == {16, 17, 18}
    for shard, weight in {16: 1, 17: 2, 18: 1}.items():
        assert abs(moved[shard] / 60_000 - weight / 20) < 0.01


def test_a_weight_that_falls_moves_rows_out_of_its_path_alone(spark):
    tree = sharding.Tree.even(16)
    low = tree.shrink("region1", "rack3", 14, 0.75)
    n = 80_000
    rows = spark.range(n).select(sharding.shard_of(F.col("id"), tree).alias("s"), sharding.shard_of(F.col("id"), low).alias("g")).collect()
    moved = [(r["s"], r["g"]) for r in rows if r["s"] != r["g"]]
    rack = {s: s // 4 for s in range(16)}
    assert moved
    for s, g in moved:
        if rack[s] // 2 == rack[g] // 2:  # inside a region only the rack that fell gives rows up
            assert rack[s] == 3 and (s == 14 or rack[g] != 3)
        else:  # between regions only the one that fell does
            assert rack[s] in (2, 3)
    share = sum(r["g"] == 14 for r in rows) / n
    assert abs(share - 0.25 / 15.25) < 0.004
    back = low.grant("region1", "rack3", 14, 0.75)
    assert abs(back.weight("region1", "rack3", 14) - 1.0) < 1e-9 and len(back.renewed().generations) == 1
    gone = tree.shrink("region0", "rack0", 0, 1.0)
    assert spark.range(5000).where(sharding.shard_of(F.col("id"), gone) == 0).count() == 0


def test_full_repeats_take_runs_of_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(1, "same")] * 50 + [(1, "other")] * 3 + [(k, "x") for k in range(2, 40)]
    tree = sharding.Tree.even(3)
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), tree, tree).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
