"""The trie against plain Python on rebuilt conversations, ties and deep partings."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from coinloom.llm import prefix_trie, sql

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations_of(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            content = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role, content, text))
    return {c: [(x[1], x[3]) for x in sorted(own[c])] for c in own}


def brute(whole: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members: dict = {}
    for conv, path in whole.items():
        for depth in range(len(path) + 1):
            members.setdefault(tuple(path[:depth]), []).append(conv)
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        own = kids.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(below[k][1] for k in own)
        below[node] = (sum(below[k][0] for k in own) or 1, saved)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(own), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuild(own: dict) -> dict:
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def found(df) -> list[tuple]:
    return sorted([tuple(r) for r in df.collect()], key=str)


def of_rebuilt(df, scratch, first=prefix_trie.FIRST_TURNS):
    own = scratch.table(prefix_trie.turns(df), "turns")
    takes = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (sql.TAKES_AT_MOST + 1)
    ids, own = prefix_trie.rebuilt(own, sql.TAKES_FROM, takes, sql.TAKES_AT_MOST)
    return prefix_trie.trie(ids, scratch.table(own, "rebuilt"), scratch, first)


def test_query_equals_brute_force(spark, sf_dir):
    from coinloom.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(queries.op11_prefix_trie(spark, sf_dir)) == brute(rebuild(conversations_of(rows)))


@pytest.mark.parametrize("first", [1, 4])
def test_ties_nulls_and_repeats(spark, scratch, monkeypatch, first):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    rng, rows = random.Random(3), []
    for c in range(200):
        conv = rng.choice([None, c, c, c, -c])
        for t in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([t, t, None]), rng.choice(["u", None]), rng.choice(["", "é", None])))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("clash"), "label": F.lit("clash"), "weight": F.lit(None).cast("int")})
    assert found(of_rebuilt(df, scratch, first)) == brute(rebuild(conversations_of(rows)))


def test_partings_at_great_depth_and_texts(spark, scratch):
    rows = [(c, t, "user", f"{t}" if t < 60 + c else f"{t} {c}") for c in range(4) for t in range(80)] + [(9, t, "user", f"{t}") for t in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = scratch.table(prefix_trie.build(df, scratch), "nodes")
    assert found(nodes) == brute(conversations_of(rows))
    texts = {(r["conv_id"], r["depth"]): r["text"] for r in prefix_trie.with_turns(nodes, df).collect()}
    assert texts[(0, 0)] is None and texts[(0, 1)] == "0" and texts[(1, 62)] == "61 1"


def test_many_copies_and_empty_table(spark, scratch, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 7)
    rows = [(c, t, "user", f"{t}" if c < 500 else f"{t} {c}") for c in range(540) for t in range(3)]
    assert found(prefix_trie.build(spark.createDataFrame(rows, SCHEMA), scratch)) == brute(conversations_of(rows))
    assert found(prefix_trie.build(spark.createDataFrame([], SCHEMA), scratch)) == []
    only_null = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert found(prefix_trie.build(only_null, scratch)) == []
