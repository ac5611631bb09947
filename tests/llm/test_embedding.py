"""Links and components against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from coinloom.llm import embedding


def brute(rows):
    """rows: (vec_id, label, vector or None), ids unique. vec_id -> (n_links, component)."""
    units = {}
    for i, label, v in rows:
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64)
        units.setdefault(label, []).append((i, x / np.linalg.norm(x)))
    parent, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for own in units.values():
        m = np.stack([u for _, u in own])
        near = m @ m.T >= embedding.LEAST_COSINE
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near), strict=True):
            i, j = own[a][0], own[b][0]
            links[i] += 1
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def run(df, scratch, **names):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(df, scratch, **names).collect()}


def test_whole_table(spark, scratch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows), run(df, scratch)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    print("links", found, there)
    assert set(got) == set(want) and found >= 0.98 * there and all(got[i][0] <= want[i][0] for i in want)


def clustered(seed: int, sizes, dims=64, noise=0.02):
    rng, rows = np.random.default_rng(seed), []
    for n in sizes:
        center = rng.standard_normal(dims)
        label = int(rng.integers(0, 3))
        for _ in range(n):
            rows.append((len(rows), label, (center + noise * np.linalg.norm(center) * rng.standard_normal(dims) / 2).tolist()))
    return rows


def test_large_groups_in_tiles(spark, scratch, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 32)
    rows = clustered(3, [1, 2, 3, 150, 1, 90, 4, 4])
    rows += [(1000 + k, 1, rows[10][2]) for k in range(40)]
    got = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3), scratch)
    assert got == brute(rows)


def test_few_dimensions(spark, scratch):
    for dims in (1, 2, 3, 8, 20):
        rows = clustered(dims, [4, 3, 20, 1, 1, 5], dims)
        got, want = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(2), scratch), brute(rows)
        found, there = (sum(n for n, _ in x.values()) for x in (got, want))
        assert found >= 0.98 * there and all(got[i][0] <= want[i][0] for i in want), dims


def test_vectors_that_lean_one_way_are_no_cluster(spark, scratch):
    """Unrelated vectors of mean cosine 0.4 with planted pairs of about the least cosine and a group of near copies."""
    rng, n, m = np.random.default_rng(11), 4000, 200
    lean = rng.standard_normal(64)
    x = rng.standard_normal((n, 64)) / 8 + 0.8 * lean / np.linalg.norm(lean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((m, 64))
    y -= (y * x[:m]).sum(1, keepdims=True) * x[:m]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.931 * x[:m] + (1 - 0.931**2) ** 0.5 * y
    copies = x[-1] + 0.01 * rng.standard_normal((60, 64))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([x, near, copies]))]
    got, want = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4), scratch), brute(rows)
    found, there = (sum(k for k, _ in r.values()) for r in (got, want))
    assert found >= 0.98 * there and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[n + i][0] > 0 for i in range(m)) >= 0.95 * m
    assert all(got[i] == want[i] for i in range(n + m, n + m + 60))
    assert spark.read.parquet(scratch.path("cluster_of")).count() < n / 4


def test_edges(spark, scratch):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, "a", v), (2, "a", v), (3, "b", v), (4, None, v), (5, "a", None), (6, "a", []), (7, "a", [0.0] * 4), (8, "a", [1.0, None, 3.0, 4.0]), (9, "a", [1.0, float("nan"), 3.0, 4.0]),
        (10, "a", [float("inf"), 2.0, 3.0, 4.0]), (11, "a", [2.0, 4.0, 6.0, 8.0]), (12, "a", [1.0, 2.0, 3.0]), (13, "a", [1e300, 2e300, 3e300, 4e300]), (14, "a", [1e-310, 2e-310, 3e-310, 4e-310]),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label string, embedding array<double>, digest string, node int, `filter` int")
    got = run(df, scratch)
    assert got[1] == got[2] == got[11] == got[13] == (4, 1) and got[14][1] == 1
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert run(df.where("false"), scratch) == {}
    nulls = spark.createDataFrame([(None, "a", v), (1, "a", v), (1, "a", v)], "vec_id long, label string, embedding array<double>")
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.near_duplicates(nulls, scratch).collect()), key=repr)
    assert out == [(1, 1, 1), (1, 1, 1), (None, 0, None)]


def test_list_decoding_finds_all_exceeding_directions():
    rng = np.random.default_rng(0)
    u = rng.standard_normal(32)
    u /= np.linalg.norm(u)
    codes, height, want = 64, 2.0 / 32**0.5, []
    for table in range(embedding.TABLES):
        rotation, (first, second) = embedding._code(32, table, codes)
        t = rotation @ u
        dot = ((first @ t[:16])[:, None] + (second @ t[16:])[None, :]) / 2**0.5
        want += [(table * codes + int(c)) * codes + int(d) for c, d in zip(*np.nonzero(dot >= height), strict=True)]
    assert sorted(embedding.filters_of(u, codes, height)) == sorted(want) and want


@pytest.mark.parametrize("dims", [32, 64, 128])
def test_caps_for_more_vectors_keep_recall_and_bucket_sizes(dims):
    """Pairs of exactly the least cosine share a direction, and buckets don't grow with the label."""
    sizes = {}
    for rows in (10**5, 10**6, 10**7):
        rng = np.random.default_rng(dims)
        codes, height = embedding.cap_of(dims, rows)
        shared, decoded = [], []
        for _ in range(60):
            x, y = rng.standard_normal((2, dims))
            x /= np.linalg.norm(x)
            y -= (x @ y) * x
            y /= np.linalg.norm(y)
            z = embedding.LEAST_COSINE * x + (1 - embedding.LEAST_COSINE**2) ** 0.5 * y
            one, other = (set(embedding.filters_of(v, codes, height)) for v in (x, z))
            shared.append(len(one & other))
            decoded.append(len(one))
        sizes[rows] = rows * np.mean(decoded) / (embedding.TABLES * codes**2)
        print(dims, rows, codes, round(height, 3), np.mean(decoded), np.mean(shared), sizes[rows])
        assert np.mean(np.array(shared) > 0) >= 0.95
    assert max(sizes.values()) < embedding.SMALL_BUCKET


def test_no_link_is_left_out(spark, scratch):
    """Labels whose vectors lean along several directions, which filters serve least, small labels and an id with two vectors."""
    rng, rows = np.random.default_rng(23), []
    for k in range(4):
        lean = rng.standard_normal(64)
        x = rng.standard_normal((500, 64)) / 8 * 0.42 + 0.9 * lean / np.linalg.norm(lean)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((300, 64))
        y -= (y * x[:300]).sum(1, keepdims=True) * x[:300]
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        rows += [(0, v.tolist()) for v in np.concatenate([x, 0.9305 * x[:300] + (1 - 0.9305**2) ** 0.5 * y])]
    rows += [(int(1 + i // 3), v.tolist()) for i, v in enumerate(rng.random((90, 64)))] + [(500, v.tolist()) for v in rng.random((60, 24))]
    rows = [(i, label, v) for i, (label, v) in enumerate(rows)]
    got = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4), scratch)
    want = brute(rows)
    print("links", sum(n for n, _ in got.values()), sum(n for n, _ in want.values()))
    assert got == want


def test_exact_check_over_several_blocks(spark, scratch, monkeypatch):
    """With filters that find nothing, the exact check finds every link, over blocks of a few rows as over one."""
    monkeypatch.setattr(embedding, "MOST_SIDES", -1)
    monkeypatch.setattr(embedding, "BLOCK_BYTES", 64 * 40 * 4)
    monkeypatch.setattr(embedding, "SMALL_LABEL", 8)
    monkeypatch.setattr(embedding, "STRIP", 7)
    rows = clustered(5, [1, 2, 3, 12, 1, 9, 4, 4, 7, 9, 2, 2, 8, 8, 8, 11, 13])
    got = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3), scratch)
    assert got == brute(rows)
