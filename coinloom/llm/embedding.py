"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a product code: a random rotation cuts the space into two blocks, each
block has CODES random unit vectors, and every pair of them is one direction, CODES squared in
all. A vector is list-decoded to all directions whose inner product with it exceeds HEIGHT
standard deviations: block products are sorted, so that for each code of the first block the
codes of the second that suffice are a run. Vectors of equal label that share a direction are
candidates; those on like sides of 64 random hyperplanes are held against each other in double precision.

Equal vectors are one node with a count. Candidates of small buckets are compared pair by
pair. Large buckets, that is groups of near copies, are merged into clusters, cut into tiles of
bounded size, and compared tile against tile: a tile returns counts of links and a spanning
forest, never its pairs. Vectors that lean one way fill large buckets too, though they are no
copies: where those of a bucket lie apart from its first, the bucket is split by their sides of a few
hyperplanes through the mean of their label, others for each direction, and only parts that are still large are merged.

HEIGHT and CODES suit some 1e5 distinct vectors a label. Where the largest label would fill a bucket
with more than BUCKET unrelated vectors, caps become higher until it doesn't, and directions more
so that two vectors of LEAST_COSINE still share as many on average. In few dimensions HEIGHT deviations would
be beyond reach, so a cap is never higher than MOST_HEIGHT to begin with and there are fewer codes.

Filters may miss a pair, so an exact check follows: vectors of a label lie in blocks of bounded size, each two
blocks are multiplied in single precision, and pairs that may reach LEAST_COSINE, share no cluster and were not linked
are held against each other in double precision as the others are. No link is lost; the check takes time as the square of a label.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null
label or id, link with nothing; vectors of different length never link; rows that share an id
are one vertex; repeated rows count as vectors; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

LEAST_COSINE = 0.93
#: Independent product codes, codes of a block, and the height of a cap in standard deviations.
TABLES, CODES, HEIGHT = 8, 512, 3.8
#: Unrelated vectors that share a bucket, about, and how many times more directions a vector may exceed for that.
BUCKET, MOST_DECODED = 5, 8
#: Largest inner product that a cap asks for, and directions of a table that a vector exceeds, about.
MOST_HEIGHT, DECODED = 0.5, 8
#: Sides of 64 random hyperplanes on which candidates may differ: 5 deviations above what LEAST_COSINE gives.
MOST_SIDES = 22
SMALL_BUCKET = 16
#: Sides out of 64 on which vectors of a bucket differ from its first on average, beyond which they are no group of copies,
#: the most hyperplanes that split such a bucket, and the largest part that is compared pair by pair.
APART, MOST_SPLIT, SMALL_PART = 14, 10, 128
TILE = 1024
#: Exact check: bytes of a block in single precision, rows of it that are multiplied at once, and vectors of labels that share a group.
BLOCK_BYTES, STRIP, SMALL_LABEL = 16 * 2**20, 128, 1024


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision and their digests; null where a row can't link."""
    for batch in batches:
        digests, units = [], []
        for label, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            unit = None
            if label is not None and value and all(x is not None for x in value):
                x = np.array(value, np.float64) + 0.0
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    unit = x / top
                    unit /= np.linalg.norm(unit)
            digests.append(None if unit is None else hashlib.blake2b(repr(label).encode() + b"|" + x.tobytes(), digest_size=16).digest())
            units.append(None if unit is None else unit.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "digest", "unit"])


_codes: dict[tuple[int, int, int], tuple[np.ndarray, list[np.ndarray]]] = {}


def _code(dims: int, table: int, codes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and unit codes of the two blocks."""
    key = (dims, table, codes)
    if key not in _codes:
        rng = np.random.default_rng([dims, table, 9])
        rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        blocks = []
        for size in (dims // 2, dims - dims // 2):
            c = rng.standard_normal((codes, max(1, size)))
            blocks.append((c / np.linalg.norm(c, axis=1, keepdims=True))[:, :size])
        _codes[key] = (rotation, blocks)
    return _codes[key]


def _tail(dims: int, at: np.ndarray) -> np.ndarray:
    """Share of the sphere whose inner product with a direction is at or above each value."""
    t = np.linspace(-1, 1, 200_002)[1:-1]
    density = (1 - t**2) ** ((dims - 3) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return np.interp(at, t, above, left=1.0, right=0.0)


def _both(dims: int, height: float) -> float:
    """How likely a direction that one vector exceeds is also exceeded by another of LEAST_COSINE to it."""
    t = np.linspace(height, min(1.0, height + 8 / dims**0.5), 2001)[:-1]
    weight = (1 - t**2) ** ((dims - 3) / 2)
    across = (1 - LEAST_COSINE**2) ** 0.5 * np.sqrt(1 - t**2)
    return float((weight * _tail(max(2, dims - 1), (height - LEAST_COSINE * t) / across)).sum() / weight.sum())


@cache
def cap_of(dims: int, rows: int) -> tuple[int, float]:
    """Codes of a block, and the least inner product with a direction, for so many vectors of a label."""
    height, codes = HEIGHT / dims**0.5, CODES
    if height > MOST_HEIGHT:
        height = MOST_HEIGHT
        codes = max(4, round((DECODED / float(_tail(dims, np.array(height)))) ** 0.5))
    share = float(_tail(dims, np.array(height)))
    if rows * share <= BUCKET or dims < 3:
        return codes, height
    shared = _both(dims, height)
    heights = np.linspace(height, 0.95, 400)
    shares = _tail(dims, heights)
    best = codes, height
    for h, p in zip(heights.tolist(), shares.tolist(), strict=True):
        more = shared / max(_both(dims, h), 1e-12)
        if p <= 0 or more > MOST_DECODED:
            break
        best = round(codes * (share / p * more) ** 0.5), h
        if rows * p <= BUCKET:
            break
    return best


def filters_of(unit: np.ndarray, codes: int, height: float) -> list[int]:
    """Numbers of all directions whose inner product with the vector is height or more."""
    dims, out = len(unit), []
    least = height * 2**0.5  # a direction is (c1, c2) / sqrt(2)
    for table in range(TABLES):
        rotation, (first, second) = _code(dims, table, codes)
        turned = rotation @ unit
        p, q = first @ turned[: dims // 2], second @ turned[dims // 2 :]
        order = np.flatnonzero(q >= least - p.max())  # the others suffice for no code of the first block
        order = order[np.argsort(-q[order], kind="stable")]
        reach = np.searchsorted(-q[order], p - least, side="right")
        for c in np.flatnonzero(reach).tolist():
            out += ((table * codes + c) * codes + order[: reach[c]]).tolist()
    return out


def sides_of(unit: np.ndarray) -> int:
    """The sides of 64 random hyperplanes that a vector is on, as a signed 64-bit number."""
    key = (len(unit), -1, 64)
    if key not in _codes:
        _codes[key] = (np.random.default_rng([len(unit), 10]).standard_normal((64, len(unit))), [])
    return int(np.packbits(_codes[key][0] @ unit > 0).view(np.int64)[0])


def _buckets(rows: int):
    """Directions of each vector, for labels of so many vectors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(u, np.float64) for u in batch.column(1).to_pylist()]
            found = [filters_of(u, *cap_of(len(u), rows)) for u in units]
            many = [len(f) for f in found]
            flat = [x for f in found for x in f]
            labels = batch.column(2).take(pa.array(np.repeat(np.arange(len(found)), many)))
            nodes, sides = (pa.array(np.repeat(x, many), pa.int64()) for x in (batch.column(0).to_numpy(), np.array([sides_of(u) for u in units], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), labels, nodes, sides], names=["filter", "label", "node", "sides"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a batch's vectors by label and length."""
    for batch in batches:
        sums: dict[tuple, list] = {}
        for label, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(unit, np.float64)
            had = sums.get((label, len(unit)), (0, 0.0))
            sums[label, len(unit)] = (had[0] + 1, had[1] + x)
        labels, widths = [k[0] for k in sums], [k[1] for k in sums]
        yield pa.RecordBatch.from_arrays([pa.array(labels, batch.column(0).type), pa.array(widths, pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["label", "width", "n", "total"])


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(t, np.float64) for t in group["total"])
    return group[["label", "width"]].head(1).assign(mean=(total / group["n"].sum()).tobytes())


def _own_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sides of hyperplanes through the mean of the label."""
    for batch in batches:
        sides = [sides_of(np.frombuffer(u, np.float64) - np.frombuffer(m, np.float64)) for u, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sides, pa.int64())], names=["node", "own"])


def _split(in_buckets: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets with part, -1 where they are whole: large ones of vectors that lie apart are split by hyperplanes."""
    key = ["filter", "label"]
    large = in_buckets.where(F.col("size") > SMALL_BUCKET)
    apart = large.groupBy(key).agg(F.avg(F.expr("bit_count(sides ^ center_sides)")).alias("apart"))
    large = scratch.table(large.join(apart, key).drop("center_sides"), "large_buckets")

    kind = dict(reps.dtypes)["label"]
    sums = reps.select("label", "unit").mapInArrow(_sums, f"label {kind}, width int, n long, total binary")
    means = scratch.table(sums.groupBy("label", "width").applyInPandas(_mean, f"label {kind}, width int, mean binary"), "means")
    own = reps.withColumn("width", F.length("unit")).join(means, ["label", "width"]).select("node", "unit", "mean").mapInArrow(_own_sides, "node long, own long")

    by = f"least({MOST_SPLIT}, cast(ceil(log2(size / {SMALL_BUCKET // 2})) as int))"
    parts = large.where(F.col("apart") > APART).join(own, "node").withColumn("turn", F.pmod(F.xxhash64("filter"), F.lit(64)).cast("int"))
    parts = parts.withColumn("part", F.expr(f"(shiftrightunsigned(own, turn) | shiftleft(own, 64 - turn)) & (shiftleft(1L, {by}) - 1)")).select(*key, "part", "node", "sides")
    sizes = parts.groupBy(*key, "part").agg(F.count("*").alias("size"), F.min("node").alias("center")).where("size > 1")
    parts = parts.join(sizes, [*key, "part"])

    whole = in_buckets.where(F.col("size") <= SMALL_BUCKET).drop("center_sides").unionByName(large.where(F.col("apart") <= APART).drop("apart"))
    return scratch.table(whole.withColumn("part", F.lit(-1).cast("long")).unionByName(parts), "buckets")


def _linked(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of at least LEAST_COSINE, with the number of vectors on either side."""

    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_cosine(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    side = reps.select("node", "unit", "copies")
    both = pairs.join(side.toDF("a", "unit_a", "copies_a"), "a").join(side.toDF("b", "unit_b", "copies_b"), "b")
    return both.where(F.pandas_udf(cosine, "double")("unit_a", "unit_b") >= LEAST_COSINE).select("a", "b", "copies_a", "copies_b")


def _cosine(p: bytes, q: bytes) -> float:
    x, y = np.frombuffer(p, np.float64), np.frombuffer(q, np.float64)
    return float(x @ y) if len(x) == len(y) else -1.0


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of links (b null) and a spanning forest of links (n 0) between two tiles.

    With one tile only, its pairs with itself.
    """
    group = group.sort_values("node", ignore_index=True)
    x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
    left, right = group[group["tile"] == x], group[group["tile"] == y]
    rows: list[tuple] = []
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while parent.get(k, k) != k:
            parent[k] = k = parent.get(parent[k], parent[k])
        return k

    for size in sorted({len(u) for u in group["unit"]}):
        one, two = (s[s["unit"].map(len) == size] for s in (left, right))
        if one.empty or two.empty:
            continue
        p, q = (np.stack([np.frombuffer(u, np.float64) for u in s["unit"]]) for s in (one, two))
        link = p @ q.T >= LEAST_COSINE
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        link &= a[:, None] != b[None, :]
        rows += [(n, None, int(c)) for n, c in zip(a.tolist(), (link @ two["copies"].to_numpy()).tolist(), strict=True) if c]
        if x != y:
            rows += [(n, None, int(c)) for n, c in zip(b.tolist(), (one["copies"].to_numpy() @ link).tolist(), strict=True) if c]
        for i, n in enumerate(a.tolist()):
            for m in b[link[i]].tolist():
                r, s = find(n), find(m)
                if r != s:
                    parent[max(r, s)] = min(r, s)
                    rows.append((n, m, 0))
    return pd.DataFrame({"a": pd.Series([r[0] for r in rows], dtype="int64"), "b": pd.Series([r[1] for r in rows], dtype="Int64"), "n": pd.Series([r[2] for r in rows], dtype="int64")})


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in single precision."""
    for batch in batches:
        units = pa.array([np.frombuffer(u, np.float64).astype(np.float32).tobytes() for u in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], units], names=["part", "node", "cluster", "unit"])


def _may_link(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of nodes of two blocks, or of one with itself, that may reach LEAST_COSINE and share no cluster."""
    pairs = [np.empty((0, 2), np.int64)]
    for _, own in group.groupby("part", sort=False):
        x, y = int(own["x"].iloc[0]), int(own["y"].iloc[0])
        sides = []
        for block in (x, y):
            s = own[own["block"] == block]
            if s.empty:
                break
            units = np.frombuffer(b"".join(s["unit"]), np.float32).reshape(len(s), -1)
            sides.append((s["node"].to_numpy(), s["cluster"].isna().to_numpy(), s["cluster"].fillna(0).to_numpy(np.int64), units))
        if len(sides) < 2:
            continue
        (a, free, of_a, p), (b, b_free, of_b, q) = sides
        # Rounding to single precision can't lower a cosine by more.
        least = np.float32(LEAST_COSINE - (p.shape[1] + 8) * 1.2e-7)
        for at in range(0, len(a), STRIP):
            cut = slice(at, at + STRIP)
            first = at if x == y else 0
            link = p[cut] @ q[first:].T >= least
            if not free[cut].all() and not b_free[first:].all():
                link &= free[cut][:, None] | b_free[first:][None, :] | (of_a[cut][:, None] != of_b[first:][None, :])
            i, j = np.nonzero(link)
            m, n = a[cut][i], b[first:][j]
            found = np.stack([np.minimum(m, n), np.maximum(m, n)], axis=1)[m != n]
            pairs.append(np.unique(found, axis=0) if len(found) else found)
    found = np.concatenate(pairs)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def _missed(linked: DataFrame, clusters: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that filters left out, in the form of linked."""
    widths = reps.withColumn("width", F.length("unit"))
    sizes = widths.groupBy("label", "width").agg(F.count("*").alias("n")).where("n > 1").withColumn("part", F.monotonically_increasing_id())
    sizes = sizes.withColumns({"blocks": F.expr(f"cast(ceil(n * width / 2 / {BLOCK_BYTES}) as int)"), "alone": F.expr(f"n > {SMALL_LABEL}")})
    sizes = scratch.table(sizes, "labels")
    small = sizes.where("not alone").agg(F.sum(F.expr("n * width / 2"))).first()[0] or 0
    groups = max(1, int(small // BLOCK_BYTES), min(64, int(small // 2**16)))
    sizes = sizes.withColumn("together", F.when(F.col("alone"), F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(groups)) - groups))
    rows = widths.join(sizes.select("label", "width", "part"), ["label", "width"]).join(clusters, "node", "left").select("part", "node", "cluster", "unit").mapInArrow(_narrow, "part long, node long, cluster long, unit binary")
    rows = rows.join(sizes.select("part", "blocks", "together"), "part").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).select("together", "part", "x", "y", "block", "node", "cluster", "unit")
    found = rows.groupBy("together", "x", "y").applyInPandas(_may_link, "a long, b long").distinct().join(linked.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return scratch.table(_linked(scratch.table(found, "unlinked"), reps), "missed")


def near_duplicates(vectors: DataFrame, scratch: Scratch, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    kind = dict(rows.dtypes)["label"]
    seen = scratch.table(rows.mapInArrow(_vectors, f"vec_id long, label {kind}, digest binary, unit binary"), "seen")
    named = seen.where("digest is not null and vec_id is not null")
    reps = named.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"), F.any_value("label").alias("label"))
    reps = scratch.table(reps, "reps")

    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    decoded = reps.select("node", "unit", "label").mapInArrow(_buckets(largest), f"filter long, label {kind}, node long, sides long")
    decoded = scratch.table(decoded, "decoded")
    sizes = decoded.groupBy("filter", "label").agg(F.count("*").alias("size"), F.min("node").alias("center"), F.min_by("sides", "node").alias("center_sides")).where("size > 1")
    in_buckets = _split(scratch.table(decoded.join(sizes, ["filter", "label"]), "in_buckets"), reps, scratch)
    is_large = F.col("size") > F.when(F.col("part") < 0, SMALL_BUCKET).otherwise(SMALL_PART)

    large = in_buckets.where(is_large).select("node", "center").distinct()
    chained = components(large.select(F.col("node").alias("a"), F.col("center").alias("b")), scratch, "clusters").select("node", F.col("component").alias("cluster"))
    clusters = large.select("node").distinct().join(chained, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
    clusters = scratch.table(clusters, "cluster_of")

    small = in_buckets.where(~is_large).select("filter", "label", "part", "node", "sides")
    pairs = small.toDF("filter", "label", "part", "a", "sides_a").join(small.toDF("filter", "label", "part", "b", "sides_b"), ["filter", "label", "part"])
    pairs = pairs.where(f"a < b and bit_count(sides_a ^ sides_b) <= {MOST_SIDES}").select("a", "b").distinct()
    pairs = pairs.join(clusters.toDF("a", "of_a"), "a", "left").join(clusters.toDF("b", "of_b"), "b", "left")
    pairs = pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b")
    linked = scratch.table(_linked(pairs, reps), "linked")
    linked = linked.unionByName(_missed(linked, clusters, reps, scratch))

    sized = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    tiled = clusters.join(sized, "cluster").join(reps.select("node", "unit", "copies"), "node")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}).select("cluster", "x", "y", "tile", "node", "unit", "copies")
    tiles = scratch.table(tiled.groupBy("cluster", "x", "y").applyInPandas(_tile, "a long, b long, n long"), "tiles")

    counts = linked.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).unionByName(linked.select(F.col("b").alias("node"), F.col("copies_a").alias("n"))).unionByName(tiles.where("b is null").select(F.col("a").alias("node"), "n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))

    # Rows that share an id but not a vector are one vertex: their nodes are linked.
    of_id = named.select("vec_id", "digest").distinct().join(reps.select("digest", "node"), "digest").select("vec_id", "node")
    least = of_id.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most")
    links = linked.select("a", "b").unionByName(tiles.where("b is not null").select("a", "b")).unionByName(of_id.join(least, "vec_id").select("a", F.col("node").alias("b")))
    final = components(links, scratch, "final")

    of_digest = reps.select("digest", "node", "copies").join(final, "node", "left").join(counts, "node", "left")
    of_digest = of_digest.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = seen.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(of_digest, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
