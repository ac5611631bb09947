"""MinHash near-duplicates: universal hash minima, banding, verification, components.

1. Each document's set of distinct word shingles gets a digest and HASHES minima under
   multiply-add-shift hash functions. Equal sets are one node, named by their smallest id.
2. Minima are cut into bands; nodes that agree on a band share a bucket. Two sets of
   resemblance 0.8 share none of 32 bands of 5 with a probability of 3e-6.
3. In every bucket each node is paired with the smallest one only. Pairs whose signatures
   agree too little are dropped; the others are held against the full sets.
4. Verified links give components. A bucket within one component is done. Buckets that still
   hold several are compared in full: small ones pair by pair across components; large ones
   in tiles of bounded size, every node outside the largest component against all nodes. So a
   hot bucket of near copies costs a star, and no link is lost where it is not one component.

Cases: null and empty texts have no shingles and stand alone; a null id is never a
representative (its row is kept if it has no linked id); rows that share an id are one vertex;
repeated rows, ties and very long texts need no special path; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, give_back, mix64, shingle_sets
from .components import components

#: Words a shingle by the contract of op8; the general rule for stages is GENERAL.
SHINGLE, GENERAL = 2, 5
SIMILARITY = 80  # percent
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signatures that agree on a smaller share are not verified: 5.7 standard deviations below 0.8.
LEAST_AGREEMENT = 0.62
#: Buckets up to this size are compared pair by pair, larger ones in tiles of about TILE nodes and TILE_BYTES of text at most.
SMALL_BUCKET = 16
TILE, TILE_BYTES = 512, 16 << 20

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of (a x + b mod 2**64) >> 32, in blocks of shingles."""
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 2048):
        hashed = shingles[i : i + 2048, None] * _MULTIPLY + _ADD
        np.minimum(out, (hashed.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of its number and minima."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _signatures(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sizes, digests and signatures of the texts' sets of shingles of so many words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, signatures = [], [], []
            for own in shingle_sets(batch.column(1), words):
                n.append(len(own))
                digests.append(hashlib.blake2b(own, digest_size=16).digest() if len(own) else None)
                signatures.append(minima(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )
        give_back()

    return sign


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(s, np.uint32)) for s in batch.column(1).to_pylist()]
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.int64)])), pa.array(nodes, pa.int64())], names=["bucket", "node"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets resemble each other enough."""
    if 100 * min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree on LEAST_AGREEMENT of the minima."""

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        same = [(np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)).mean() for p, q in zip(x, y, strict=True)]
        return pd.Series(same, dtype="float64")

    sig = reps.select("node", "signature")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
    both = both.join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b")
    return both.where(F.pandas_udf(agree, "double")("sig_a", "sig_b") >= LEAST_AGREEMENT).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs whose full sets resemble each other enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words)
            ok = [alike(x, y) for x, y in zip(left, right, strict=True)]
            out = [(p, q) for p, q, yes in zip(a, b, ok, strict=True) if yes]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over blocks of shingles."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    step = 8192
    for i in range(0, len(shared), step):
        part = shared[i : i + step]
        tables = []
        for side in (left, right):
            table = np.zeros((len(side), len(part)), np.float32)
            for row, own in zip(table, side, strict=True):
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], side="right")]
                at = np.searchsorted(part, own)
                row[at[part[at] == own]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _tile(group: pd.DataFrame, words: int) -> pd.DataFrame:
    """Links between a tile of nodes outside the largest component and a tile of all nodes.

    Of the links found, a spanning forest over the components is returned.
    """
    minor, every = group[group["minor"]], group[~group["minor"]]
    if minor.empty or every.empty:
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    left = list(shingle_sets(pa.array(minor["text"]), words))
    right = list(shingle_sets(pa.array(every["text"]), words))
    both = _common(left, right).astype(np.int64)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    link = (100 * both >= SIMILARITY * (total - both)) & (minor["component"].to_numpy()[:, None] != every["component"].to_numpy()[None, :])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    a, b = minor["node"].tolist(), every["node"].tolist()
    ca, cb = minor["component"].tolist(), every["component"].tolist()
    for i, j in zip(*np.nonzero(link), strict=True):
        p, q = find(ca[i]), find(cb[j])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((a[i], b[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _cross_large(open_rows: DataFrame, texts: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """Links across components among the nodes of large buckets.

    Large buckets that overlap form one cluster, so that a node is compared once and not once
    for each of its bands.
    """
    large = open_rows.where(F.col("size") > SMALL_BUCKET)
    chained = components(large.select(F.col("node").alias("a"), F.col("center").alias("b")), scratch, "clusters")
    rows = large.select("node", "component").distinct().join(chained.withColumnRenamed("component", "cluster"), "node", "left")
    rows = scratch.table(rows.withColumn("cluster", F.coalesce("cluster", "node")), "cluster_rows")
    sizes = texts.groupBy("node").agg(F.sum("bytes").alias("bytes"))
    parts = rows.join(sizes, "node").groupBy("cluster", "component").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))
    main = F.max_by(F.struct("component", "count", "bytes"), F.struct("count", "component"))
    of = parts.groupBy("cluster").agg(main.alias("main"), F.sum("count").alias("n"), F.sum("bytes").alias("bytes")).where("n > main.count")

    def of_size(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / TILE, size / TILE_BYTES)).cast("int")

    tiles, minor_tiles = of_size(F.col("n"), F.col("bytes")), of_size(F.col("n") - F.col("main.count"), F.col("bytes") - F.col("main.bytes"))
    of = of.select("cluster", F.col("main.component").alias("main"), tiles.alias("tiles"), minor_tiles.alias("minor_tiles"))
    rows = rows.join(of, "cluster").join(texts.drop("bytes"), "node")
    tiles, minor_tiles = F.col("tiles"), F.col("minor_tiles")
    one = rows.where(F.col("component") != F.col("main")).select(
        "cluster", "node", "component", "text", F.lit(True).alias("minor"),
        F.pmod(F.xxhash64("node", F.lit(1)), minor_tiles).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), tiles.cast("long") - 1)).alias("y"),
    )
    other = rows.select(
        "cluster", "node", "component", "text", F.lit(False).alias("minor"),
        F.explode(F.sequence(F.lit(0).cast("long"), minor_tiles.cast("long") - 1)).alias("x"), F.pmod(F.xxhash64("node", F.lit(2)), tiles).alias("y"),
    )
    return one.unionByName(other).groupBy("cluster", "x", "y").applyInPandas(lambda group: _tile(group, words), "a long, b long")


def _cross_small(open_rows: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs of nodes of different components in small buckets, without those looked at before."""
    small = open_rows.where(F.col("size") <= SMALL_BUCKET).select("bucket", "node", "component")
    one = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("of_b"))
    other = small.select("bucket", F.col("node").alias("a"), F.col("component").alias("of_a"))
    pairs = one.join(other, "bucket").where("b < a and of_a <> of_b").select("a", "b").distinct()
    return pairs.join(stars, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept; words is the length of a shingle."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.table(rows.mapInArrow(_signatures(words), "doc_id long, n_shingles long, digest binary, signature binary"), "signed")
    named = signed.where("digest is not null and doc_id is not null")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("signature").alias("signature"))
    reps = scratch.table(reps, "reps")

    bands = reps.select("node", "signature").mapInArrow(_bands, "bucket long, node long")
    bands = scratch.table(bands, "bands")
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1")
    in_buckets = scratch.table(bands.join(buckets, "bucket"), "in_buckets")
    scratch.drop("bands")

    nodes = in_buckets.select(F.col("node").alias("doc_id")).distinct()
    nodes = scratch.table(nodes, "nodes")
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    texts = rows.join(nodes, "doc_id", "left_semi")
    # One text of each id and content: repeated rows are not held against each other again and again.
    repeated = scratch.table(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        again = texts.join(repeated, "doc_id", "left_semi").distinct()
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(again)
    texts = scratch.table(texts.select(F.col("doc_id").alias("node"), "text", F.octet_length("text").alias("bytes")), "texts")

    stars = in_buckets.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = scratch.table(stars, "stars")
    first = scratch.table(_linked(_agreeing(stars, reps), texts, words), "first_links")
    of_first = components(first, scratch, "first")

    rows_of = in_buckets.join(of_first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows_of = scratch.table(rows_of, "rows_of")
    several = rows_of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_rows = scratch.table(rows_of.join(several.select("bucket"), "bucket", "left_semi"), "open_rows")
    small = _linked(_agreeing(scratch.table(_cross_small(open_rows, stars), "cross"), reps), texts, words)
    large = _cross_large(open_rows, texts, scratch, words)

    # Rows that share an id but not a text are one vertex: their nodes are linked.
    of_id = named.select("doc_id", "digest").distinct().join(reps.select("digest", "node"), "digest").select("doc_id", "node")
    least = of_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most")
    of_id = of_id.join(least, "doc_id").select("a", F.col("node").alias("b"))
    joined = of_first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = joined.unionByName(small).unionByName(large).unionByName(of_id)
    final = components(links, scratch, "final")

    of_digest = reps.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
