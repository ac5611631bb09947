"""Connected components by alternating large-star and small-star.

Each round is two joins on grouped minima, so no task gathers a node's neighbours: minima are
combined before the shuffle and written, so that the join with them is a broadcast where they
are few and otherwise a plain join of two shuffles, of which adaptive execution splits a hub's
rows. Rounds are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "of_large")
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them."""
    least = keep(edges.groupBy("u").agg(F.min("v").alias("m")), "of_small")
    inner = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not its component's smallest.

    links: pairs of ids in either order; repeated pairs and loops do no harm. Rounds go on until
    one changes nothing, which takes about the square of the logarithm of the longest chain.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, old = scratch.table(edges, f"{name}_0"), f"{name}_0"
    was = None
    for turn in count(1):

        def keep(df: DataFrame, what: str, turn: int = turn) -> DataFrame:
            return scratch.table(df, f"{name}_{turn}_{what}")

        large = keep(_large_star(edges, keep), "large")
        edges = scratch.table(_small_star(large, keep), f"{name}_{turn}")
        scratch.drop(old, *(f"{name}_{turn}_{what}" for what in ("large", "of_large", "of_small")))
        old = f"{name}_{turn}"
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == was or not now[0]:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
