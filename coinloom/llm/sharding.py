"""Hierarchical weighted hash tree: documents descend region, rack and shard by hash draws.

Every draw is exponential with the weight as its rate, -ln(u) / weight, where u comes from a
hash of the document id and the place drawn for; the smallest draw wins, so a place gets its
share of the weight. At every level a place draws with the weight of all that is below it.

A tree grows by *generations*: what is added at a time, a shard or whole racks, is a tree of
its own. A region draws once for each generation that it is part of; the draw that wins says
region and generation, and the descent goes on among the racks, then the shards, of that
generation. Draws that were there stay as they are, and the smaller of two exponential draws
is an exponential draw of the summed rate. So shares stay right, and a document moves only
where an added draw beats its old one, into the subtree that was added. One more shard takes
documents only into itself.

A weight that falls lengthens the draws on its path alone, newest generation first: documents
leave the region, in it the rack, in it the shard, whose weights fell, and no other place gives
any up. A weight of 0 takes a place out. Each generation costs a region one draw more;
``renewed`` makes them one again, which moves documents.

Only DataFrame functions are used. Cases: a null id draws as one fixed key; a null text has
size 1 and the checksum of an empty text; rows of equal ids share a shard and are told apart
by text checksum and size in the order of slots (full repeats take their slots in any order);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard are ranked in blocks of about this many.
BLOCK_ROWS = 200_000
#: Blocks of a shard at most: bounds the table of their counts, which is broadcast.
MOST_BLOCKS = 4096


#: Full repeats of a row get their slots in runs of so many.
RUN = 100_000

Weights = dict[str, dict[str, dict[int, float]]]


@dataclass(frozen=True)
class Tree:
    """generations[k][region][rack][shard] = weight that generation k gave the shard."""

    generations: tuple[Weights, ...]

    @classmethod
    def of(cls, weights: Weights) -> Tree:
        return cls((weights,))

    @classmethod
    def even(cls, shards: int, racks: int = 4, regions: int = 2) -> Tree:
        """A tree of equal shards, dealt over racks and these over regions."""
        tree: Weights = {}
        for shard in range(shards):
            rack = shard * racks // shards
            tree.setdefault(f"region{rack * regions // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
        return cls.of(tree)

    def grow(self, added: Weights) -> Tree:
        """The tree with a generation more: weights that are added to shards, old or new."""
        if not all(w > 0 for racks in added.values() for shards in racks.values() for w in shards.values()):
            raise ValueError("added weights are positive")
        return Tree((*self.generations, added))

    def grant(self, region: str, rack: str, shard: int, weight: float) -> Tree:
        return self.grow({region: {rack: {shard: weight}}})

    def weight(self, region: str, rack: str, shard: int) -> float:
        return sum(g.get(region, {}).get(rack, {}).get(shard, 0.0) for g in self.generations)

    def shrink(self, region: str, rack: str, shard: int, weight: float) -> Tree:
        """The tree with so much less weight for a shard, taken from the newest generation first."""
        if not 0 < weight <= self.weight(region, rack, shard):
            raise ValueError("a shard can lose no more weight than it has")
        out: list[Weights] = []
        for old in reversed(self.generations):
            has = old.get(region, {}).get(rack, {}).get(shard, 0.0)
            gone = min(has, weight)
            weight -= gone
            out.append({r: {k: {s: w - gone if (r, k, s) == (region, rack, shard) else w for s, w in shards.items()} for k, shards in racks.items()} for r, racks in old.items()} if gone else old)
        return Tree(tuple(reversed(out)))

    def renewed(self) -> Tree:
        """One generation with the weights of all."""
        sums: Weights = {}
        for g in self.generations:
            for region, racks in g.items():
                for rack, shards in racks.items():
                    for shard, w in shards.items():
                        own = sums.setdefault(region, {}).setdefault(rack, {})
                        own[shard] = own.get(shard, 0.0) + w
        return Tree.of(sums)


def _draw(key: Column, place: str, weight: float) -> Column:
    """-ln(u) / weight, with u uniform in (0, 1) from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(place), key), 11).cast("double")
    return -F.log((bits + 0.5) * float(2.0**-53)) / F.lit(float(weight))


def _least(draws: list[tuple[Column, Column]]) -> Column:
    """The value that goes with the smallest draw."""
    return F.array_min(F.array(*(F.struct(d.alias("draw"), v.alias("value")) for d, v in draws)))["value"]


def _weight(node) -> float:
    return sum(_weight(x) for x in node.values()) if isinstance(node, dict) else node


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: smallest draw among regions of all generations, then racks, then shards."""

    def descend(node: dict, path: str) -> Column:
        draws, inner = [], []
        for name, child in node.items():
            if _weight(child) > 0:
                at = f"{path}/{name}"
                draws.append((_draw(key, at, _weight(child)), F.lit(at)))
                inner.append((at, descend(child, at) if isinstance(child, dict) else F.lit(int(name))))
        if not inner:
            raise ValueError("a tree needs a shard with weight")
        if len(inner) == 1:
            return inner[0][1]
        won, out = _least(draws), inner[-1][1]
        for at, then in inner[:-1]:
            out = F.when(won == at, then).otherwise(out)
        return out

    return descend({f"{k}/{region}": racks for k, g in enumerate(tree.generations) for region, racks in g.items()}, "")


def assign(docs: DataFrame, tree: Tree, grown: Tree, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: size, checksum, shard, slot in the shard, and grown_shard.

    Slots are gapless from 0. Full repeats of a row are counted before the shuffle and travel as
    one. A shard is ranked in blocks by hash, in id order inside a block, so that no task holds a
    whole shard; the blocks' counts, at most shards times MOST_BLOCKS rows, give each block's
    first slot.
    """
    key = F.col("doc_id")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    blocks = min(MOST_BLOCKS, max(1, total // BLOCK_ROWS))
    own = ["doc_id", "text_crc32", "size"]
    rows = rows.groupBy(own).agg(F.count("*").alias("repeats"))
    rows = rows.withColumns({"shard": shard_of(key, tree).cast("int"), "grown_shard": shard_of(key, grown).cast("int"), "block": F.pmod(F.xxhash64(*own), F.lit(blocks))})
    counts = rows.groupBy("shard", "block").agg(F.sum("repeats").alias("count"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "block").orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("repeats").over(order), F.lit(0)))
    placed = ranked.join(F.broadcast(firsts), ["shard", "block"]).withColumn("slot", F.col("first") + F.col("rank"))
    # A row that repeats takes a run of slots; the runs are cut so that no array is long.
    placed = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1, F.lit(RUN).cast("long"))))
    placed = placed.withColumn("place", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("repeats")) - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("place")).cast("long").alias("slot"), "grown_shard")
