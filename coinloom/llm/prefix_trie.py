"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. Turn by turn an active class splits into the classes
of those that go on alike; each class is a node. A class that has come down to one conversation
retires: what is left of it is emitted as a chain of nodes with one child each, without being grouped
again. Rounds take a few turns at first and twice as many each time, so that few rounds reach any
depth at which conversations still part. What lies below folds back in one aggregation along each
conversation's own path.

A class is labelled by what its members share: 128 bits combined from hashes of each turn's place and
of the SHA-256 digest of its role and text. A member knows its label by itself, so no member is joined
to its class, however large that is. Equal conversations are one member with a weight, so only
conversations that differ are refined. Texts aren't shuffled: only digests and sizes are.

Cases: a null role or text counts as empty; turns are taken in their order, null first, those of equal
turn by role, then by digest of the text; rows without a conv_id belong to no conversation and are left
out; conversations without turns are members of the root alone; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Turns that the first round refines; each later round takes twice as many.
FIRST_TURNS = 4
#: Ids in one row of text on the way to the digest of a list.
SEGMENT = 8192
#: A parent with more than one in this many of all nodes as its children is joined by broadcast: there are at most as many of them.
HOT_PARENTS = 256
LABEL = ["high", "low"]


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", texts: bool = False) -> DataFrame:
    """conv_id, pos (from 1), content (digest of role and text) and bytes (of the text) of every turn; with texts role and text too."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), content.alias("content"), F.octet_length(text_).cast("long").alias("bytes"), text_.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "content", "bytes", *(["role", "text"] if texts else []))


def paths(own: DataFrame) -> DataFrame:
    """conv_id, pos, label of the first pos turns, label of those before, bytes of the turn, and of all so far.

    own: conv_id, pos, content, bytes.
    """
    order = Window.partitionBy("conv_id").orderBy("pos")
    rows = own
    for k, name in enumerate(LABEL):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(k), F.col("content"), F.col("pos"))).over(order))
    for name in LABEL:
        rows = rows.withColumn(f"from_{name}", F.lag(name, 1, 0).over(order))
    return rows.withColumn("so_far", F.sum("bytes").over(order)).drop("content")


def _refine(members: DataFrame, path: DataFrame, scratch: Scratch, first: int) -> DataFrame:
    """Rows of members' paths as far as they are refined: conv_id, weight, pos and the columns of path.

    members: conv_id, weight and length of conversations that all differ.
    """
    active, reached, width, refined, k = members.where("length > 0"), 0, first, [], 0
    while True:
        active = scratch.table(active, f"active_{k}")
        if not active.count():
            break
        own = path.where((F.col("pos") > reached) & (F.col("pos") <= reached + width)).join(active.select("conv_id", "weight", "length"), "conv_id")
        own = scratch.table(own, f"refined_{k}")
        refined.append(own)
        reached, width = reached + width, 2 * width
        ends = own.where(F.col("pos") == reached).groupBy(LABEL).agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id"))
        retired = ends.where("members = 1").select("conv_id")
        active = active.where(F.col("length") > reached).join(retired, "conv_id", "left_anti")
        k += 1
    out = refined[0] if refined else path.join(members.select("conv_id", "weight", "length"), "conv_id").limit(0)
    for more in refined[1:]:
        out = out.unionByName(more)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows as text, by label and length, in segments of bounded size."""
    key, first, ids = None, None, []
    names = ["high", "low", "length", "first", "ids"]

    def made(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        out = []
        for high, low, length, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (high, low, length) != key or len(ids) == SEGMENT:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids = (high, low, length), conv, []
            ids.append(str(conv))
        yield made(out)
    yield made([(*key, first, ",".join(ids))] if ids else [])


def _joined_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each list's segments, read as a stream."""
    key, state = None, None
    names = ["high", "low", "length", "ends"]

    def made(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        out = []
        for high, low, length, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (high, low, length) != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (high, low, length), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield made(out)
    yield made([(*key, state.hexdigest())] if state is not None else [])


def _id_lists(whole: DataFrame) -> DataFrame:
    """Digest of the ascending ids of each set of equal conversations: high, low, length, ends.

    Rows are sorted over ranges of label and id, so a set of many ids lies over many tasks; its digest
    is by nature one stream, which reads texts of SEGMENT ids in order.
    """
    order = [*LABEL, "length", "conv_id"]
    rows = whole.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = rows.mapInArrow(_segments, "high long, low long, length long, first long, ids string")
    parts = parts.repartition(*LABEL, "length").sortWithinPartitions(*LABEL, "length", "first")
    return parts.mapInArrow(_joined_digest, "high long, low long, length long, ends string")


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _with_parents(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes with parent_conv_id and n_children. A parent with very many children is broadcast, the others are shuffled."""
    up = [F.col(f"from_{c}").alias(c) for c in LABEL]
    kids = scratch.table(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *up).agg(F.count("*").alias("n_children")), "children")
    nodes = scratch.table(nodes.join(kids, ["depth", *LABEL], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "with_children")
    hot = F.col("n_children") > F.lit(nodes.count() // HOT_PARENTS)
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"from_{c}") for c in LABEL], F.col("conv_id").alias("parent"), "n_children")
    on = ["depth", "from_high", "from_low"]
    common = F.broadcast(parents.where(hot).select(*on, F.col("parent").alias("hot_parent")))
    rare = parents.where(~hot).select(*on, "parent")
    out = nodes.join(common, on, "left")
    under = out.where(F.col("hot_parent").isNotNull()).withColumn("parent_conv_id", F.col("hot_parent"))
    other = out.where(F.col("hot_parent").isNull()).join(rare, on, "left").withColumnRenamed("parent", "parent_conv_id")
    return under.drop("hot_parent").unionByName(other.drop("hot_parent"))


def trie(ids: DataFrame, own: DataFrame, scratch: Scratch, first: int = FIRST_TURNS) -> DataFrame:
    """One row per node: smallest member, depth, parent's smallest member, members, children, leaves below, bytes saved, digest of the members that end there.

    ids: conv_id of every conversation, once each, with turns or without; own: conv_id, pos (gapless
    from 1), content, bytes. Saved are, for each node below and itself, the bytes of its last text times
    the members but one.
    """
    path = scratch.table(paths(own), "paths")
    last = path.groupBy("conv_id").agg(F.max("pos").alias("length"), F.max_by(F.struct(*LABEL), "pos").alias("label"))
    zero = F.lit(0).cast("long")
    whole = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("length", zero).alias("length"), *[F.coalesce(F.col("label")[c], zero).alias(c) for c in LABEL])
    whole = scratch.table(whole, "whole")
    members = scratch.table(whole.groupBy(*LABEL, "length").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "members")
    ends = scratch.table(_id_lists(whole), "ends")

    refined = scratch.table(_refine(members, path, scratch, first), "refined")
    root = members.select("conv_id", "weight", "length", zero.alias("pos"), *[zero.alias(c) for c in LABEL], *[zero.alias(f"from_{c}") for c in LABEL], zero.alias("bytes"), zero.alias("so_far"))
    steps = refined.unionByName(root)

    # The classes of all refined depths; a chain's first node stands with them, as a child of the class that retired.
    nodes = steps.groupBy(F.col("pos").alias("depth"), *LABEL).agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), *[F.first(f"from_{c}").alias(f"from_{c}") for c in LABEL])
    nodes = scratch.table(nodes, "classes")
    reached = refined.groupBy("conv_id").agg(F.max("pos").alias("reached"))
    total = path.groupBy("conv_id").agg(F.sum("bytes").alias("total"))
    info = members.join(reached, "conv_id", "left").join(total, "conv_id", "left").withColumns({"reached": F.coalesce("reached", zero), "total": F.coalesce("total", zero)})
    info = scratch.table(info.join(ends, [*LABEL, "length"]), "info")
    chained = F.col("reached") < F.col("length")
    joint = path.join(info.where(chained).select("conv_id", "weight", "reached"), "conv_id").where(F.col("pos") == F.col("reached") + 1)
    joint = joint.select(F.col("pos").alias("depth"), *LABEL, "conv_id", F.col("weight").alias("n_convs"), *[f"from_{c}" for c in LABEL], F.lit(True).alias("joint"))
    counted = scratch.table(_with_parents(nodes.withColumn("joint", F.lit(False)).unionByName(joint), scratch), "counted")

    # Fold back: what a member adds to each class on its path. A turn's bytes are saved but for the class's first member,
    # which brings all from the depth on at which it begins to be the first.
    begins = refined.join(nodes.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("pos")), ["conv_id", "pos"])
    begins = begins.select("conv_id", F.col("pos").alias("begins"), (F.col("so_far") - F.col("bytes")).alias("shared"))
    childless = counted.where("not joint and n_children = 0").select(F.col("depth").alias("length"), *LABEL, F.lit(1).cast("long").alias("leaf"))
    adds = info.join(begins, "conv_id", "left").join(childless, ["length", *LABEL], "left")
    adds = adds.select("conv_id", "total", "begins", F.coalesce("shared", "total").alias("shared"), F.when(chained, F.lit(1).cast("long")).otherwise(F.coalesce("leaf", zero)).alias("leaf"))
    below = F.col("total") - F.col("so_far") + F.col("bytes")
    brings = F.when(F.col("pos") >= F.col("begins"), below).otherwise(F.col("total") - F.col("shared"))
    folded = steps.join(scratch.table(adds, "adds"), "conv_id").groupBy(F.col("pos").alias("depth"), *LABEL).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * below - brings).alias("saved_tokens"))

    at_end = ends.withColumnRenamed("length", "depth")
    out = counted.where("not joint").join(folded, ["depth", *LABEL]).join(at_end, ["depth", *LABEL], "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))
    # Chains: the first node has its parent above, a further one the node of the same member.
    above = counted.where("joint").select("conv_id", F.col("parent_conv_id").alias("above"))
    rest = path.join(info.where(chained).join(above, "conv_id").drop(*LABEL), "conv_id").where("pos > reached")
    last_turn = F.col("pos") == F.col("length")
    chain = rest.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("reached") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last_turn, zero).otherwise(F.lit(1).cast("long")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * below).alias("saved_tokens"),
        F.when(last_turn, F.col("ends")).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    return out.select(_NODE).unionByName(chain.select(_NODE))


def build(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie of conversations as they are."""
    own = scratch.table(turns(conversations), "turns")
    return trie(own.select("conv_id").distinct(), own, scratch)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of conversations as they are, with role and text of their last turn; the root has none."""
    own = turns(conversations, texts=True).select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(own, ["conv_id", "depth"], "left")


def rebuilt(own: DataFrame, group: int, most: Column, at_most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations with a common start: the first turns of the group's first, then their own later ones.

    own: conv_id, pos, content, bytes. most: how many turns a conversation takes over, no more than
    at_most. The group of c starts at c - c % group. Returns conv_id of all, and their turns with pos
    gapless from 1.
    """
    ids = own.select("conv_id").distinct().withColumn("takes", most)
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    heads = own.where(F.col("pos") <= at_most).withColumnRenamed("conv_id", "base")
    taken = ids.select("conv_id", base, "takes").join(heads, "base").where(F.col("pos") <= F.col("takes")).drop("base")
    kept = own.join(ids, "conv_id").where(F.col("pos") > F.col("takes"))
    both = taken.withColumn("part", F.lit(0)).unionByName(kept.withColumn("part", F.lit(1)))
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    return ids.select("conv_id"), both.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "content", "bytes")
