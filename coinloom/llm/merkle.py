"""Merkle manifest of a dataset: a radix-ranked trie of 16-way digests over groups, with proofs.

Ranks come without a global sort. A row's key is written in digits; histograms count the rows that
share a group and the first digits of their keys, and a cell that is still crowded is counted by one
digit more. Cells are numbered from above: a cell's first rank is that of the cell over it and the
counts of the cells before it there, at most 256. Only inside a cell, of bounded size, rows are put in
order. So no task holds a group, however large.

A rank in base FANOUT names a leaf's place in its group's trie, and its leading digits the nodes above
it. Nodes are reduced by longest prefix: runs that share all digits but the last become one digest,
until a group has one node. Group digests are the leaves of a second trie of the same kind. Then the
way goes down again: a node hands each child the siblings beside it and all that it got from above, so
a run of leaves learns its proof in one row and each leaf folds it by itself.

Cases: any column may be null, and counts as the mark of null; a null group comes before all others and
a null id before all ids of its group. Rows of equal id are ordered by leaf digest, full repeats in any
order. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, Scratch

FANOUT = 16
#: Rows that are put in order in one task, at most: a cell with more is counted by a digit more.
CELL = 1 << 15
#: Characters of a key that make a digit: two of hexadecimal, so 256 values.
DIGIT = 2
#: Full repeats of a row are set out in runs of so many.
RUN = 100_000
#: A row is tampered with, for the query's check of proofs, where this divides the checksum of its decimal id.
TAMPER = 5


def digest(*inputs: Column) -> Column:
    """SHA-256 of the inputs together, as lowercase hexadecimal text."""
    return F.sha2(F.concat(*inputs) if len(inputs) > 1 else inputs[0], 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it; null has a mark of its own."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def text_key(value: Column) -> Column:
    """Hexadecimal digits in the bytewise order of texts; null comes first."""
    return F.when(value.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), F.hex(value.cast("binary"))))


def number_key(value: Column) -> Column:
    """Hexadecimal digits in the order of 64-bit integers; null comes first."""
    shifted = F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    return F.when(value.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), F.lpad(shifted, 16, "0")))


def _prefix(key: str, digits: int) -> Column:
    return F.substring(key, 1, DIGIT * digits)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df for a broadcast, if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, scratch: Scratch, name: str, group: str, key: str, repeats: str | None = None, cell: int = CELL) -> DataFrame:
    """rows with rank: their place from 0 in their group by key, and with size, the rows of the group.

    No two rows of a group have equal keys. repeats: a column with the number of places that a row
    takes; its rank is the first of them. group is not null.
    """
    takes = F.lit(1).cast("long") if repeats is None else F.col(repeats)
    ends = rows.agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n")).first()
    if not ends["n"]:
        none = F.lit(None).cast("long")
        return rows.withColumns({"rank": none, "size": none})
    # Digits that all keys share tell nothing, so counting starts below them, at the digit where even keys would fill a cell.
    common = next((i for i, (a, b) in enumerate(zip(ends["least"], ends["most"], strict=False)) if a != b), min(len(ends["least"]), len(ends["most"])))
    top = common // DIGIT
    level = top
    while ends["n"] > cell * 256 ** (level - top):
        level += 1
    first_level = level

    def counted(of: DataFrame, digits: int) -> DataFrame:
        return of.groupBy(group, _prefix(key, digits).alias("prefix")).agg(F.sum(takes).alias("count"), F.count("*").alias("rows"))

    # Downward: crowded cells are counted by one digit more.
    histograms = {level: scratch.table(counted(rows, level), f"{name}_cells_{level}")}
    left = rows
    while crowded := histograms[level].where(F.col("rows") > cell).count():
        over = histograms[level].where(F.col("rows") > cell).select(group, "prefix")
        left = left.withColumn("prefix", _prefix(key, level)).join(_bounded(over, crowded), [group, "prefix"], "left_semi").drop("prefix")
        level += 1
        histograms[level] = scratch.table(counted(left, level), f"{name}_cells_{level}")
    # Upward: the first histogram folds to that of the digits that all keys share.
    for up in range(first_level - 1, top - 1, -1):
        folded = histograms[up + 1].groupBy(group, F.substring("prefix", 1, DIGIT * up).alias("prefix")).agg(F.sum("count").alias("count"), F.sum("rows").alias("rows"))
        histograms[up] = scratch.table(folded, f"{name}_cells_{up}")
    # Downward again: first ranks, at most 256 cells to a cell above.
    firsts = histograms[top].select(group, "prefix", F.lit(0).cast("long").alias("first"), F.col("count").alias("size"))
    cells = []
    for at in range(top, level + 1):
        if at > top:
            above = scratch.table(firsts.drop("rows"), f"{name}_firsts_{at - 1}").withColumnsRenamed({"prefix": "above", "first": "base"})
            before = Window.partitionBy(group, "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
            own = histograms[at].withColumn("above", F.substring("prefix", 1, DIGIT * (at - 1)))
            own = own.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
            firsts = own.join(above, [group, "above"]).select(group, "prefix", (F.col("base") + F.col("before")).alias("first"), "size", "rows")
        else:
            firsts = firsts.join(histograms[top].select(group, "prefix", "rows"), [group, "prefix"])
        if at >= first_level:
            cells.append(firsts.where(F.col("rows") <= cell).select(group, "prefix", F.lit(at).alias("digits"), "first", "size"))
    found = cells[0]
    for more in cells[1:]:
        found = found.unionByName(more)
    found = scratch.table(found, f"{name}_cells")
    n_cells = found.count()
    parts = []
    for at in range(first_level, level + 1):
        here = found.where(F.col("digits") == at).select(group, "prefix", "first", "size")
        parts.append(rows.withColumn("prefix", _prefix(key, at)).join(_bounded(here, n_cells), [group, "prefix"]).withColumn("digits", F.lit(at)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    before = Window.partitionBy(group, "digits", "prefix").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("rank", F.col("first") + F.coalesce(F.sum(takes).over(before), F.lit(0))).drop("prefix", "digits", "first")


def _levels(size: int, fanout: int) -> int:
    """Levels of digests over so many leaves; a lone leaf has none."""
    n = 0
    while size > 1:
        size, n = -(-size // fanout), n + 1
    return n


def _over(size: Column, fanout: int, level: int) -> Column:
    """Nodes of a level over so many leaves."""
    return F.ceil(size / F.lit(fanout**level)).cast("long")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Runs of nodes (group, size, place, digest) that share all digits but the last: kids and their digest."""
    at = F.floor(F.col("place") / fanout).cast("long")
    runs = nodes.groupBy("group", "size", at.alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("kids"))
    return runs.withColumn("digest", digest(F.array_join("kids", "")))


def _beside(kids: Column, i: Column) -> Column:
    """The siblings before and after the i-th (from 0) of a run's digests."""
    return F.struct(F.array_join(F.slice(kids, F.lit(1), i), "").alias("left"), F.array_join(F.slice(kids, i + 2, F.size(kids)), "").alias("right"))


_PATH = "array<struct<left:string,right:string>>"


def _climb(nodes: DataFrame, scratch: Scratch, name: str, top: int, fanout: int, start: int = 0) -> tuple[dict[int, DataFrame], DataFrame]:
    """Runs by the level of their digest, and each group's one node (group, level, digest).

    nodes: group, size (leaves of the group), place, digest of level start.
    """
    runs, tops = {}, []
    for level in range(start, top + 1):
        alone = _over(F.col("size"), fanout, level) == 1
        tops.append(nodes.where(alone).select("group", F.lit(level).alias("level"), "digest"))
        if level < top:
            runs[level + 1] = scratch.table(_runs(nodes.where(~alone), fanout), f"{name}_runs_{level + 1}")
            nodes = runs[level + 1].select("group", "size", F.col("up").alias("place"), "digest")
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return runs, out


def _descend(runs: dict[int, DataFrame], tops: DataFrame, scratch: Scratch, name: str, down_to: int, also: list[str]) -> DataFrame:
    """Paths (siblings from a node up to the root) of the nodes of level down_to: group, place, path.

    tops: group, level and path of each group's one node, and the columns of also.
    """
    paths = None
    for level in range(max([*runs, down_to]), down_to - 1, -1):
        own = tops.where(F.col("level") == level).select("group", F.lit(0).cast("long").alias("place"), "path", *also)
        if level + 1 in runs:
            spread = runs[level + 1].join(paths.withColumnRenamed("place", "up"), ["group", "up"]).select("group", "up", "kids", "path", *also, F.posexplode("kids").alias("i", "kid"))
            step = _beside(F.col("kids"), F.col("i"))
            own = own.unionByName(spread.select("group", (F.col("up") * FANOUT + F.col("i")).alias("place"), F.concat(F.array(step), F.col("path")).alias("path"), *also))
        paths = scratch.table(own, f"{name}_paths_{level}") if level > down_to else own
    return paths


def manifest(rows: DataFrame, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, path, proof (of all siblings), and found, the other leaf.

    rows: doc_id, group (text or null), leaf, found (the digest of what is to be proved; null: the leaf
    itself). Only the largest number of leaves of a group, the number of groups and the root come to
    the driver.
    """
    own = rows.select("doc_id", text_key(F.col("group")).alias("group"), "leaf", "found")
    # Full repeats are counted before they meet, so a row that makes a third of all is one row here.
    own = own.groupBy("doc_id", "group", "leaf", "found").agg(F.count("*").alias("repeats"))
    own = scratch.table(own.withColumn("key", F.concat(number_key(F.col("doc_id")), F.upper("leaf"), F.coalesce(F.upper("found"), F.lit("")))), "leaves")
    placed = ranked(own, scratch, "leaf", "group", "key", "repeats", cell)
    # A row that repeats takes a run of places; the runs are cut so that no array is long.
    placed = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1, F.lit(RUN).cast("long"))))
    placed = placed.withColumn("more", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("repeats")) - 1)))
    placed = placed.select("group", "size", (F.col("rank") + F.col("more")).alias("place"), "doc_id", "leaf", "found")

    # The lowest runs keep their leaves' rows, so that proofs need no further join.
    alone = F.col("size") == 1
    item = F.struct("place", "doc_id", "leaf", "found")
    low = placed.groupBy("group", "size", F.floor(F.col("place") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(item)).alias("docs"))
    low = scratch.table(low.withColumn("kids", F.transform("docs", lambda x: x["leaf"])).withColumn("digest", F.when(alone, F.col("kids")[0]).otherwise(digest(F.array_join("kids", "")))), "low")
    most = low.agg(F.max("size")).first()[0]
    if most is None:
        none = F.lit(None).cast("string")
        return low.select(F.explode("docs").alias("d")).select("d.doc_id", "d.leaf", none.alias("subroot"), none.alias("root"), F.lit(None).cast(_PATH).alias("path"), "d.found")

    # A group of one leaf has that leaf as its node, and counts as one run with it here.
    nodes = low.select("group", F.col("size"), F.col("up").alias("place"), "digest")
    runs, tops = _climb(nodes, scratch, "group", max(1, _levels(most, FANOUT)), FANOUT, start=1)
    tops = scratch.table(tops.withColumnRenamed("digest", "subroot"), "subroots")

    # The second trie, over the groups in their order.
    order = ranked(tops.select("group", "subroot", F.lit("").alias("all")), scratch, "group_order", "all", "group", None, cell)
    order = scratch.table(order.select(F.col("group").alias("of"), F.lit("").alias("group"), "size", F.col("rank").alias("place"), F.col("subroot").alias("digest")), "order")
    upper, last = _climb(order.drop("of"), scratch, "root", _levels(order.count(), FANOUT), FANOUT)
    root = last.first()["digest"]
    apex = last.select("group", "level", F.array().cast(_PATH).alias("path"))
    paths = _descend(upper, apex, scratch, "root", 0, []).join(order.select("place", "of"), "place").select(F.col("of").alias("group"), "path")
    tops = scratch.table(tops.join(paths, "group"), "subroot_paths")

    down = _descend(runs, tops, scratch, "group", 1, ["subroot"]).withColumnRenamed("place", "up")
    rows = low.join(down, ["group", "up"]).select("kids", "subroot", "path", (F.col("size") == 1).alias("alone"), F.posexplode("docs").alias("i", "d"))
    step = F.array(_beside(F.col("kids"), F.col("i")))
    path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(step, F.col("path")))
    return rows.select("d.doc_id", "d.leaf", "subroot", F.lit(root).alias("root"), path.alias("path"), "d.found")


def fold(path: Column, start: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def verify(docs: DataFrame, scratch: Scratch, tampered: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """Each row's leaf, its subroot and root, the digest of its proof, and the root that its proof leads to.

    tampered: a text in place of the row's own for what is proved; the manifest is of the untampered
    rows. verified: the proof leads to the root.
    """
    values = [F.col(c) for c in columns]
    other = leaf([tampered if c == text else F.col(c) for c in columns])
    found = F.when(~tampered.eqNullSafe(F.col(text)), other)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(group).alias("group"), leaf(values).alias("leaf"), found.alias("found"))
    made = manifest(rows, scratch, cell)
    folded = fold(F.col("path"), F.coalesce("found", "leaf"))
    return made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z in lower case where TAMPER divides the checksum of the decimal id; nulls stay."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(crc % TAMPER == 0, F.translate(F.col(text), upper, upper.lower())).otherwise(F.col(text))
