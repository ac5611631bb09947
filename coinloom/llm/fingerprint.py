"""Threshold-scaled sketch: every shingle hash below a fixed fraction of the range is kept.

A document's sketch holds the hashes, of its distinct shingles of SHINGLE words, that fall
below 1 / SCALE of the 64-bit range, and no others. The sketch of several documents together is
the union of theirs, and since the same hashes are kept everywhere, shares of kept hashes
estimate shares of shingles, however unequal the documents are.

Beside the kept hashes a sketch carries the least hash of all, which merges too. It stands in
where both sides keep nothing, as short texts may: two such texts are alike by 1 if their least
hashes are equal, an estimate that is right on average. With k hashes kept on either side, an
estimate s is off by about the root of s (1 - s) / k; texts of 20 words keep two or so.

Only DataFrame functions are used. Cases: a null text counts as empty; a text with fewer than
SHINGLE words is one shingle; no words give no hashes; two texts without words are alike by 1, one without and another by 0; null ids come first
in the order of documents; rows of equal id are ordered by text; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_parts

SHINGLE = 5
#: One hash of SCALE is kept.
SCALE = 8
#: Ids in order are dealt into so many ranges a shuffle partition.
RANGES = 4


def sketch(text: Column, words: int = SHINGLE, scale: int = SCALE) -> Column:
    """struct of kept, the ascending distinct kept hashes of a text, and least, its smallest hash or null."""
    # A-Z are lower-cased alone, and words are runs of other than space and \\x09-\\x0D.
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.filter(F.split(lower, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "")
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: _kept(h, words, scale))[0]


def _kept(h: Column, words: int, scale: int) -> Column:
    """h is bound by a one-element transform, so the words are split and hashed once."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1)))
    shingles = F.when(F.size(h) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, words)))).otherwise(F.array().cast("array<bigint>"))
    # The bias makes unsigned order the signed one; a hash below the threshold is kept.
    below = -(2**63) + (2**64 // scale)
    return F.transform(F.array(shingles), lambda s: F.struct(F.array_sort(F.array_distinct(F.filter(s, lambda x: x < below))).alias("kept"), F.array_min(s).alias("least")))[0]


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of shingles in both, of those in either."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b; null where a keeps no hash and nothing can be told."""
    own = F.size(a["kept"])
    empty = F.when(a["least"].isNull() | a["least"].eqNullSafe(b["least"]), F.lit(1.0))
    return F.when(own == 0, empty).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / own)


def merge(sketches: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """The sketch of all documents of each group together: one row a group.

    Hashes are made distinct before they meet, so repeats cost nothing; a group's sketch is one
    value of the result.
    """
    least = sketches.groupBy(by).agg(F.min(F.col(column)["least"]).alias("_least"))
    hashes = sketches.select(*by, F.explode(F.col(column)["kept"]).alias("_hash")).distinct()
    kept = hashes.groupBy(by).agg(F.array_sort(F.collect_list("_hash")).alias("_kept"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    out = least.alias("l").join(kept.alias("k"), same, "left")
    return out.select(*(F.col(f"l.{c}") for c in by), F.struct(F.coalesce("k._kept", F.array().cast("array<bigint>")).alias("kept"), F.col("l._least").alias("least")).alias(column))


def as_text(a: Column) -> Column:
    """Kept hashes in ascending order, 16 hexadecimal digits each; with none, ~ and the least one."""
    digits = F.array_join(F.transform(a["kept"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    none = F.coalesce(F.concat(F.lit("~"), F.lpad(F.lower(F.hex(a["least"])), 16, "0")), F.lit(""))
    return F.when(F.size(a["kept"]) == 0, none).otherwise(digits)


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text and sketch, and those of the next document in ascending id order.

    After the last document comes the first.

    Ids are dealt into ranges, and the rows of a range's first id also go, as guests, to the
    range before. So one shuffle brings each document and its successor together, and no
    task holds more than a range.
    """
    low = F.lit(-(2**63))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), low))
    n = RANGES * shuffle_parts(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    of = _range_of(F.col("key"), cuts)
    firsts = [(r["of"], r["first"]) for r in rows.groupBy(of.alias("of")).agg(F.min("key").alias("first")).collect()]
    order = sorted(firsts)  # at most RANGES times the shuffle partitions
    if not order:
        order = [(0, 0)]
    places = {first: i for i, (_, first) in enumerate(order)}
    last = len(order) - 1
    starts = [first for _, first in order]
    own = _range_of(F.col("key"), starts[1:]) if len(starts) > 1 else F.lit(0)
    is_first = F.element_at(F.array(*map(F.lit, starts)), own + 1) == F.col("key")
    guest = F.when(own == 0, F.lit(last)).otherwise(own - 1)
    to = F.when(is_first & (F.lit(len(places)) > 1), F.array(F.struct(own.alias("at"), F.lit(0).alias("guest")), F.struct(guest.alias("at"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(own.alias("at"), F.lit(0).alias("guest"))))
    dealt = rows.withColumn("sketch", sketch(F.col("text"))).withColumn("to", F.explode(to)).select("doc_id", "text", "sketch", "key", "to.at", "to.guest")
    # In the last range the guests are the first documents of all, and come at the end.
    wrap = (F.col("guest") == 1) & (F.col("at") == last)
    order_by = Window.partitionBy("at").orderBy(wrap, "key", "text")
    both = F.struct("text", "sketch")
    following = F.lead(both).over(order_by)
    if last == 0:  # a single range: its first row follows its last
        following = F.coalesce(following, F.first(both).over(order_by))
    dealt = dealt.withColumn("next", following).where("guest = 0")
    return dealt.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below key, by two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*(F.lit(r[0]) for r in runs))
    run = F.size(F.filter(heads, lambda c: c <= key))
    inside = F.array(*(F.array(*map(F.lit, r)) for r in runs))
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * step + F.size(F.filter(F.element_at(inside, F.greatest(run, F.lit(1))), lambda c: c <= key)))


def compare_with_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Sketches of each text and of its edited text, whose second half comes from the next one.

    near_edited and near_next are the resemblance of a document's sketch to the edited text's
    and to the next document's; in_edited and edited_in are the shares of the document that the
    edited text contains, and of the edited text that the document contains. The sketch travels
    with the text, so each is made once.
    """
    rows = with_next(docs, text, doc_id)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in"),
    )
