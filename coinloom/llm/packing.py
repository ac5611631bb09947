"""Best-fit packing of documents into sequences, certified by dual feasible functions.

Documents become pieces of at most CAPACITY tokens. Full pieces are sequences by themselves.
The others are dealt into partitions of a bounded size; each is packed best-fit decreasing and
compared with a lower bound on its number of bins. Partitions that stay above their bound, and
the worst-filled bins of the others, give up documents to an exchange, which is dealt into
fewer partitions and packed again, as long as that saves bins.

Cases: a null text counts as empty and holds the end id alone; null ids and repeated rows are
packed like any other row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, give_back

CAPACITY = 1024
#: Pieces of a partition, about. Bounds the memory of a packing task.
GROUP = 4096
#: Bins of a certified partition that are filled less than this share join the exchange.
WELL_FILLED = 0.98
ROUNDS = 6

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's pieces: the first holds the remainder, the others are full.

    row tells pieces apart: number of the input partition and place in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = tokens.Encoder.of(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in _COLUMNS]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(tokens.with_end(ids))
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    for column, value in zip(out, (doc, piece, start, length, tokens.crc(ids[4 * start : 4 * (start + length)]), row), strict=True):
                        column.append(value)
                    start, piece, row = start + length, piece + 1, row + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=_COLUMNS)
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Open bins are kept by room left, with a bit set for each room that has one, so that the
    fullest bin with room enough is the lowest set bit from the item's length on.
    """
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room, bins = bins, capacity, bins + 1
        bin_of[i], offset[i] = b, capacity - room
        room -= length
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bin_of, offset, bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[x] items have length x.

    The largest bound of three families of dual feasible functions: the identity (total
    length), the step functions that set items above capacity - k to full and below k to
    nothing, and the rounding functions floor((k + 1) x / capacity) / k.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((n * x).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        value = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
        best = max(best, -(-int((n * value).sum()) // capacity))
    for k in range(1, 65):
        up = (k + 1) * x
        # scaled by k * capacity, so that all stays in whole numbers
        value = np.where(up % capacity == 0, x * k, up // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


_PACKED = f"{PIECES}, part long, bin long, offset long, fill long, gap long"


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = group["length"].to_numpy()
        bin_of, offset, bins = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bin_of, weights=lengths, minlength=bins).astype(np.int64)
        return group.assign(bin=bin_of, offset=offset, fill=fill[bin_of], gap=bins - bound)

    return pack


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    all_pieces = scratch.table(pieces(docs, tokenizer, capacity), "pieces")
    output = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # Sequences: a full piece has its row's number, a bin a negative one by round, part and place.
    full = all_pieces.where(F.col("length") == capacity)
    placed = [full.withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})]
    waiting = all_pieces.where(F.col("length") < capacity)
    current: DataFrame | None = None  # the rows that wait, with the places they have so far
    for turn in range(ROUNDS):
        left = waiting.count()
        if not left:
            current = None
            break
        parts = -(-left // group)
        dealt = waiting.select(_COLUMNS).withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        packed = scratch.table(dealt.groupBy("part").applyInPandas(_packer(capacity), _PACKED), f"packed{turn}")
        number = -(F.col("bin") + F.lit(1) + F.col("part") * F.lit(1 << 20) + F.lit(turn << 56))
        packed = packed.withColumn("sequence_id", number)
        if current is not None and _bins(packed) >= _bins(current):
            break  # no bin saved: the places of the round before stand
        current = packed
        if parts == 1:
            break
        gives_up = (F.col("fill") < capacity) & ((F.col("gap") > 0) | (F.col("fill") < int(WELL_FILLED * capacity)))
        placed.append(packed.where(~gives_up))
        current = waiting = packed.where(gives_up)
    if current is not None:
        placed.append(current)
    out = placed[0].select(output)
    for more in placed[1:]:
        out = out.unionByName(more.select(output))
    return out


def _bins(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and the lower bound for all pieces together.

    Only the counts by length, at most capacity rows, come to the driver.
    """
    used = packed.select("sequence_id").distinct().count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return used, lower_bound(counts, capacity)
