"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on the id.

Documents are dealt by ranges of their id, sorted, encoded and written in one pass: a file
holds one range, its stripes ascend by id, and each task reads stripes on its own. A lookup by
id reads only the files, stripes and row groups whose statistics and Bloom filters allow it.

Cases: a null text counts as empty, so its document holds the end id alone; null ids come
first; rows of equal id are ordered by text; full repeats are kept; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import tokens
from .common import give_back

#: Pieces that a worker remembers here, where no other stage shares its memory (about 180 MB).
CACHE_PIECES = 1_300_000
#: Options of the ORC writer: stripes of 32 MB, an index entry each 1,000 rows, ids in Bloom filters.
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.compress": "ZSTD",
}
#: part: number of the id range, ascending; row: place of the document in it.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)))])


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text, append the end id, and write the ids in ascending id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = tokens.Encoder.of(tokenizer, CACHE_PIECES), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [tokens.with_end(x) for x in encoder.encode(batch.column(1).to_pylist())]
            n = len(ids)
            at = np.zeros(n + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=at[1:])
            values = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(at), values, type=ARROW.field("ids").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), lists], schema=ARROW)
            row += n
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ranged.mapInArrow(encode, SCHEMA).write.mode("overwrite").options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written documents. Filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy()
        ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = [tokens.crc(memoryview(ids[a:b]).cast("B")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
        )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Number and checksum of each document's ids, from the files."""
    return read(spark, path).mapInArrow(_digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")


def with_starts(digests: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before: of earlier parts, and earlier in the part.

    One row a part, as many as files, is all that meets in one task.
    """
    totals = digests.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(F.broadcast(firsts), "part").select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
