"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Documents may be long, so batches hold few of them.
ARROW_ROWS = 512
#: Bytes of an Arrow batch, about: a batch is sent when either bound is met.
ARROW_BYTES = 32 << 20
#: Bytes of text that the vectorised word splitter handles at a time.
BLOCK_BYTES = 1 << 19
#: Tables of ids and numbers are broadcast up to this number of rows (about 16 MB); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000


def tune(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches for tables with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Written tables in the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts lineage and survives the loss of an executor. Where the
    session names no folder, a local session (as in tests) sets a temporary one; a
    cluster must name a folder that all its machines share.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = f"file://{tempfile.mkdtemp(prefix='coinloom-')}"
            spark.sparkContext.setCheckpointDir(base)
        self.root = f"{base}/coinloom-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet under this name and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete written tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Returns memory that Arrow keeps for reuse; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()


def spare(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id's text leaves this remainder; a null id counts as 0."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.pmod(crc, F.lit(folds)) == fold


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: A random 64-bit value for each byte, after A-Z are lower-cased.
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
#: Longer words, in bytes, are hashed one by one: modulo 2**64 any polynomial takes some long words for each other.
POLYNOMIAL_BYTES = 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and each text's n + 1 word offsets.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. The
    hash is a polynomial in random byte values, taken from prefix sums for all words at once;
    words longer than POLYNOMIAL_BYTES get a cryptographic digest in its place.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    first = np.flatnonzero(~space & before)
    last = np.flatnonzero(~space & after) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    words = mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first > POLYNOMIAL_BYTES).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(_LOWER[raw[first[i] : last[i]]], digest_size=8).digest(), "little")
    return words, np.searchsorted(first, at)


def text_blocks(column: pa.Array):
    """Yield (first row, bytes, offsets) of runs of texts of about BLOCK_BYTES together."""
    raw, at = text_bytes(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = int(np.searchsorted(at, at[row] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def shingle_sets(column: pa.Array, words: int):
    """Yield, text by text, the sorted distinct 64-bit hashes of its word shingles.

    Fewer words than a shingle has: the whole sequence is one shingle. No words: empty.
    """
    for _, raw, at in text_blocks(column):
        hashes, of = word_hashes(raw, at)
        if len(hashes) >= words:
            grams = np.zeros(len(hashes) - words + 1, np.uint64)
            for k in range(words):
                grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)])
        for i in range(len(at) - 1):
            a, b = int(of[i]), int(of[i + 1])
            if b - a >= words:
                own = np.sort(grams[a : b - words + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + h)
                yield mix64(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
