"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A byte-pair segmentation is the one path of pieces in which every two neighbours are *fit*:
their joined text, segmented alone, gives the same two pieces. (No merge crosses the border of
two final pieces, so what happens within a pair doesn't depend on the rest; and if all pairs
are fit, the first merge across a border would also happen within that pair alone.) As path
weights, a fit pair counts 0 and any other minus infinity, so the segmentation is the best path
of a max-plus product.

A giant document is cut into chunks at fixed places, without regard to words. A boundary's
states are the pieces that hold the last character before it: how far each reaches back and
ahead. A chunk gives the transfer matrix from the states of its first boundary to those of its
last. Matrices multiply associatively, here in blocks of BLOCK chunks and then over a
document's blocks; products from the front and from the back leave one state at every boundary.
Each chunk is then segmented alone between its two states.

The matrix is cheap because pieces cannot cross two characters that no piece has side by side:
all that matters is the text from the boundary to the first such place.

Models are byte-pair models whose normaliser leaves characters as they are, with a space before
the text and spaces marked; others are refused, since chunks couldn't be normalised alone.

Cases: a null text counts as empty and has no ids; null ids and repeated rows pass through; an
empty table gives an empty table; other columns are ignored. A text with the piece marker
U+2581 decodes with spaces in its place, as with the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Longer documents, in characters, are cut into chunks of CHUNK.
GIANT, CHUNK = 32_768, 16_384
#: Chunks whose matrices one task multiplies.
BLOCK = 128
#: Answers about pairs and pieces that a worker remembers.
REMEMBERED = 1 << 17
SPACE = "▁"
NEVER = float("-inf")


class Model:
    """The pieces of a byte-pair model file, and segmentation of normalised text."""

    _made: dict[str, Model] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces) or spec.trainer_spec.model_type != spec.trainer_spec.BPE:
            raise ValueError("giant texts need a byte-pair model that leaves characters as they are and marks spaces")
        spec.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        n = self.library.get_piece_size()
        normal = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in normal}
        self.longest = max(map(len, self.score))
        self.neighbours = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.fit = lru_cache(REMEMBERED)(self._fit)
        self.final = lru_cache(REMEMBERED)(lambda piece: self._merge(piece) == [piece])

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _merge(self, text: str) -> list[str]:
        """Segmentation of a short text: best-scored merge first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[p], i) for i, p in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if p in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fit(self, left: str, right: str) -> bool:
        return left[-1] + right[0] not in self.neighbours or self._merge(left + right) == [left, right]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(back, ahead) of each piece that holds the character before at. At the end, ahead is 0."""
        out = []
        for back in range(1, min(self.longest, at) + 1):
            for ahead in range(min(self.longest - back, len(text) - at) + 1):
                piece = text[at - back : at + ahead]
                if (back, ahead) == (1, 0) or piece in self.score and self.final(piece):
                    out.append((back, ahead))
        return out

    def _ends(self, text: str) -> tuple[str, str] | None:
        """First and last piece of a segment, a character for bytes; None for no text."""
        if len(text) <= 4 * self.longest:
            parts = self._merge(text)
        else:
            parts = self.inner.encode(text, out_type=str)
            parts = [text[0] if parts[0] not in self.score else parts[0], text[-1] if parts[-1] not in self.score else parts[-1]]
        return (parts[0], parts[-1]) if parts else None

    def matrix(self, text: str, a: int, b: int, entry: list[tuple[int, int]], leave: list[tuple[int, int]]) -> np.ndarray:
        """Weights from the states at a to those at b; at the start of a text entry is [(0, 0)]."""
        out = np.full((len(entry), len(leave)), NEVER)
        first = next((p for p in range(a, b) if p and text[p - 1 : p + 1] not in self.neighbours), None)
        last = next((p for p in range(b - 1, a - 1, -1) if p and text[p - 1 : p + 1] not in self.neighbours), None)
        if first is not None:
            ok_in = np.array([self._joins(text, a, back, ahead, first) for back, ahead in entry])
            ok_out = np.array([b - back >= last and self._leads(text, last, b, back, ahead) for back, ahead in leave])
            out[np.ix_(ok_in, ok_out)] = 0.0
            return out
        ends: dict[tuple[int, int], tuple[str, str] | None] = {}
        for i, (back, ahead) in enumerate(entry):
            for j, (back_b, ahead_b) in enumerate(leave):
                key = (a + ahead, b - back_b)
                if b - back_b < a:  # a piece that reaches over the whole of a short last chunk
                    if (a - back, a + ahead) == (b - back_b, b + ahead_b):
                        out[i, j] = 0.0
                    continue
                if key[0] > key[1]:
                    continue
                if key not in ends:
                    ends[key] = self._ends(text[key[0] : key[1]])
                own, then = text[a - back : a + ahead], text[b - back_b : b + ahead_b]
                inner = ends[key]
                ok = (not own or self.fit(own, then)) if inner is None else (not own or self.fit(own, inner[0])) and self.fit(inner[1], then)
                if ok:
                    out[i, j] = 0.0
        return out

    def _joins(self, text: str, a: int, back: int, ahead: int, first: int) -> bool:
        if a + ahead > first:
            return False
        ends, own = self._ends(text[a + ahead : first]), text[a - back : a + ahead]
        return ends is None or not own or self.fit(own, ends[0])

    def _leads(self, text: str, last: int, b: int, back: int, ahead: int) -> bool:
        ends = self._ends(text[last : b - back])
        return ends is None or self.fit(ends[1], text[b - back : b + ahead])


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def _ids(rows: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)))


_WHOLE = "row long, doc_id long, n_chars long, text_crc32 long, ids array<int>, chunks array<struct<chunk:int,text:string,back:int>>"


def _first_pass(path: str):
    """Encodes short documents; cuts long ones into chunks with a margin on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = Model.of(path), TaskContext.get().partitionId() << 40
        margin = model.longest
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = model.library.encode([t if len(t) <= GIANT else "" for t in texts], num_threads=1)
            chunks = []
            for text in texts:
                own = []
                if len(text) > GIANT:
                    whole = model.normal(text)
                    for k, a in enumerate(range(0, len(whole), CHUNK)):
                        back = min(a, margin)
                        own.append({"chunk": k, "text": whole[a - back : a + CHUNK + margin], "back": back})
                chunks.append(own)
            n = len(texts)
            columns = [
                pa.array(np.arange(row, row + n)),
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                _ids([np.array(x, np.int32) for x in short]),
                pa.array(chunks, pa.list_(pa.struct([("chunk", pa.int32()), ("text", pa.string()), ("back", pa.int32())]))),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_chars", "text_crc32", "ids", "chunks"])

    return run


def _matrices(path: str):
    """Adds each chunk's states at its two boundaries and its transfer matrix, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            entries, leaves, matrices = [], [], []
            for text, back in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = back, min(back + CHUNK, len(text))
                entry = model.states(text, a) if a else [(0, 0)]
                leave = [s for s in model.states(text, b) if b < len(text) or s[1] == 0]
                entries.append([x for s in entry for x in s])
                leaves.append([x for s in leave for x in s])
                matrices.append(model.matrix(text, a, b, entry, leave).ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(entries, pa.list_(pa.int32())), pa.array(leaves, pa.list_(pa.int32())), pa.array(matrices, pa.list_(pa.float64()))],
                names=["row", "chunk", "entry", "leave", "matrix"],
            )

    return run


def _table(r) -> np.ndarray:
    return np.array(r.matrix, np.float64).reshape(len(r.entry) // 2, len(r.leave) // 2)


def _multiply(group: pd.DataFrame) -> pd.DataFrame:
    """The product of a block's matrices."""
    rows = list(group.sort_values("chunk").itertuples())
    total = _table(rows[0])
    for r in rows[1:]:
        total = product(total, _table(r))
    return pd.DataFrame({"row": [rows[0].row], "block": [rows[0].block], "entry": [list(rows[0].entry)], "leave": [list(rows[-1].leave)], "matrix": [total.ravel().tolist()]})


def _scan(rows: list, front: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors before each of the rows, from the front, and after each, from the end."""
    before, after = [front], [end]
    for r in rows[:-1]:
        before.append(product(before[-1], _table(r)))
    for r in rows[:0:-1]:
        after.append(product(_table(r), after[-1]))
    return before, after[::-1]


def _over_blocks(group: pd.DataFrame) -> pd.DataFrame:
    rows = list(group.sort_values("block").itertuples())
    before, after = _scan(rows, np.zeros((1, len(rows[0].entry) // 2)), np.zeros((len(rows[-1].leave) // 2, 1)))
    return pd.DataFrame({"row": [r.row for r in rows], "block": [r.block for r in rows], "front": [b.ravel().tolist() for b in before], "end": [a.ravel().tolist() for a in after]})


def _over_chunks(group: pd.DataFrame) -> pd.DataFrame:
    """How far the pieces at a chunk's two boundaries reach beyond them."""
    rows = list(group.sort_values("chunk").itertuples())
    before, after = _scan(rows, np.array([rows[0].front]), np.array([rows[0].end]).T)
    out = []
    for r, x, y in zip(rows, before, after, strict=True):
        m = _table(r)
        at_entry = int(np.argmax(x.ravel() + product(m, y).ravel()))
        at_leave = int(np.argmax(product(x, m).ravel() + y.ravel()))
        out.append((r.row, r.chunk, int(r.entry[2 * at_entry + 1]), int(r.leave[2 * at_leave + 1])))
    return pd.DataFrame(out, columns=["row", "chunk", "skip", "reach"])


def _second_pass(path: str):
    """Segments each chunk between its states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            parts = []
            for text, back, skip, reach in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                parts.append(text[back + skip : min(back + CHUNK, len(text)) + reach])
            ids = model.inner.encode(parts, num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _ids([np.array(x, np.int32) for x in ids])], names=["row", "chunk", "ids"])

    return run


def encode(docs: DataFrame, scratch: Scratch, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, text_crc32 and ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = scratch.table(rows.mapInArrow(_first_pass(path), _WHOLE), "whole")
    chunks = whole.select("row", F.explode("chunks").alias("c")).select("row", "c.chunk", "c.text", "c.back")
    matrices = chunks.mapInArrow(_matrices(path), "row long, chunk int, entry array<int>, leave array<int>, matrix array<double>")
    matrices = scratch.table(matrices.withColumn("block", F.floor(F.col("chunk") / BLOCK)), "matrices")
    blocks = matrices.groupBy("row", "block").applyInPandas(_multiply, "row long, block long, entry array<int>, leave array<int>, matrix array<double>")
    ends = blocks.groupBy("row").applyInPandas(_over_blocks, "row long, block long, front array<double>, end array<double>")
    states = matrices.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(_over_chunks, "row long, chunk int, skip int, reach int")
    parts = chunks.join(states, ["row", "chunk"]).select("row", "chunk", "text", "back", "skip", "reach")
    parts = parts.mapInArrow(_second_pass(path), "row long, chunk int, ids array<int>")
    # The ids of one document are one value of the result, so they meet here.
    joined = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("joined"))
    columns = ["doc_id", "n_chars", "text_crc32"]
    giant = F.size("chunks") > 0
    long = whole.where(giant).select("row", *columns).join(joined, "row").select(*columns, F.col("joined").alias("ids"))
    return whole.where(~giant).select(*columns, "ids").unionByName(long)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with ids replaced by text, the checksum ids_crc32 and their number n_tokens."""
    others = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            lists = batch.column(len(others))
            at = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            own = [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            texts = model.library.decode([x.tolist() for x in own], num_threads=1) if own else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())],
                names=[*others, "text", "n_tokens", "ids_crc32"],
            )

    kinds = dict(encoded.dtypes)
    return encoded.select(*others, ids).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["text string", "n_tokens long", "ids_crc32 long"]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
