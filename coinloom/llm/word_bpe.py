"""Byte-pair encoding with word ends, by forced boundaries, and decoding.

A merge makes a token of the vocabulary, so two bytes that stand side by side inside no token are
never merged across: between them is a *certain* cut. White space is in no token at all; letters,
digits and marks have few tokens in common; and rare pairs of letters cut words further. A text falls
into fragments between certain cuts and the ends of its words; each is encoded by itself, as its
merges don't depend on what lies beyond a cut, and the ids are put one behind the other. Only the
last fragment of a word takes the mark of a word's end.

Documents longer than GIANT characters are cut into chunks at white space, and pieces without any that
are longer than a chunk at their certain cuts, so that the chunks of one document are encoded by many
tasks. What has no certain cut, such as one letter repeated a million times, is one fragment and one
task's work. The ids of a document are one value, so they meet in one row.

Cases: a null text counts as empty and has no ids; null ids and repeated rows pass through; an empty
table gives an empty table; other columns are ignored. The strings of added tokens in a text become
those tokens, as with the library's default call.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Longer documents, in characters, are cut into chunks of about CHUNK.
GIANT, CHUNK = 131_072, 32_768
#: Pieces, and fragments, that a worker remembers with their ids (about 25 MB each); longer ones than REMEMBERED_CHARS are not.
REMEMBERED, REMEMBERED_CHARS = 120_000, 24
#: Runs between the kinds of white space that every part of the tokenizer drops.
_PIECE = re.compile("[^ \t\n\r\x0b\x0c]+")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]")
#: In a chunk of fragments: the end of a word, a certain cut inside one. No byte letter is one of these.
_WORD_END, _CUT = "\n", "\t"
#: The words of a lower-case text of visible ASCII characters, as the tokenizer's pattern takes them.
_ASCII_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ASCII = re.compile("[!-~]+")
END_MARK = "</w>"


class Codec:
    """Encodes by fragments, with the library's model for each fragment. One per worker process and file.

    Refused are tokenizers whose words are not byte letters with an end mark.
    """

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.model = library.model
        if not isinstance(self.model, models.BPE) or self.model.end_of_word_suffix != END_MARK or self.model.continuing_subword_prefix or library.decoder is not None:
            raise ValueError("a byte-pair model with word ends and no decoder is needed")
        self.library = library
        self.normal = library.normalizer.normalize_str
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        bare = [t.removesuffix(END_MARK) for t in library.get_vocab(with_added_tokens=False)]
        #: Pairs of byte letters that some token holds side by side; any other pair is a certain cut.
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self._inner: models.BPE | None = None
        self._path = path
        self.pieces: dict[str, bytes] = {}
        self.fragments: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @property
    def inner(self):
        """The model without the mark of a word's end, for fragments that another follows."""
        if self._inner is None:
            import json

            from tokenizers import models

            with open(self._path, encoding="utf-8") as f:
                spec = json.load(f)["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
            self._inner = models.BPE(vocab=spec["vocab"], merges=merges)
        return self._inner

    def cut(self, word: str) -> list[str]:
        """The fragments of a word in byte letters."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def words_of(self, text: str) -> list[str]:
        """The words of a text without added tokens, in byte letters."""
        if _ASCII.fullmatch(text):
            return _ASCII_WORD.findall(text.lower())
        return [w for w, _ in self.words(self.normal(text))]

    def portions(self, piece: str) -> list[tuple[str, bool]]:
        """A piece cut at the added tokens it holds; True with these."""
        if self.added_at is None or "<" not in piece and not self.added_at.search(piece):
            return [(piece, False)]
        return [(p, k % 2 == 1) for k, p in enumerate(self.added_at.split(piece)) if p]

    def fragment(self, letters: str, ends: bool) -> bytes:
        """Ids of one fragment; ends: it is the last of its word."""
        key = letters + _WORD_END if ends else letters
        got = self.fragments.get(key)
        if got is None:
            ids = [t.id for t in (self.model if ends else self.inner).tokenize(letters)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(letters) <= REMEMBERED_CHARS and len(self.fragments) < REMEMBERED:
                self.fragments[key] = got
        return got

    def word(self, word: str) -> bytes:
        got = self.fragments.get(word + _WORD_END)  # a fragment has no cut in it, so this is a word without one
        if got is not None:
            return got
        parts = self.cut(word)
        if len(parts) == 1:
            return self.fragment(word, True)
        return b"".join([self.fragment(p, False) for p in parts[:-1]]) + self.fragment(parts[-1], True)

    def piece(self, piece: str) -> bytes:
        """Ids of a piece without ASCII white space."""
        out = []
        for part, added in self.portions(piece):
            if added:
                out.append(struct.pack("<I", self.added[part]))
            else:
                out += map(self.word, self.words_of(part))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; null counts as empty."""
        if not text:
            return b""
        own = _PIECE.findall(text)
        ids = list(map(self.pieces.get, own))
        if None in ids:
            fresh: dict[str, bytes] = {}
            for i, p in enumerate(own):
                if ids[i] is None:
                    if p not in fresh:
                        fresh[p] = self.piece(p)
                        if len(p) <= REMEMBERED_CHARS and len(self.pieces) < REMEMBERED:
                            self.pieces[p] = fresh[p]
                    ids[i] = fresh[p]
        return b"".join(ids)

    def encode_fragments(self, chunk: str) -> bytes:
        """Ids of a chunk of fragments, as chunks() writes them."""
        out = []
        for part in re.findall(f"[^{_WORD_END}{_CUT}]+[{_WORD_END}{_CUT}]", chunk):
            if part[:-1] in self.added:
                out.append(struct.pack("<I", self.added[part[:-1]]))
            else:
                out.append(self.fragment(part[:-1], part[-1] == _WORD_END))
        return b"".join(out)

    def chunks(self, text: str, size: int = CHUNK) -> Iterator[tuple[str, bool]]:
        """A text in order, in chunks of about size characters; True with a chunk of fragments.

        A chunk ends at white space. A run without white space of more than size characters is cut
        at its certain cuts instead.
        """
        start, n = 0, len(text)
        while start < n:
            if n - start <= size:
                yield text[start:], False
                return
            end = max(text.rfind(c, start + 1, start + size) for c in " \t\n\r\x0b\x0c")
            if end > 0:
                yield text[start:end], False
                start = end
                continue
            found = _SPACE.search(text, start + size)
            end = found.start() if found else n
            first = _PIECE.search(text, start, end)
            if first:
                yield from self._fragments(first.group(), size)
            start = end

    def _fragments(self, piece: str, size: int) -> Iterator[tuple[str, bool]]:
        """A long piece in chunks of fragments. An added token stands as a word; no word is spelt like one, as its marks and letters are two words."""
        held, length = [], 0
        for part, added in self.portions(piece):
            for word in [part] if added else self.words_of(part):
                parts = [word] if added else self.cut(word)
                for k, fragment in enumerate(parts):
                    held.append(fragment + (_WORD_END if k == len(parts) - 1 else _CUT))
                    length += len(held[-1])
                    if length >= size:
                        yield "".join(held), True
                        held, length = [], 0
        if held:
            yield "".join(held), True


class Names:
    """The tokens of a file by id: all that decoding needs, so the library isn't kept."""

    _made: dict[str, Names] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError("a tokenizer without a decoder is needed")
        self.names = [library.id_to_token(i) or "" for i in range(max(library.get_vocab().values()) + 1)]

    @classmethod
    def of(cls, path: str) -> Names:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between each two, as the library's decode without a decoder; unknown ids are left out."""
        names = self.names
        try:
            return " ".join([names[i] for i in ids])
        except IndexError:
            return " ".join([names[i] for i in ids if i < len(names)])


def _lists(ids: list[bytes]) -> pa.Array:
    at = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=["doc_id", "ids"])
        give_back()

    return run


def _cut_giants(path: str, size: int):
    """Chunks of giant documents, each document's with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, row = Codec.of(path), TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "chunk", "text", "cut"]
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = list(codec.chunks(text.as_py(), size))
                n, row = len(own), row + 1
                columns = [pa.array([row] * n, pa.int64()), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([t for t, _ in own], pa.string()), pa.array([c for _, c in own], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [codec.encode_fragments(t) if cut else codec.encode(t) for t, cut in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(ids)], names=["row", "doc_id", "chunk", "ids"])

    return run


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id and ids (array of int).

    Documents of up to giant characters are encoded where they are read; the chunks of longer ones
    are dealt to all tasks and meet again by document.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    is_giant = F.coalesce(F.length("text"), F.lit(0)) > giant
    short = rows.where(~is_giant).mapInArrow(_encode_short(path), "doc_id long, ids array<int>")
    chunks = rows.where(is_giant).mapInArrow(_cut_giants(path, chunk), "row long, doc_id long, chunk int, text string, cut boolean")
    parts = chunks.repartition("row", "chunk").mapInArrow(_encode_chunks(path), "row long, doc_id long, chunk int, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined.select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with ids replaced by text, n_tokens and ids_sha256 (of the ids as little-endian unsigned 32-bit integers).

    Null ids count as none.
    """
    others = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = Names.of(path)
        for batch in batches:
            lists = batch.column(len(others))
            texts, sizes, digests = [], [], []
            for row in lists:
                own = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)
                texts.append(names.decode(own.tolist()))
                sizes.append(len(own))
                digests.append(hashlib.sha256(np.ascontiguousarray(own, dtype="<u4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=[*others, "text", "n_tokens", "ids_sha256"],
            )
        give_back()

    kinds = dict(encoded.dtypes)
    return encoded.select(*others, ids).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["text string", "n_tokens long", "ids_sha256 string"]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
