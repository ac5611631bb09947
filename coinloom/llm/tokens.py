"""Byte-level BPE ids of whole texts, with a bounded cache of words.

The byte-level pattern never lets a token run from a character that is not white space into
the ASCII space after it. Texts are cut there, and the library encodes each distinct piece
once; the ids of a text are the ids of its pieces in order. Texts with rarer white space,
which the pattern groups in other ways, are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np

#: Id that ends each document.
END_ID = 2
#: Pieces that a Python worker remembers with their ids (about 140 MB a million); later ones are encoded anew.
CACHE_PIECES = 700_000
#: Longer pieces are not remembered.
CACHE_CHARS = 48
#: White space other than the ASCII kinds, and controls that libraries judge differently.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: Before a space that follows what is not white space.
_CUT = re.compile(r"(?<=[^ \t\n\r\x0b\x0c])(?= )")
#: Words of Latin letters alone, which no pattern cuts: the library's model takes them as they are.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_GAPS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, other bytes for the characters from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _places(ids: list) -> list[int]:
    """Where a list holds None."""
    at, i = [], -1
    try:
        while True:
            i = ids.index(None, i + 1)
            at.append(i)
    except ValueError:
        return at


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. One per worker process and file.

    Texts that contain the string of one of the library's added tokens are encoded whole.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, remembered: int = CACHE_PIECES):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        names = (self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size()))
        self.n_bytes = np.array([len(x) for x in names], dtype=np.int64)  # a character a byte
        self.marks = {m: self._whole(m) for m in ".,"}
        self.model = self.library.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the cache below takes its place
        self.cache: dict[str, bytes] = {}  # of pieces that follow a space, without it

    @classmethod
    def of(cls, path: str, remembered: int = CACHE_PIECES) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].remembered = remembered
        return cls._made[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word of Latin letters after a space."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(_LETTERS[32] + letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece after a space. Words of Latin letters go to the model one by one.

        Other pieces are encoded in one text and told apart by bytes. Between letters and a comma or full stop there is always a cut, so a piece that ends so
        is its stem, where that is known, and the mark.
        """
        made, inner, later = {}, {}, []
        word = _WORD.fullmatch
        for p in pieces:
            if word(p):
                made[p] = self._word(p)
            elif not p or p[-1].isspace():
                made[p] = self._whole(" " + p)
            elif p[-1] in self.marks and (stem := p[:-1]).isalpha():
                later.append(p)
                if stem not in self.cache and stem not in made:
                    if word(stem):
                        made[stem] = self._word(stem)
                    else:
                        inner[stem] = None
            else:
                inner[p] = None
        inner = list(inner)
        for i in range(0, len(inner), 4096):
            some = inner[i : i + 4096]
            (done,) = self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(done.ids, dtype="<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in some])
            stops = (4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            made.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        for p in later:
            stem = p[:-1]
            made[p] = (made[stem] if stem in made else self.cache[stem]) + self.marks[p[-1]]
        return made

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null counts as empty."""
        get, out, waiting, need = self.cache.get, [], [], {}
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if _ODD.search(text) or (self.added and self.added.search(text)):
                out.append(self._whole(text))
                continue
            if any(gap in text for gap in _GAPS):
                first, *rest = _CUT.split(text)
                rest = [p[1:] for p in rest]
            else:
                first, *rest = text.split(" ")
            head = self._whole(first) if first else b""
            ids = list(map(get, rest))
            if None in ids:
                at = _places(ids)
                need.update(dict.fromkeys([rest[i] for i in at]))
                waiting.append((len(out), head, rest, ids, at))
                out.append(b"")
            else:
                out.append(head + b"".join(ids))
        if waiting:
            made = self._fresh(list(need))
            for k, head, rest, ids, at in waiting:
                for i in at:
                    ids[i] = made[rest[i]]
                out[k] = head + b"".join(ids)
            if len(self.cache) < self.remembered:
                self.cache.update((p, x) for p, x in made.items() if len(p) <= CACHE_CHARS)
        return out


_END = np.array([END_ID], dtype="<u4").tobytes()


def with_end(ids: bytes) -> bytes:
    return ids + _END


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
