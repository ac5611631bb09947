"""Texts that hold an added token's string, against the library called with its defaults."""

from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from coinloom.llm import packing, token_files, tokens

PATH = tokens.default_path()
TEXTS = ["a<|endoftext|>b", "no mark here", "two <|endoftext|> marks <|endoftext|>, and words", "<|endoftext|>", "<|endoftext |>", "x　<|endoftext|> y"]


def test_token_files_and_packing(spark, scratch):
    library = Tokenizer.from_file(PATH)
    ids = [[*library.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in TEXTS]
    assert ids[0][:-1] == [64, 50256, 65]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    token_files.write(docs, scratch.path("tokens"), PATH)
    rows = token_files.with_starts(token_files.digest(spark, scratch.path("tokens"))).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == [(k, len(x), c) for k, (x, c) in enumerate(zip(ids, crc, strict=True))]
    pieces = packing.pack(docs, scratch, PATH).collect()
    assert sorted((r["doc_id"], r["length"]) for r in pieces) == [(k, len(x)) for k, x in enumerate(ids)]
