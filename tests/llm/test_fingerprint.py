"""Sketches against a plain version, and resemblance against whole shingle sets."""

from __future__ import annotations

import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from coinloom.llm import fingerprint as fp


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingles(text: str) -> set[int]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", lower) if w]
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    out = set()
    for i in range(max(1, len(hashes) - fp.SHINGLE + 1)) if hashes else ():
        h = 42
        for x in hashes[i : i + fp.SHINGLE]:
            h = xxhash.xxh64(struct.pack("<Q", x), seed=h).intdigest()
        out.add(signed(h))
    return out


def plain(text: str) -> tuple[list[int], int | None]:
    every = shingles(text)
    return sorted(x for x in every if x < -(2**63) + 2**64 // fp.SCALE), min(every, default=None)


def hexed(sketch) -> str:
    kept, least = sketch
    return "".join(f"{x & (2**64 - 1):016x}" for x in kept) or ("" if least is None else f"~{least & (2**64 - 1):016x}")


def likeness(a, b) -> float:
    if a[0] or b[0]:
        return len(set(a[0]) & set(b[0])) / len(set(a[0]) | set(b[0]))
    return float(a[1] == b[1])


def share(a, b) -> float | None:
    if a[0]:
        return round(len(set(a[0]) & set(b[0])) / len(a[0]), 9)
    return 1.0 if a[1] is None or a[1] == b[1] else None


def check(rows, texts):
    """texts: (doc_id, text) in order."""
    want = []
    for i, (doc_id, text) in enumerate(texts):
        then = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + then[:half]
        a, b, c = plain(text), plain(edited), plain(then)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(likeness(a, b), 9), round(likeness(a, c), 9), share(a, b), share(b, a)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9), *(r[c] if r[c] is None else round(r[c], 9) for c in ("in_edited", "edited_in"))) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_table(docs):
    rows = docs.select("doc_id", "text").collect()
    check(fp.compare_with_edited(docs).collect(), sorted((r["doc_id"], r["text"] or "") for r in rows))


def test_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    check(fp.compare_with_edited(edge_docs).collect(), rows)
    assert fp.compare_with_edited(no_docs).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    check(fp.compare_with_edited(one).collect(), [(1, "a b c d e f g h")])


def test_merge_is_the_sketch_of_the_union(spark):
    many = " ".join(f"w{i}" for i in range(8000))
    part = " ".join(f"w{i}" for i in range(2000))
    rows = spark.createDataFrame([("g", many), ("g", part), ("g", "five words that keep nothing"), (None, "a b"), (None, None)], "g string, text string").withColumn("sketch", fp.sketch(F.col("text")))
    merged = {r["g"]: (r["sketch"]["kept"], r["sketch"]["least"]) for r in fp.merge(rows, ["g"]).collect()}
    union = shingles(many) | shingles(part) | shingles("five words that keep nothing")
    assert merged["g"] == (sorted(x for x in union if x < -(2**63) + 2**64 // fp.SCALE), min(union))
    assert merged[None] == plain("a b")
    both = spark.createDataFrame([(part, many)], "a string, b string").select(fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("c"), fp.containment(fp.sketch(F.col("b")), fp.sketch(F.col("a"))).alias("d")).first()
    assert both["c"] == 1.0 and abs(both["d"] - 0.25) < 0.05
