"""The stages of the corpus pipeline, each and together, against brute force on their own inputs."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from coinloom.llm import language, pii, quality, tokens
from coinloom.llm.common import held_out

from .conftest import prose

CLASHING = ("_predicted_language", "_quality_statistics", "_place_among_repeats", "count", "kept", "component_id", "node", "part", "length", "row")


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return ({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}) if words else set()


def kept(rows):
    """Ids of all but the smallest of each component of resemblance 0.8; ids are unique."""
    sets = [shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i for (i, _), c in zip(rows, label, strict=True) if i == c}


def lengths(library, text):
    """Pieces of a text: the first takes what is over."""
    n, out, start = len(library.encode(text or "", add_special_tokens=False).ids) + 1, [], 0
    while start < n:
        out.append((start, (n - start) % 1024 or 1024))
        start += out[-1][1]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def awkward(spark, edge_docs):
    """Edge rows, repeats of an id, and columns that stages might use for their own."""
    more = [(7, prose(3, 60)), (7, prose(3, 60)), (20, prose(20, 80)), (20, None), (21, "")]
    extra = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(3)


def test_near_duplicates_stage(spark, sf_dir):
    rng, rows = random.Random(9), []
    for g in range(10):
        words = prose(300 + g, 200).split()
        rows.append((100 * g, " ".join(words)))
        for k in range(1, 12):
            own = list(words)
            for at in rng.sample(range(10, 190), k):
                own[at] = f"edit{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(own)))
    scattered = prose(400, 200).split()
    rows.append((5000, " ".join(scattered)))
    rows.append((5001, " ".join(f"edit{k}" if k % 20 == 10 else w for k, w in enumerate(scattered))))
    rows += [(6000, "one two"), (6001, "One  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(kept(rows)) and {5000, 5001} <= set(got) and 6001 not in got


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_awkward_rows(spark, sf_dir, awkward, name):
    """Each stage but the last: all columns stay, rows that stay are rows that came, and what goes is what should."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, sf_dir)
    assert out.columns == awkward.columns and out.schema.simpleString() == awkward.schema.simpleString()
    came, stays = [tuple(r) for r in awkward.collect()], [tuple(r) for r in out.collect()]
    assert all(r[5:] == tuple(f"own {c}" for c in CLASHING) for r in stays)
    ids = [r[0] for r in stays]
    if name == "language":
        letters = [r for r in came if any(c.isalpha() for c in r[1] or "")]
        assert sorted(stays, key=repr) == sorted(letters, key=repr)
    elif name == "quality":
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
        scored = quality.score(awkward, quality.learn(awkward, labels), "text", "doc_id", "text").collect()
        assert sorted(((r[0], r[1]) for r in scored if r["predicted"] == 1), key=repr) == sorted(((r[0], r[1]) for r in stays), key=repr)
    elif name == "near_duplicates":
        assert sorted(i for i in ids if i is not None) == sorted({r[0] for r in came if r[0] is not None} - {5, 7, 13}) and ids.count(None) == 2
        assert [r[1] for r in stays if r[0] == 20] == [prose(20, 80)]
    else:
        assert sorted(((r[0], r[1]) for r in stays), key=repr) == sorted(((r[0], pii.masked(r[1])) for r in came), key=repr)
        assert all(r[4] == len(r[1]) for r in stays if r[1] is not None)


def test_stages_on_an_empty_table(spark, sf_dir, awkward):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.where("false"), sf_dir).count() == 0


def check_places(rows):
    """Sequences are gapless from 0 and hold at most 1024 tokens."""
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_stage(spark, sf_dir, awkward, library):
    rows = corpus_pipeline.packing_stage(spark, awkward, sf_dir).collect()
    want = [(r["doc_id"], start, n) for r in awkward.select("doc_id", "text").collect() for start, n in lengths(library, r["text"])]
    assert sorted(((r["doc_id"], r["start"], r["length"]) for r in rows), key=repr) == sorted(want, key=repr)
    check_places(rows)


def test_whole_run(spark, sf_dir, docs, library):
    """Fitted models are taken as they are; all that follows from them is done again in plain Python."""
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    profiles = language.learn(docs.where(~held_out("doc_id", 3, 1)))
    left = {r["doc_id"]: r["text"] for r in docs.collect() if profiles.predict(r["text"])[0] != language.UNKNOWN}
    known = docs.where(F.col("doc_id").isin(list(left)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    good = {r["doc_id"] for r in quality.score(known, quality.learn(known, labels), "text", "doc_id").where("predicted = 1").collect()}
    texts = [(i, t) for i, t in sorted(left.items()) if i in good]
    stays = kept(texts)
    want = {}
    for i, text in texts:
        if i in stays:
            ids = [*library.encode(pii.masked(text), add_special_tokens=False).ids, tokens.END_ID]
            for start, n in lengths(library, pii.masked(text)):
                want[i, start] = (n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert 0 < len(stays) < docs.count()
    check_places(rows)
