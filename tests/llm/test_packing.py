"""Every piece in its place, and few sequences: held against the certified bound."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from coinloom.llm import packing, tokens

PATH = tokens.default_path()


def check(packed, docs):
    """Returns sequences used, after holding pieces and places against the documents."""
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"])
    encoder = tokens.Encoder.of(PATH)
    want, have, rows_of = [], [], defaultdict(list)
    for doc_id, own in texts.items():
        for text in own:
            ids = np.frombuffer(tokens.with_end(encoder.encode([text])[0]), "<u4")
            start = 0
            for piece in range(-(-len(ids) // 1024)):
                length = (len(ids) - start) % 1024 or 1024
                want.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                start += length
    for r in packed.collect():
        have.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        rows_of[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(want, key=repr) == sorted(have, key=repr)
    for own in rows_of.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(rows_of)


def test_whole_table(docs, scratch):
    packed = packing.pack(docs, scratch, PATH)
    used = check(packed, docs)
    counted, bound = packing.certificate(packed)
    assert used == counted and bound <= used <= bound * 1.01 + 1


def test_partitions_exchange(docs, scratch):
    """With partitions of a few pieces, exchanges bring the number of sequences down."""
    packed = packing.pack(docs, scratch, PATH, group=16)
    used = check(packed, docs)
    assert used <= packing.certificate(packed)[1] * 1.06 + 1


def test_edges(edge_docs, no_docs, scratch):
    check(packing.pack(edge_docs, scratch, PATH), edge_docs)
    assert packing.pack(no_docs, scratch, PATH).count() == 0


def bins_needed(lengths, capacity):
    """The least number of bins, by trying all placements."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_is_below_the_optimum(lengths):
    lengths = np.array(sorted(lengths, reverse=True))
    least = bins_needed(lengths.tolist(), 20)
    bin_of, offset, bins = packing.best_fit_decreasing(lengths, 20)
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= least <= bins <= len(lengths)
    for b in range(bins):
        own = sorted((o, n) for o, n, x in zip(offset.tolist(), lengths.tolist(), bin_of.tolist(), strict=True) if x == b)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 20
