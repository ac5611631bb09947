"""The registered queries on the whole small tables: columns, rows, folds and laws of their contracts."""

from __future__ import annotations

import zlib

import duckdb
import pytest

from coinloom.llm import queries, sentencepieces
from coinloom.llm.minhash import SHINGLE

from .test_minhash import brute

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_sentencepiece": ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
    "op8_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10_embedding": ["vec_id", "n_links", "component_id", "kept"],
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_word_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    made = {}

    def get(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, sf_dir).collect()
        return made[name]

    return get


@pytest.fixture(scope="module")
def table(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns_and_rows(results, sf_dir, table, name):
    rows = results(name)
    assert [c for c in COLUMNS[name] if c not in rows[0].asDict()] == []
    if name == "op10_embedding":
        ids = [i for (i,) in duckdb.sql(f"SELECT vec_id FROM '{sf_dir}/embeddings.parquet'").fetchall()]
        assert sorted(r["vec_id"] for r in rows) == sorted(ids)
    elif name == "op11_prefix_trie":
        assert len({(r["conv_id"], r["depth"]) for r in rows}) == len(rows) and sum(r["parent_conv_id"] is None for r in rows) == 1
    elif name == "op9_packing":
        assert {r["doc_id"] for r in rows} == {i for i, _ in table}
    else:
        assert sorted(r["doc_id"] for r in rows) == [i for i, _ in table]


def test_folds_are_of_the_id(results):
    for name, folds, fold in (("op3_quality", 5, 0), ("op6_language", 3, 1)):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in results(name))


def test_law_of_shards(results, table):
    rows = results("op2_sharding")
    assert {r["law"] for r in rows} == {"key"} and {r["shard"] for r in rows} == set(range(16))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows) and any(r["grown_shard"] == 16 for r in rows)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_token_files_and_packing_tell_of_the_same_ids(results):
    whole = {r["doc_id"]: r["n_tokens"] for r in results("op4_token_files")}
    sums: dict[int, int] = {}
    for r in results("op9_packing"):
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert sums == whole
    at = 0
    for r in sorted(results("op4_token_files"), key=lambda r: r["doc_id"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_sentencepiece_ids_equal_the_library(results, table):
    import numpy as np
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in results("op7_sentencepiece")}
    for i, text in table:
        ids = library.encode(text or "")
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_word_bpe_equals_the_library(results, table):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from coinloom.llm import word_bpe

    library = Tokenizer.from_file(word_bpe.default_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in results("op13_word_bpe")}
    for i, text in table:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_says_the_same(results, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    said = con.sql(queries.ORACLE_SQL[name])
    rows = results(name)
    columns = sorted(said.columns)
    at = [said.columns.index(c) for c in columns]
    assert sorted([tuple(r[c] for c in columns) for r in rows], key=str) == sorted([tuple(r[i] for i in at) for r in said.fetchall()], key=str)
    assert sorted(rows[0].asDict()) == columns


def test_near_duplicates_equal_brute_force(results, table):
    assert SHINGLE == 2
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in results("op8_near_duplicates")) == sorted(brute(table))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in results("op8_near_duplicates"))
