"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, fingerprint, language, merkle, minhash, packing, pii, prefix_trie, quality, sentencepieces, sharding, token_files, tokens, word_bpe
from . import sql
from .common import Scratch, documents, held_out, tune

SHARDS = 16


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Tree.even(SHARDS)
    return sharding.assign(documents(spark, sf_dir), tree, tree.grant("region1", "rack3", SHARDS, 1.0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 5, 0))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    return quality.score(docs, quality.learn(docs, labels), "text", "doc_id", "held_out")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    token_files.write(documents(spark, sf_dir), scratch.path("tokens"), tokens.default_path())
    digests = scratch.table(token_files.digest(spark, scratch.path("tokens")), "digests")
    return token_files.with_starts(digests)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 3, 1))
    return language.predict(docs, language.learn(docs.where("not held_out")), "text", "doc_id", "held_out")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sentencepieces.default_path()
    encoded = sentencepieces.encode(documents(spark, sf_dir), Scratch(spark), path)
    done = sentencepieces.decode(encoded, path)
    crc = F.crc32(F.col("text").cast("binary"))
    return done.select("doc_id", "n_chars", "n_tokens", "ids_crc32", crc.alias("decoded_crc32"), (crc == F.col("text_crc32")).alias("round_trip"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), Scratch(spark), words=minhash.SHINGLE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), Scratch(spark), tokens.default_path())


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    scratch = Scratch(spark)
    own = scratch.table(prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    takes = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (sql.TAKES_AT_MOST + 1)
    ids, rebuilt = prefix_trie.rebuilt(own, sql.TAKES_FROM, takes, sql.TAKES_AT_MOST)
    return prefix_trie.trie(scratch.table(ids, "ids"), scratch.table(rebuilt, "rebuilt"), scratch)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir), Scratch(spark), merkle.tampered())


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_bpe.default_path()
    done = word_bpe.decode(word_bpe.encode(documents(spark, sf_dir), path), path)
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_sharding, op3_quality, op4_token_files, op5_fingerprint, op6_language, op7_sentencepiece, op8_near_duplicates, op9_packing, op10_embedding, op11_prefix_trie, op12_merkle, op13_word_bpe)
}

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": sql.prefix_trie(), "op12_merkle": sql.merkle()}
