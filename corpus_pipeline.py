"""A corpus pipeline: language, quality, near-duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it
keeps. All but the last return the columns of documents, further ones among them.

1. language: documents whose language can't be told (null text, or no letter) go.
2. quality: documents that the rule ensemble predicts bad go. Texts that are null or empty are
   scored like any other; where nothing can be learned, the share of good labels decides for all.
3. near_duplicates: of each group of near-duplicates by five-word shingles at 0.8 the smallest id
   stays. Texts without words are near to nothing. Of an id that repeats one row stays, a text before a null
   and the smallest text first; rows without an id all stay.
4. pii: personal data in the text becomes its kind in brackets, and n_chars is kept true. A null text stays null.
5. packing: one row per piece of what is left, in sequences of 1024 tokens. A null text counts as empty.

An empty table passes through every stage. Columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinloom.llm import language, minhash, packing, pii, quality, tokens
from coinloom.llm.common import BROADCAST_ROWS, Scratch, documents, held_out, tune


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the profiles can tell."""
    tune(spark)
    return language.keep_known(docs, language.learn(docs.where(~held_out("doc_id", 3, 1))))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels, predicts good."""
    tune(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    return quality.keep_good(docs, quality.learn(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without words all stay."""
    tune(spark)
    scratch = Scratch(spark)
    found = scratch.table(minhash.near_duplicates(docs, scratch, words=minhash.GENERAL).select("doc_id", "kept"), "found")
    gone = found.where("not kept").select("doc_id").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = scratch.table(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    # Repeats are combined before the shuffle, so a hot id doesn't meet in one task.
    again = left.join(repeated, "doc_id", "left_semi").select(F.struct(*left.columns).alias("r"))
    first = F.struct(F.col("r.text").isNull(), F.col("r.text"), F.xxhash64("r"))
    again = again.groupBy(F.col("r.doc_id").alias("of")).agg(F.min_by("r", first).alias("r")).select("r.*")
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data in their texts replaced by its kind."""
    tune(spark)
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, sequence and place."""
    tune(spark)
    return packing.pack(docs, Scratch(spark), tokens.default_path())


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Model fitting, components and packing are beyond SQL; tests/llm/test_corpus_pipeline.py holds each stage and the
#: whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
