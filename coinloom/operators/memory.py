"""A person's corrections and what the engine remembers of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.narration import merchant_portion
from ..schema import PERSON, PERSON_MEMORY, live, not_by_hand


class NotFound(LookupError):
    """No live transaction has the id."""


class StaleSet(ValueError):
    """The rows that would change are not the rows that were shown."""


def set_transaction_category(transactions: DataFrame, memory: DataFrame, transaction_id: str, category: str | None, remember: bool) -> tuple[DataFrame, DataFrame, str | None, bool]:
    """The two tables after a correction, the merchant portion, and whether a memory was formed.

    A new memory of a portion replaces the old one.
    """
    row = transactions.where((F.col("id") == transaction_id) & live()).select(merchant_portion(F.col("description_raw")).alias("p")).first()
    if row is None:
        raise NotFound(transaction_id)
    hit = (F.col("id") == transaction_id) & live()
    out = transactions.withColumns({"category_id": F.when(hit, F.lit(category)).otherwise(F.col("category_id")), "categorised_by": F.when(hit, F.lit(PERSON)).otherwise(F.col("categorised_by"))})
    formed = bool(remember and row["p"] and category)
    if formed:
        new = transactions.sparkSession.createDataFrame([(row["p"], category)], memory.schema)
        memory = memory.where(F.col("merchant_portion") != row["p"]).unionByName(new)
    return out, memory, row["p"], formed


def affected(transactions: DataFrame, memory: DataFrame, portion: str) -> DataFrame:
    """Live rows of the portion, but those decided by hand or already by this memory."""
    known = memory.where(F.col("merchant_portion") == portion).agg(F.max("category_id")).first()[0]  # a portion is a key of memory
    rows = transactions.where(live() & not_by_hand() & (merchant_portion(F.col("description_raw")) == portion) & F.lit(known is not None))
    rows = rows.withColumn("remembered", F.lit(known).cast("string"))
    return rows.where(~(F.col("categorised_by").eqNullSafe(F.lit(PERSON_MEMORY)) & F.col("category_id").eqNullSafe(F.col("remembered"))))


def preview(transactions: DataFrame, memory: DataFrame, accounts: DataFrame, portion: str) -> DataFrame:
    """How many rows of each account a memory would change, by name and then id; changes nothing."""
    of = accounts.select(F.col("id").alias("account_id"), "name")
    counts = affected(transactions, memory, portion).groupBy("account_id").agg(F.count("*").alias("n"))
    return counts.join(of, "account_id").select("account_id", F.col("name").alias("display_name"), "n").orderBy("display_name", "account_id")


def set_digest(ids: DataFrame) -> tuple[int, int, int]:
    """What tells a set of ids from any other, whatever their order: their number and two sums of independent 64-bit hashes."""
    own = ids.select(F.col("id").cast("string").alias("id")).distinct()
    sums = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    row = own.agg(F.count("*").alias("n"), *sums).first()
    return row["n"], int(row["s1"] or 0), int(row["s2"] or 0)


def apply_memory(transactions: DataFrame, memory: DataFrame, portion: str, expected: DataFrame | tuple[int, int, int]) -> DataFrame:
    """transactions after the memory is applied to exactly the expected ids, or StaleSet.

    expected: the ids that a preview showed, or the set_digest that was kept of them, which costs one
    aggregate whatever their number.
    """
    found = affected(transactions, memory, portion).select("id", "remembered")
    if set_digest(found) != (expected if isinstance(expected, tuple) else set_digest(expected)):
        raise StaleSet(portion)
    rows = transactions.join(found, "id", "left")
    hit = F.col("remembered").isNotNull()
    rows = rows.withColumns({"category_id": F.when(hit, F.col("remembered")).otherwise(F.col("category_id")), "categorised_by": F.when(hit, F.lit(PERSON_MEMORY)).otherwise(F.col("categorised_by"))})
    return rows.select(transactions.columns)
