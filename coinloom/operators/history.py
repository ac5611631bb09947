"""The combined history: account summaries, counts, and pages in one total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import live, unanswered

MAX_PAGE = 200


def account_summaries(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every account with its number of live rows, and whether it has excluded rows only.

    Both counts come from one aggregation, made before the join.
    """
    counts = transactions.groupBy("account_id").agg(F.count(F.when(live(), 1)).alias("live"), F.count("*").alias("every"))
    out = accounts.join(counts, accounts["id"] == counts["account_id"], "left")
    live_count, every = F.coalesce("live", F.lit(0)), F.coalesce("every", F.lit(0))
    return out.select("id", "name", "account_seq", live_count.alias("live_count"), ((live_count == 0) & (every > 0)).alias("has_only_excluded_rows"))


def uncategorized_count(transactions: DataFrame) -> DataFrame:
    return transactions.where(live() & unanswered()).agg(F.count("*").alias("uncategorized"))


def live_rows_of_statement(transactions: DataFrame) -> DataFrame:
    return transactions.where(live() & F.col("statement_id").isNotNull()).groupBy("statement_id").agg(F.count("*").alias("live_rows"))


def list_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy("account_seq")


def list_transactions(transactions: DataFrame, account_id: str) -> DataFrame:
    """All rows of an account as they came, live or not."""
    return transactions.where(F.col("account_id") == account_id).orderBy("txn_seq")


def list_statements(statements: DataFrame, account_id: str) -> DataFrame:
    """An account's statements as they came; those of stores that kept no sequence first, by what they tell of it."""
    return statements.where(F.col("account_id") == account_id).orderBy(F.col("statement_seq").asc_nulls_first(), "created_at", "period_end", "id")


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("date"), F.asc("account_seq"), F.asc("txn_seq"))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    #: account_id, date, txn_seq of the last row given, for each account that has more; empty at the end.
    cursor: DataFrame


def history_rows(transactions: DataFrame, accounts: DataFrame, categories: DataFrame, uncategorized_only: bool = False) -> DataFrame:
    """Live rows with the names of their account and category, internals left out."""
    rows = transactions.where(live() & unanswered() if uncategorized_only else live())
    of = accounts.select(F.col("id").alias("account_id"), "account_seq", F.col("name").alias("account_name"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    rows = rows.join(of, "account_id").join(names, "category_id", "left")
    return rows.select("id", "account_id", "account_name", "account_seq", "txn_seq", "date", "description_raw", "amount", "direction", "currency", "category_id", "category_name", "categorised_by")


def page(rows: DataFrame, limit: int, account_id: str | None = None, cursor: DataFrame | None = None) -> Page:
    """The next rows in order, and where each account goes on.

    The limit is clamped to 1..MAX_PAGE. Paging is by key: a row that arrives meanwhile makes no
    other row repeat or go missing. An account that gave all it had leaves the cursor. The sort
    and the limit run as one bounded top-k on every partition.
    """
    limit = max(1, min(limit, MAX_PAGE))
    if account_id is not None:
        rows = rows.where(F.col("account_id") == account_id)
    if cursor is not None:
        marks = cursor.select("account_id", F.col("date").alias("mark_date"), F.col("txn_seq").alias("mark_seq"))
        rows = rows.join(marks, "account_id")
        after = (F.col("date") < F.col("mark_date")) | ((F.col("date") == F.col("mark_date")) & (F.col("txn_seq") > F.col("mark_seq")))
        rows = rows.where(after)
    else:
        rows = rows.withColumns({"mark_date": F.lit("9999-12-31").cast("date"), "mark_seq": F.lit(0).cast("long")})
    given = ordered(rows).limit(limit)
    left = rows.groupBy("account_id").agg(F.count("*").alias("n"), F.first("mark_date").alias("mark_date"), F.first("mark_seq").alias("mark_seq"))
    last = given.groupBy("account_id").agg(F.count("*").alias("taken"), F.min(F.struct("date", (-F.col("txn_seq")).alias("s"))).alias("last"))
    ends = left.join(last, "account_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    ends = ends.where((F.col("n") >= limit) | (F.col("taken") < F.col("n")))
    ends = ends.select("account_id", F.coalesce("last.date", "mark_date").alias("date"), F.coalesce(-F.col("last.s"), F.col("mark_seq")).alias("txn_seq"))
    return Page(given.drop("mark_date", "mark_seq"), ends)


def by_date(rows: DataFrame) -> DataFrame:
    """Rows grouped by date, in the order of the history inside a date."""
    own = F.array_sort(F.collect_list(F.struct("account_seq", "txn_seq", "id")))
    return rows.groupBy("date").agg(F.transform(own, lambda x: x["id"]).alias("ids"), F.count("*").alias("n"))
