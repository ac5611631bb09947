"""Which of the last 24 months are imported, and how fully."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COVERED, GAP, PARTIAL, STATEMENT

MONTHS = 24


def month_window(accounts: DataFrame, today: str, months: int = MONTHS) -> DataFrame:
    """account_id and month (its first day) for each month up to today's."""
    last = F.trunc(F.lit(today).cast("date"), "month")
    span = F.sequence(F.add_months(last, -(months - 1)), last, F.expr("interval 1 month"))
    return accounts.select(F.col("id").alias("account_id"), F.explode(span).alias("month"))


def coverage(accounts: DataFrame, statements: DataFrame, transactions: DataFrame, today: str) -> DataFrame:
    """One row per account and month: state, and whether a statement there needs review.

    A month is covered by a statement that ends in it or by any row from a full statement.
    Rows that are superseded by others still count; deleted ones don't.
    """
    full = statements.select(F.col("id").alias("statement_id"), (F.col("source") == STATEMENT).alias("full"))
    rows = transactions.where(~F.col("is_deleted")).join(full, "statement_id", "left")
    by_row = rows.groupBy("account_id", F.trunc("date", "month").alias("month")).agg(F.bool_or(F.coalesce("full", F.lit(False))).alias("has_full"))
    by_statement = statements.groupBy("account_id", F.trunc("period_end", "month").alias("month")).agg(F.bool_or("needs_review").alias("review"))
    out = month_window(accounts, today).join(by_row, ["account_id", "month"], "left").join(by_statement, ["account_id", "month"], "left")
    covered = F.col("review").isNotNull() | F.coalesce("has_full", F.lit(False))
    state = F.when(covered, COVERED).when(F.col("has_full").isNotNull(), PARTIAL).otherwise(GAP)
    return out.select("account_id", F.date_format("month", "yyyy-MM").alias("month"), state.alias("state"), F.coalesce("review", F.lit(False)).alias("needs_review"))
