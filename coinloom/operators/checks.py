"""Checks of parsed statements: the chain of running balances, and totals against printed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CREDIT, DEBIT, MONEY, NEEDS_REVIEW, RECONCILED

TOLERANCE = 1
MOST_SUSPECTS = 20
FALLBACKS = ("ROW1_X_POSITION", "ROW1_PROVISIONAL")


def balance_chain(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per statement: status, checked_rows, suspect_count, suspects, row1_direction_fallback, derived balances, reason.

    statements: doc_id, printed_opening_balance and, if there, printed_closing_balance. rows:
    doc_id, line_index, amount, balance, direction_source and, if there, serial. Each balance must differ from the one before by the amount. A row without
    a balance is a suspect and does not advance the chain; a first row whose direction was only
    guessed is not held against its own guess, but leaves the statement to be reviewed.
    """
    order = Window.partitionBy("doc_id").orderBy("line_index")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(statements.select("doc_id", "printed_opening_balance"), "doc_id")
    out = out.withColumns({"row": F.row_number().over(order), "prev": F.coalesce(F.last("balance", True).over(past), F.col("printed_opening_balance"))})
    guessed = (F.col("row") == 1) & F.coalesce(F.col("direction_source").isin(*FALLBACKS), F.lit(False))
    missing = F.col("balance").isNull()
    delta = F.abs(F.col("balance") - F.col("prev"))
    wrong = ~missing & F.col("prev").isNotNull() & ~guessed & (F.abs(F.col("amount") - delta) > TOLERANCE)
    cents = "decimal(38,2)"
    differs = F.concat(F.lit("amount "), F.col("amount").cast(cents).cast("string"), F.lit(" != |balance delta| "), delta.cast(cents).cast("string"))
    reason = F.when(missing, F.lit("missing running balance")).when(wrong, differs)
    serial = F.col("serial") if "serial" in rows.columns else F.lit(None).cast("string")
    suspect = F.when(reason.isNotNull(), F.struct("row", serial.alias("serial"), "amount", reason.alias("reason")))
    sums = out.groupBy("doc_id").agg(
        F.count("*").alias("checked_rows"), F.count(suspect).alias("suspect_count"), F.bool_or(guessed).alias("row1_direction_fallback"),
        F.slice(F.array_sort(F.collect_list(suspect)), 1, MOST_SUSPECTS).alias("suspects"),
    )
    closing = F.col("printed_closing_balance") if "printed_closing_balance" in statements.columns else F.lit(None).cast(MONEY)
    heads = statements.select("doc_id", F.col("printed_opening_balance").alias("derived_opening_balance"), closing.alias("derived_closing_balance"))
    sums = heads.join(sums, "doc_id", "left").withColumn("reason", F.when(F.col("checked_rows").isNull(), F.lit("no parsed transactions")))
    sums = sums.withColumns({"checked_rows": F.coalesce("checked_rows", F.lit(0)), "suspect_count": F.coalesce("suspect_count", F.lit(0)), "row1_direction_fallback": F.coalesce("row1_direction_fallback", F.lit(False))})
    good = (F.col("checked_rows") > 0) & (F.col("suspect_count") == 0) & ~F.col("row1_direction_fallback")
    return sums.withColumn("status", F.when(good, RECONCILED).otherwise(NEEDS_REVIEW))


def reconcile(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Sums by direction against printed totals, else against the change of balance; null status and a reason with neither."""
    sums = rows.groupBy("doc_id").agg(F.sum(F.when(F.col("direction") == DEBIT, F.col("amount"))).alias("d"), F.sum(F.when(F.col("direction") == CREDIT, F.col("amount"))).alias("c"))
    out = statements.join(sums, "doc_id", "left")
    out = out.withColumns({"read_debits": F.coalesce("d", F.lit(0)).cast(MONEY), "read_credits": F.coalesce("c", F.lit(0)).cast(MONEY)})
    pd, pc = F.col("printed_total_debits"), F.col("printed_total_credits")
    totals_ok = (pd.isNull() | (F.abs(F.col("read_debits") - pd) <= TOLERANCE)) & (pc.isNull() | (F.abs(F.col("read_credits") - pc) <= TOLERANCE))
    has_totals = pd.isNotNull() | pc.isNotNull()
    expected = (F.col("printed_closing_balance") - F.col("printed_opening_balance")).cast(MONEY)
    computed = (F.col("read_debits") - F.col("read_credits")).cast(MONEY)
    ok = F.when(has_totals, totals_ok).when(expected.isNotNull(), F.abs(computed - expected) <= TOLERANCE)
    use_balance = ~has_totals & expected.isNotNull()
    return out.select(
        "doc_id", F.when(ok, F.lit(RECONCILED)).when(~ok, F.lit(NEEDS_REVIEW)).alias("status"), "read_debits", "read_credits",
        F.when(has_totals, pd).alias("printed_debits"), F.when(has_totals, pc).alias("printed_credits"),
        F.when(use_balance, expected).alias("expected_balance_change"), F.when(use_balance, computed).alias("computed_balance_change"),
        F.when(~has_totals & expected.isNull(), F.lit("no printed totals extracted")).alias("reason"),
    )
