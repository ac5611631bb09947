"""The history in files that already have its order, so that a page reads few of them.

Live rows are written by month and, inside a month, by a bucket of accounts, sorted by date downward,
account and sequence. Two small tables go with them: how many rows each account has in each month,
and each account's last row. A page picks the newest months that together must hold enough rows after
its cursor, and reads these alone: what lies before them is never opened, however much it is. Of one
account only its bucket is read. Names are joined to the page's rows, not to the table.

Cases: rows without an account, a date or a sequence have no place in the order and are left out; an
empty table has one empty page; an account without rows has an empty page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.history import MAX_PAGE, Page, ordered
from ..schema import live

#: Rows of a month for which another bucket of accounts is made.
BUCKET_ROWS = 1_000_000


def _bucket(account: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(account), F.lit(buckets)).cast("int")


def _month(date: Column) -> Column:
    """Months as numbers: 12 times the year and the month."""
    return (F.year(date) * 12 + F.month(date)).cast("int")


class HistoryFiles:
    """A history under a path that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, transactions: DataFrame, accounts: DataFrame, buckets: int | None = None) -> HistoryFiles:
        """transactions: all rows; only live ones are written. accounts: id and account_seq. buckets: by the fullest month, if None."""
        of = accounts.select(F.col("id").alias("account_id"), "account_seq")
        rows = transactions.where(live() & F.col("date").isNotNull() & F.col("txn_seq").isNotNull()).join(of, "account_id")
        rows = rows.withColumn("month", _month(F.col("date")))
        if buckets is None:
            buckets = 1 + (rows.groupBy("month").count().agg(F.max("count")).first()[0] or 0) // BUCKET_ROWS
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}/about")
        rows = rows.withColumn("bucket", _bucket(F.col("account_id"), buckets))
        # One shuffle: months and buckets are dealt by ranges, so a month of very many rows is several tasks' and files.
        rows = rows.repartitionByRange("month", "bucket", F.desc("date"), "account_seq", "txn_seq").sortWithinPartitions("month", "bucket", F.desc("date"), "account_seq", "txn_seq")
        rows.write.partitionBy("month", "bucket").mode("overwrite").parquet(f"{self.path}/rows")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/shape")  # tells the columns where there are no rows
        own = self.rows().select("account_id", "account_seq", "month", "date", "txn_seq")
        counts = own.groupBy("account_id", "account_seq", "month").agg(F.count("*").alias("n"), F.min(F.struct("date", (-F.col("txn_seq")).alias("back"))).alias("last"))
        counts.sortWithinPartitions("account_id").write.mode("overwrite").parquet(f"{self.path}/counts")
        counts = self.spark.read.parquet(f"{self.path}/counts")
        counts.groupBy("account_id").agg(F.min("last").alias("last")).select("account_id", F.col("last.date").alias("date"), (-F.col("last.back")).alias("txn_seq")).write.mode("overwrite").parquet(f"{self.path}/ends")
        return self

    def rows(self) -> DataFrame:
        """All rows, with their month and bucket."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/rows")

    def months(self, limit: int, account_id: str | None = None, cursor: DataFrame | None = None) -> list[int]:
        """The newest months that hold the next limit rows: of rows after the cursor those in earlier months than its mark are sure.

        One number a month comes to the driver.
        """
        counts = self.spark.read.parquet(f"{self.path}/counts")
        if account_id is not None:
            counts = counts.where(F.col("account_id") == account_id)
        if cursor is not None:
            counts = counts.join(cursor.select("account_id", _month(F.col("date")).alias("at")), "account_id").where(F.col("month") <= F.col("at"))
            sure = F.when(F.col("month") < F.col("at"), F.col("n")).otherwise(F.lit(0))
        else:
            sure = F.col("n")
        totals = counts.groupBy("month").agg(F.sum(sure).alias("sure"))
        before = F.coalesce(F.sum("sure").over(Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sorted(r["month"] for r in totals.withColumn("before", before).where(F.col("before") < limit).select("month").collect())

    def page(self, limit: int, account_id: str | None = None, cursor: DataFrame | None = None, unanswered_only: bool = False) -> Page:
        """The next rows in the history's order, and where each account goes on; an account that gave all it had leaves the cursor.

        unanswered_only: rows that nobody and nothing has decided; months are then taken one after the
        other, twice as many each time, until the page is full.
        """
        limit = max(1, min(limit, MAX_PAGE))
        if not unanswered_only:
            rows = self._rows(self.months(limit, account_id, cursor), account_id, cursor)
        else:
            every, wanted = self.months(1 << 62, account_id, cursor), 1
            while True:
                rows = self._rows(every[-wanted:], account_id, cursor).where("category_id is null and categorised_by is null")
                if wanted >= len(every) or len(ordered(rows).limit(limit).select("txn_seq").collect()) == limit:
                    break
                wanted *= 2
        given = ordered(rows).limit(limit)
        last = given.groupBy("account_id").agg(F.min(F.struct("date", (-F.col("txn_seq")).alias("back"))).alias("last"))
        ends = self.spark.read.parquet(f"{self.path}/ends").withColumnsRenamed({"date": "end_date", "txn_seq": "end_seq"})
        if account_id is not None:
            ends = ends.where(F.col("account_id") == account_id)
        at = ends.join(last, "account_id", "left")
        if cursor is None:
            # An account that has given nothing starts before its first row.
            date, seq = F.coalesce("last.date", F.lit("9999-12-31").cast("date")), F.coalesce(-F.col("last.back"), F.lit(0).cast("long"))
        else:
            at = at.join(cursor.select("account_id", F.col("date").alias("mark_date"), F.col("txn_seq").alias("mark_seq")), "account_id")
            date, seq = F.coalesce("last.date", "mark_date"), F.coalesce(-F.col("last.back"), F.col("mark_seq"))
        marks = at.withColumns({"date": date, "txn_seq": seq}).where((F.col("date") != F.col("end_date")) | (F.col("txn_seq") != F.col("end_seq")))
        return Page(given, marks.select("account_id", "date", "txn_seq"))

    def _rows(self, months: list[int], account_id: str | None, cursor: DataFrame | None) -> DataFrame:
        rows = self.rows().where(F.col("month").isin(months))
        if account_id is not None:
            bucket = self.spark.read.parquet(f"{self.path}/about").select(F.pmod(F.xxhash64(F.lit(account_id)), F.col("buckets")).cast("int")).first()[0]
            rows = rows.where((F.col("bucket") == bucket) & (F.col("account_id") == account_id))
        if cursor is not None:
            rows = rows.join(cursor.select("account_id", F.col("date").alias("mark_date"), F.col("txn_seq").alias("mark_seq")), "account_id")
            rows = rows.where((F.col("date") < F.col("mark_date")) | ((F.col("date") == F.col("mark_date")) & (F.col("txn_seq") > F.col("mark_seq")))).drop("mark_date", "mark_seq")
        return rows.drop("month", "bucket")


def with_names(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """A page's rows with the names of their accounts."""
    return rows.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name")), "account_id")
