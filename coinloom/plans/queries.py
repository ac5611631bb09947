"""Registered queries on the driver's tables, each with SQL that restates its rule.

The tables have no bank statements, so accounts and transactions are derived from customers and
orders by expressions that Spark and DuckDB both read, and statement text is rendered from line
items and read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import narration as nr
from ..functions import parsing as ps
from ..operators import categorize as cat
from ..operators import checks, coverage, dedup, history, memory, resolution, transfers
from ..schema import CREDIT, DEBIT, DEFAULT_CATEGORIES, MONEY, TABLES, default_categories, live, migrate, signed_amount, violations
from ..session import without_leftovers
from ..sources import printed_rows, statements
from ..sources.history_files import HistoryFiles, with_names
from ..sources.store import Store
from ..streaming import statements as stream
from . import bulk

TODAY = "2025-11-30"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_MERCHANTS = (
    "CORNER BAKERY ONLINE", "CITY METRO CARD", "RIVER BOOKS", "GREEN GROCER", "PAYMENT RECEIVED THANK YOU", "CREDIT CARD AUTOPAY",
    "10% CASHBACK OFFER", "CARD FEE PAYMENT", "SUNRISE PHARMACY", "ORBIT CINEMA", "NOVA FUEL STATION",
)
_CHANNELS = ("UPI-", "POS ", "NEFT/", "IMPS/UPI/", "", "to transfer-", "BIL/", "  ")


def _case(by: str, values) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Orders that give further transactions, by the number of the copy: an echo on an account of the
#: other kind, a second echo, and the other leg of a transfer.
_COPIES = {1: "o_orderkey % 6 = 0", 2: "o_orderkey % 60 = 0", 3: "o_orderkey % 10 = 7"}
_BASE = {
    "m": "o_orderkey * 4 + copy",
    "acct": (
        "CASE copy WHEN 1 THEN CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey - o_custkey % 3 END "
        "WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 2 WHEN o_custkey >= 3 THEN o_custkey - o_custkey % 3 - 3 ELSE 0 END "
        "WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey - 1 END ELSE o_custkey END"
    ),
    #: Echoes come on the day, a day later or two; so do transfer legs.
    "day": (
        "cast(CASE WHEN o_orderkey % 25 = 0 THEN floor(o_orderkey / 25) % 700 ELSE o_orderkey % 700 END + CASE copy WHEN 1 THEN CASE o_orderkey % 30 WHEN 6 THEN 1 WHEN 18 THEN 2 ELSE 0 END "
        "WHEN 3 THEN CASE o_orderkey % 30 WHEN 17 THEN 1 WHEN 27 THEN 2 ELSE 0 END ELSE 0 END as int)"
    ),
    #: Each 25th order has one of few equal amounts and wordings, on every day, so that many rows compete.
    "cents": (
        "CASE WHEN o_orderkey % 25 = 0 THEN 9900 WHEN o_orderkey % 509 = 0 THEN 0 ELSE cast(round(o_totalprice * 100) as bigint) % 3000000 END "
        "+ CASE WHEN copy = 3 THEN CASE o_orderkey % 40 WHEN 17 THEN 50 WHEN 27 THEN 100 WHEN 37 THEN 101 ELSE 0 END ELSE 0 END"
    ),
    "shop": (
        f"concat(CASE WHEN o_orderkey % 25 = 0 THEN 'UPI-CITY METRO' ELSE concat({_case('cast(o_orderkey % 8 as int)', _CHANNELS)}, {_case('cast(o_custkey % 11 as int)', _MERCHANTS)}) END, "
        "CASE WHEN o_orderkey % 5 = 0 THEN concat('  RRN', cast(o_orderkey as string)) WHEN o_orderkey % 5 = 1 THEN ' 123456789012' ELSE '' END)"
    ),
}
#: The same rows, with the few equal amounts on 28 days only: hundreds of times as many rows lie near each other, all of which are candidates.
_CROWDED = _BASE | {"day": _BASE["day"].replace("CASE WHEN o_orderkey % 25 = 0 THEN floor(o_orderkey / 25) % 700 ELSE o_orderkey % 700 END", "o_orderkey % 700")}
_MONTH = "cast(floor(day / 30) as int)"
_STATEMENT = f"concat('s', cast(acct as string), '-', cast({_MONTH} as string))"
#: Column: expression over orders with the columns above, in SQL that both engines read.
TXN = {
    "id": "concat('t', lpad(cast(m as string), 11, '0'))",
    "txn_seq": "m + 1",
    "account_id": "concat('a', cast(acct as string))",
    "date": "DATE '2024-01-01' + day",
    "amount": "cast(cast(cents as decimal(18, 2)) / 100 as decimal(18, 2))",
    "direction": "CASE WHEN (o_orderstatus = 'O') = (copy <> 3) THEN 'Credit' ELSE 'Debit' END",
    "description_raw": (
        "CASE WHEN copy = 1 AND o_orderkey % 30 = 12 THEN concat(shop, ' INDIA') WHEN copy = 1 AND o_orderkey % 30 = 24 THEN 'NOTHING LIKE IT' "
        "WHEN copy = 3 AND o_orderkey % 20 = 7 THEN 'OWN ACCOUNT' ELSE shop END"
    ),
    "currency": "'INR'",
    "category_id": "CASE WHEN m % 9 = 0 THEN 'GROCERIES' END",
    "categorised_by": "CASE WHEN m % 36 = 0 THEN 'PERSON' WHEN m % 36 = 18 THEN 'PERSON_MEMORY' WHEN m % 9 = 0 THEN 'T3_RULE' END",
    "is_deleted": "m % 11 = 0",
    "superseded_by": "CASE WHEN m % 13 = 0 THEN 'other' END",
    "source_category": "CASE WHEN m % 7 = 0 THEN 'FOOD' END",
    "is_transfer": "m % 17 = 0",
    "transfer_group_id": "CASE WHEN m % 17 = 0 THEN 'known' END",
    "statement_id": f"CASE WHEN o_orderkey % 4 <> 0 THEN {_STATEMENT} END",
}
ACCOUNT = {
    "id": "concat('a', cast(c_custkey as string))",
    "account_seq": "cast(c_custkey + 1 as bigint)",
    "name": "c_name",
    "bank_code": _case("cast(c_custkey % 3 as int)", ("ICICI", "HDFC", "SBI")),
    "is_credit_card": "c_custkey % 3 = 0",
    "currency": "'INR'",
}
STATEMENT_OF = {
    "id": _STATEMENT,
    "statement_seq": f"cast({_MONTH} as bigint) * 10000000 + acct",
    "account_id": "concat('a', cast(acct as string))",
    "period_end": f"DATE '2024-01-01' + cast({_MONTH} * 30 + 29 as int)",
    "needs_review": f"{_MONTH} % 5 = 0",
    "source": f"CASE WHEN {_MONTH} % 6 = 0 THEN 'Alert' ELSE 'Statement' END",
}


def _sql(columns: dict[str, str], table: str, where: str = "true", distinct: str = "") -> str:
    return f"SELECT {distinct} " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table} WHERE {where}"


_COPIED = "SELECT *, 0 AS copy FROM orders" + "".join(f" UNION ALL SELECT *, {n} AS copy FROM orders WHERE {w}" for n, w in _COPIES.items())
_WITH = (
    f"WITH RECURSIVE base AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _BASE.items())} FROM ({_COPIED})), txns AS ({_sql(TXN, 'base')}), accounts AS ({_sql(ACCOUNT, 'customer')}), "
    f"statements AS ({_sql(STATEMENT_OF, 'base', distinct='DISTINCT')}), live AS (SELECT * FROM txns WHERE NOT is_deleted AND superseded_by IS NULL) "
)
_WITH_CROWDED = _WITH.replace(f"{_BASE['day']} AS day", f"{_CROWDED['day']} AS day")


def _expr(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS `{c}`" for c, e in columns.items()]


def _base(spark: SparkSession, sf: str, columns: dict[str, str] = _BASE) -> DataFrame:
    """Orders, one row for each transaction they give."""
    copies = F.array(F.lit(0), *(F.when(F.expr(w), F.lit(n)) for n, w in _COPIES.items()))
    return spark.read.parquet(f"{sf}/orders.parquet").withColumn("copy", F.explode(F.array_compact(copies))).selectExpr("*", *_expr(columns))


def dealt(df: DataFrame) -> DataFrame:
    """df on all cores where its scan gives fewer partitions, as a small file does; at scale the scan has more and nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def txns(spark: SparkSession, sf: str, wide: bool = False, columns: dict[str, str] = _BASE) -> DataFrame:
    """wide: for expressions that cost more than a shuffle of the rows."""
    base = _base(spark, sf, columns)
    return migrate((dealt(base) if wide else base).selectExpr(_expr(TXN)).withColumn("amount", F.col("amount").cast(MONEY)), "transactions")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return migrate(spark.read.parquet(f"{sf}/customer.parquet").selectExpr(_expr(ACCOUNT)), "accounts")


def statement_table(spark: SparkSession, sf: str) -> DataFrame:
    return migrate(_base(spark, sf).selectExpr(_expr(STATEMENT_OF)).distinct(), "statements")


class Keeper:
    """Writes tables to the shared folder of spark.checkpoint.dir, to cut lineage; drop deletes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = f"file://{tempfile.mkdtemp(prefix='coinloom-')}"
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.root = spark, f"{base}/kept-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        with without_leftovers(self.spark):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def keeper(spark: SparkSession) -> Keeper:
    return Keeper(spark)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _double(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("double") for n in names}


# History

_COUNTS = "SELECT account_id, count(*) FILTER (WHERE NOT is_deleted AND superseded_by IS NULL) AS live, count(*) AS every_row FROM txns GROUP BY account_id"


@query(_WITH + f"SELECT a.id, a.name, a.account_seq, coalesce(live, 0) AS live_count, coalesce(live, 0) = 0 AND coalesce(every_row, 0) > 0 AS has_only_excluded_rows FROM accounts a LEFT JOIN ({_COUNTS}) c ON a.id = c.account_id")
def account_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return history.account_summaries(txns(spark, sf), accounts(spark, sf))


@query(_WITH + "SELECT count(*) AS uncategorized FROM live WHERE category_id IS NULL AND categorised_by IS NULL")
def uncategorized_count(spark: SparkSession, sf: str) -> DataFrame:
    return history.uncategorized_count(txns(spark, sf))


@query(_WITH + "SELECT statement_id, count(*) AS live_rows FROM live WHERE statement_id IS NOT NULL GROUP BY statement_id")
def live_rows_of_statement(spark: SparkSession, sf: str) -> DataFrame:
    return history.live_rows_of_statement(txns(spark, sf))


@query(_WITH + "SELECT id, name, bank_code, is_credit_card, account_seq FROM accounts")
def list_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return history.list_accounts(accounts(spark, sf)).select("id", "name", "bank_code", "is_credit_card", "account_seq")


@query(_WITH + "SELECT id, txn_seq, is_deleted, superseded_by FROM txns WHERE account_id = 'a7'")
def list_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return history.list_transactions(txns(spark, sf), "a7").select("id", "txn_seq", "is_deleted", "superseded_by")


@query(_WITH + "SELECT id, statement_seq, period_end, needs_review, source FROM statements WHERE account_id = 'a7'")
def list_statements(spark: SparkSession, sf: str) -> DataFrame:
    return history.list_statements(statement_table(spark, sf), "a7").select("id", "statement_seq", "period_end", "needs_review", "source")


def _history(spark: SparkSession, sf: str, unanswered: bool = False) -> DataFrame:
    rows = history.history_rows(txns(spark, sf), accounts(spark, sf), default_categories(spark), unanswered)
    return rows.withColumns(_double("amount"))


_ROWS = "SELECT l.id, l.account_id, a.name AS account_name, a.account_seq, l.txn_seq, l.date, cast(l.amount AS double) AS amount, l.direction FROM live l JOIN accounts a ON a.id = l.account_id"
_SHOWN = ("id", "account_id", "account_name", "account_seq", "txn_seq", "date", "amount", "direction")
_ORDER = "ORDER BY date DESC, account_seq, txn_seq"


@query(_WITH + f"{_ROWS} {_ORDER} LIMIT 50")
def history_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return history.page(_history(spark, sf), 50).rows.select(*_SHOWN)


@query(_WITH + f"{_ROWS} {_ORDER} LIMIT 50 OFFSET 100")
def history_third_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page, reached by two cursors."""
    rows, keep, cursor = _history(spark, sf), keeper(spark), None
    for i in range(2):
        cursor = keep(history.page(rows, 50, cursor=cursor).cursor, f"cursor{i}")
    return history.page(rows, 50, cursor=cursor).rows.select(*_SHOWN)


def _files(spark: SparkSession, sf: str) -> tuple[HistoryFiles, DataFrame]:
    of = accounts(spark, sf)
    return HistoryFiles(spark, f"{keeper(spark).root}/history").write(txns(spark, sf), of), of


@query(_WITH + f"{_ROWS} {_ORDER} LIMIT 50 OFFSET 100")
def history_page_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of a history in sorted files, reached by two cursors; each page reads the newest months that hold it."""
    (files, of), keep, cursor = _files(spark, sf), keeper(spark), None
    for i in range(2):
        cursor = keep(files.page(50, cursor=cursor).cursor, f"cursor{i}")
    return with_names(files.page(50, cursor=cursor).rows, of).withColumns(_double("amount")).select(*_SHOWN)


@query(_WITH + f"{_ROWS} WHERE l.account_id = 'a7' AND l.category_id IS NULL AND l.categorised_by IS NULL {_ORDER} LIMIT 200")
def history_worklist_of_files(spark: SparkSession, sf: str) -> DataFrame:
    files, of = _files(spark, sf)
    return with_names(files.page(1000, "a7", unanswered_only=True).rows, of).withColumns(_double("amount")).select(*_SHOWN)


@query(_WITH + f"{_ROWS} WHERE l.account_id = 'nobody'")
def history_of_unknown_account(spark: SparkSession, sf: str) -> DataFrame:
    """An account that doesn't exist has an empty page."""
    return history.page(_history(spark, sf), 50, account_id="nobody").rows.select(*_SHOWN)


_CORRECTED = "coalesce(id = first_id, false)"


@query(_WITH + f", first AS (SELECT min(id) AS first_id FROM live WHERE account_id = 'a7') SELECT id, CASE WHEN {_CORRECTED} THEN 'TRAVEL' ELSE category_id END AS category_id, CASE WHEN {_CORRECTED} THEN 'PERSON' ELSE categorised_by END AS categorised_by FROM txns, first")
def set_transaction_category(spark: SparkSession, sf: str) -> DataFrame:
    """A person's correction of one row."""
    rows = txns(spark, sf)
    first = rows.where(live() & (F.col("account_id") == "a7")).agg(F.min("id")).first()[0]
    out, *_ = memory.set_transaction_category(rows, spark.createDataFrame([], TABLES["merchant_memory"]), first, "TRAVEL", True)
    return out.select("id", "category_id", "categorised_by")


@query(_WITH + f"{_ROWS} WHERE l.account_id = 'a7' AND l.category_id IS NULL AND l.categorised_by IS NULL {_ORDER} LIMIT 200")
def history_account_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return history.page(_history(spark, sf, True), 1000, account_id="a7").rows.select(*_SHOWN)


@query(_WITH + f"{_ROWS} WHERE l.category_id IS NULL AND l.categorised_by IS NULL {_ORDER} LIMIT 200")
def history_clamped_page(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the worklist of all accounts; a thousand are asked for."""
    return history.page(_history(spark, sf, True), 1000).rows.select(*_SHOWN)


@query(_WITH + "SELECT date, count(*) AS n, string_agg(id, ',' ORDER BY account_seq, txn_seq) AS ids FROM (SELECT l.*, a.account_seq FROM live l JOIN accounts a ON a.id = l.account_id) GROUP BY date")
def history_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """The whole history, by date."""
    return history.by_date(_history(spark, sf)).withColumn("ids", F.array_join("ids", ","))


@query(_WITH + "SELECT account_id, cast(sum(CASE WHEN direction = 'Debit' THEN -amount ELSE amount END) AS double) AS net FROM live GROUP BY account_id")
def signed_totals(spark: SparkSession, sf: str) -> DataFrame:
    return txns(spark, sf).where(live()).groupBy("account_id").agg(F.sum(signed_amount()).cast("double").alias("net"))


# Imports

_FAMILY = ("owner", "bank_code", "is_credit_card")
#: Statements and accounts of few owners, many of whose accounts can't be told apart by what a statement says.
_ASKED = {
    "arrival": "o_orderkey",
    "owner": "concat('p', cast(cast(floor(o_custkey / 10) as bigint) as string))",
    "bank_code": _case("cast(floor(o_totalprice) as bigint) % 3", ("ICICI", "HDFC", "SBI")),
    "is_credit_card": "cast(floor(o_totalprice / 3) as bigint) % 2 = 0",
    "last4": "CASE cast(floor(o_totalprice / 6) as bigint) % 8 WHEN 6 THEN lpad(cast(cast(floor(o_totalprice) as bigint) % 10000 as string), 4, '0') WHEN 7 THEN NULL ELSE lpad(cast(cast(floor(o_totalprice / 6) as bigint) % 8 as string), 4, '0') END",
}
_HELD = {
    "id": "concat('a', cast(c_custkey as string))",
    "owner": "concat('p', cast(cast(floor(c_custkey / 10) as bigint) as string))",
    "bank_code": _case("cast(c_nationkey % 3 as int)", ("ICICI", "HDFC", "SBI")),
    "is_credit_card": "c_nationkey % 2 = 0",
    "last4": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(cast(c_custkey % 5 as string), 4, '0') END",
}
_GROUP = ", ".join(_FAMILY)
#: A walk: every family's statements in order, with a list of its accounts as it is by then.
_WALK = f"""WITH RECURSIVE asked AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY arrival) AS k FROM ({_sql(_ASKED, 'orders')})),
held AS (SELECT {_GROUP}, list({{'id': id, 'last4': last4}} ORDER BY id) AS own FROM ({_sql(_HELD, 'customer')}) GROUP BY ALL),
walk AS (
SELECT {', '.join(f'a.{c}' for c in _FAMILY)}, cast(0 AS bigint) AS k, coalesce(own, []) AS own, cast(NULL AS bigint) AS arrival, '' AS action, cast(NULL AS varchar) AS account, false AS fills
FROM (SELECT DISTINCT {_GROUP} FROM asked) a LEFT JOIN held h USING ({_GROUP})
UNION ALL
SELECT {_GROUP}, k, CASE WHEN action = 'CREATE' THEN list_append(own, {{'id': account, 'last4': last4}}) WHEN fills THEN list_transform(own, lambda x: CASE WHEN x.last4 IS NULL THEN {{'id': x.id, 'last4': last4}} ELSE x END) ELSE own END,
arrival, action, account, fills FROM (
SELECT *, CASE action WHEN 'CREATE' THEN concat('by ', arrival) WHEN 'ATTACH' THEN CASE WHEN last4 IS NULL THEN own[1].id WHEN fills THEN blank[1].id ELSE same[1].id END END AS account FROM (
SELECT *, last4 IS NOT NULL AND len(same) = 0 AND len(blank) = 1 AS fills,
CASE WHEN last4 IS NULL THEN CASE WHEN len(own) = 1 THEN 'ATTACH' ELSE 'ASK' END WHEN len(same) = 1 OR (len(same) = 0 AND len(blank) = 1) THEN 'ATTACH' WHEN len(same) = 0 AND len(blank) = 0 THEN 'CREATE' ELSE 'ASK' END AS action FROM (
SELECT {', '.join(f'w.{c}' for c in _FAMILY)}, a.k, a.arrival, a.last4, w.own, list_filter(w.own, lambda x: x.last4 = a.last4) AS same, list_filter(w.own, lambda x: x.last4 IS NULL) AS blank
FROM walk w JOIN asked a ON {' AND '.join(f'a.{c} = w.{c}' for c in _FAMILY)} AND a.k = w.k + 1))))
"""


@query(_WALK + "SELECT arrival, action, account, fills FROM walk WHERE k > 0")
def resolved_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """The account of each statement of a batch, held against a walk of its owner's statements in order."""
    asked, held = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(_expr(_ASKED)), spark.read.parquet(f"{sf}/customer.parquet").selectExpr(_expr(_HELD))
    out = resolution.resolve_accounts(asked, held, "owner")
    return out.select("arrival", "action", F.coalesce(F.concat(F.lit("by "), "created_by"), "account_id").alias("account"), "fills")


#: Each statement comes three times: whole, in part, and whole once more.
_ARRIVAL = f"copies * 1000000000 + cast({_MONTH} as bigint) * 10000000 + acct"
_TIMES = f"SELECT {_ARRIVAL} AS arrival, copies, acct, count(*) AS n FROM base, (SELECT unnest([0, 1, 2]) AS copies) WHERE copies <> 1 OR m % 3 <> 0 GROUP BY ALL"


@query(
    _WITH + f", times AS ({_TIMES}) SELECT arrival, CASE WHEN arrival = min(arrival) OVER (PARTITION BY acct) THEN 'CREATE' ELSE 'ATTACH' END AS action, n AS rows_read, CASE WHEN copies = 0 THEN n ELSE 0 END AS transactions_added, "
    "CASE WHEN copies = 0 THEN 0 ELSE n END AS rows_superseded, CASE WHEN copies = 0 THEN 0 ELSE n END AS duplicates_linked FROM times"
)
def import_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All statements of all owners in one batch, each three times; only the first brings anything new."""
    rows = _base(spark, sf).withColumn("copies", F.explode(F.array(*(F.lit(x).cast("long") for x in range(3))))).where("copies <> 1 OR m % 3 <> 0")
    row = F.struct(F.col("m").alias("line_index"), *(F.expr(TXN[c]).alias(n) for n, c in (("value_date", "date"), ("amount", "amount"), ("direction", "direction"), ("currency", "currency"), ("description_raw", "description_raw"))))
    batch = rows.select(F.expr(_ARRIVAL).alias("arrival"), F.col("acct").cast("string").alias("owner"), row.alias("row")).groupBy("arrival", "owner").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    ends = F.transform("rows", lambda r: r["value_date"])
    batch = batch.select(
        "arrival", "owner", F.lit("HDFC").alias("bank_code"), F.lit(False).alias("is_credit_card"), F.lit("0000").alias("last4"), F.lit("Savings").alias("name"), F.array_min(ends).alias("period_start"),
        F.array_max(ends).alias("period_end"), F.lit(False).alias("needs_review"), F.lit("Statement").alias("source"), "rows",
    )
    keep = keeper(spark)
    done = bulk.import_batch(Store(spark, f"{keep.root}/store").create(), batch, "2025-11-30", keep)
    return done.select("arrival", "action", "rows_read", "transactions_added", "rows_superseded", "duplicates_linked")


# Coverage

_COVERAGE = f"""
, months AS (SELECT a.id AS account_id, m.month FROM accounts a, (SELECT unnest(generate_series(date_trunc('month', DATE '{TODAY}') - INTERVAL 23 MONTH, date_trunc('month', DATE '{TODAY}'), INTERVAL 1 MONTH)) AS month) m),
by_row AS (SELECT t.account_id, date_trunc('month', t.date) AS month, bool_or(coalesce(s.source = 'Statement', false)) AS has_full FROM txns t LEFT JOIN statements s ON t.statement_id = s.id WHERE NOT t.is_deleted GROUP BY 1, 2),
by_statement AS (SELECT account_id, date_trunc('month', period_end) AS month, bool_or(needs_review) AS review FROM statements GROUP BY 1, 2)
SELECT m.account_id, strftime(m.month, '%Y-%m') AS month, CASE WHEN review IS NOT NULL OR coalesce(has_full, false) THEN 'COVERED' WHEN has_full IS NOT NULL THEN 'PARTIAL' ELSE 'GAP' END AS state, coalesce(review, false) AS needs_review
FROM months m LEFT JOIN by_row r ON r.account_id = m.account_id AND r.month = m.month LEFT JOIN by_statement s ON s.account_id = m.account_id AND s.month = m.month"""


@query(_WITH + _COVERAGE)
def coverage_map(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage(accounts(spark, sf), statement_table(spark, sf), txns(spark, sf), TODAY)


# Narrations

_PREFIX = r"(?i)^((POS\s|UPI[-/]|NEFT/|IMPS/|ACH/|BIL/|RTGS/|INT\.PD\./|TO TRANSFER-|BY TRANSFER-)\s*)+"


def _norm_sql(x: str) -> str:
    out = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    out = f"regexp_replace({out}, '{_PREFIX}', '')"
    out = f"regexp_replace({out}, '(?i)\\bRRN[0-9]+\\b', '', 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\b[0-9]{{10,16}}\\b\\s*$', '')"
    return f"trim(lower({out}))"


_STOPS = ", ".join(f"'{w}'" for w in nr.STOP_WORDS)


def _portion_sql(x: str) -> str:
    useful = f"list_filter(regexp_split_to_array({_norm_sql(x)}, '[\\s\\-/\\\\|*:;,#_%()\\[\\]\"'']'), lambda s: length(s) > 1 AND NOT regexp_full_match(s, '[0-9]+') AND length(regexp_replace(s, '[^0-9]', '', 'g')) < 4 AND s NOT IN ({_STOPS}))"
    return f"nullif(array_to_string(({useful})[1:2], ' '), '')"


@query(_WITH + f"SELECT id, {_norm_sql('description_raw')} AS norm, left({_norm_sql('description_raw')}, 60) AS prefix FROM txns")
def normalize_narration(spark: SparkSession, sf: str) -> DataFrame:
    norm = nr.normalize_narration(F.col("description_raw"))
    return txns(spark, sf, wide=True).select("id", norm.alias("norm"), nr.prefix60(norm).alias("prefix"))


@query(f"SELECT doc_id, md5({_norm_sql('text')}) AS norm_md5 FROM documents")
def normalize_long_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(nr.normalize_narration(F.col("text"))).alias("norm_md5"))


@query(_WITH + f"SELECT id, {_portion_sql('description_raw')} AS portion FROM txns")
def merchant_portion(spark: SparkSession, sf: str) -> DataFrame:
    return txns(spark, sf, wide=True).select("id", nr.merchant_portion(F.col("description_raw")).alias("portion"))


@query(_WITH + "SELECT id, upper(trim(regexp_replace(description_raw, '\\s+', ' ', 'g'))) AS description, concat(strftime(date, '%Y-%m-%d'), '|', regexp_replace(cast(amount AS varchar), '\\.?0+$', ''), '|', upper(trim(regexp_replace(description_raw, '\\s+', ' ', 'g'))), '|', direction) AS fingerprint FROM txns")
def dedup_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("description_raw")
    return txns(spark, sf).select("id", nr.normalize_description(text).alias("description"), nr.dedup_fingerprint(F.col("date"), F.col("amount"), text, F.col("direction")).alias("fingerprint"))


# Duplicates and transfers

_NORM = _norm_sql("description_raw")
_KINDS = f", kinds AS (SELECT l.*, a.is_credit_card, a.account_seq, {_NORM} AS norm FROM live l JOIN accounts a ON a.id = l.account_id)"
_SAME = "e.date = i.date AND left(e.norm, 60) = left(i.norm, 60)"
_NEAR = "e.amount = i.amount AND e.direction = i.direction AND abs(date_diff('day', e.date, i.date)) <= 1"


def _greedy(candidates: str, block: str, turn: str, also: str = "") -> str:
    """CTE chosen(incoming_id, existing_id): in order, each takes its first candidate that is not gone.

    candidates: incoming_id, existing_id, liking, and what block and turn read. Blocks are
    independent and walked side by side, a step of each at a time. also: what else is gone once a row took one.
    """
    return (
        f", cands AS ({candidates}), steps AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY turn, incoming_id) AS k, incoming_id, likes FROM "
        f"(SELECT {block} AS block, {turn} AS turn, incoming_id, list(existing_id ORDER BY liking) AS likes FROM cands GROUP BY ALL)), "
        "walk AS (SELECT DISTINCT block, cast(0 AS bigint) AS k, cast([] AS varchar[]) AS gone, cast(NULL AS varchar) AS incoming_id, cast(NULL AS varchar) AS existing_id FROM steps "
        f"UNION ALL SELECT block, k, CASE WHEN pick IS NULL THEN gone ELSE list_concat(gone, [pick{also}]) END, incoming_id, pick FROM "
        "(SELECT s.block, s.k, w.gone, s.incoming_id, list_filter(s.likes, lambda c: NOT list_contains(w.gone, c))[1] AS pick FROM walk w JOIN steps s ON s.block = w.block AND s.k = w.k + 1)), "
        "chosen AS (SELECT incoming_id, existing_id FROM walk WHERE existing_id IS NOT NULL) "
    )


def _linked_sql(sides: str, turn: str, liking: str, scope: str = "", also: str = "") -> str:
    """Links of matching rows i to e, in order."""
    pairs = (
        f"SELECT i.id AS incoming_id, e.id AS existing_id, concat({scope}i.amount, i.direction) AS block_of, {turn} AS turn_of, {liking} AS liking, CASE WHEN {_SAME} THEN 'CANONICAL' ELSE 'FUZZY' END AS layer "
        f"FROM kinds e JOIN kinds i ON {_NEAR} AND {sides} WHERE ({_SAME}) OR jaro_winkler_similarity(e.norm, i.norm) >= 0.92"
    )
    return _greedy(pairs, "block_of", "turn_of", also) + ", links AS (SELECT c.incoming_id, c.existing_id, p.layer FROM chosen c JOIN cands p ON p.incoming_id = c.incoming_id AND p.existing_id = c.existing_id) "


_ACROSS = _KINDS + _linked_sql("NOT e.is_credit_card AND i.is_credit_card", "i.txn_seq", f"CASE WHEN {_SAME} THEN 0 ELSE 1 END * 1e12 + e.txn_seq")
_FOUND = _KINDS + _linked_sql(
    "e.is_credit_card <> i.is_credit_card AND e.account_seq < i.account_seq", "(i.account_seq, i.txn_seq)", f"(CASE WHEN {_SAME} THEN 0 ELSE 1 END, e.account_seq, e.txn_seq)", also=", incoming_id"
)


def _bank_and_card(spark: SparkSession, sf: str, columns: dict[str, str] = _BASE) -> tuple[DataFrame, DataFrame]:
    of = accounts(spark, sf).select(F.col("id").alias("account_id"), "is_credit_card")
    rows = txns(spark, sf, True, columns).where(live()).join(of, "account_id").withColumn("seq", F.col("txn_seq"))
    return rows.where("not is_credit_card"), rows.where("is_credit_card")


@query(_WITH_CROWDED + _KINDS + f", pairs AS (SELECT e.id AS existing_id, i.id AS incoming_id, {_SAME} AS same, jaro_winkler_similarity(e.norm, i.norm) AS likeness FROM kinds e JOIN kinds i ON NOT e.is_credit_card AND i.is_credit_card AND {_NEAR}) SELECT existing_id, incoming_id, CASE WHEN same THEN 'CANONICAL' ELSE 'FUZZY' END AS layer FROM pairs WHERE same OR likeness >= 0.92")
def duplicate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.candidate_pairs(*_bank_and_card(spark, sf, _CROWDED)).select("existing_id", "incoming_id", "layer")


@query(_WITH + _ACROSS + "SELECT * FROM links")
def cross_source_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.cross_source_duplicates(*_bank_and_card(spark, sf), keeper(spark))


@query(_WITH + _FOUND + "SELECT * FROM links")
def find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.find_duplicates(txns(spark, sf), accounts(spark, sf), keeper(spark))


#: Twelve accounts in a row belong to one person.
_OWNER = "concat('p', cast(cast(floor(account_seq / 12) as bigint) as string))"
_OWNED = _KINDS.replace("SELECT l.*,", f"SELECT l.*, {_OWNER} AS owner,") + _linked_sql(
    "e.is_credit_card <> i.is_credit_card AND e.account_seq < i.account_seq AND e.owner = i.owner", "(i.account_seq, i.txn_seq)", f"(CASE WHEN {_SAME} THEN 0 ELSE 1 END, e.account_seq, e.txn_seq)", scope="i.owner, '|', ", also=", incoming_id"
)


@query(_WITH + _OWNED + "SELECT * FROM links")
def find_duplicates_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Links among the accounts of one person alone."""
    return dedup.find_duplicates(txns(spark, sf), accounts(spark, sf).withColumn("owner", F.expr(_OWNER)), keeper(spark), owner="owner")


@query(_WITH + _FOUND + "SELECT t.id, coalesce(t.superseded_by, l.existing_id) AS superseded_by, l.layer AS dedup_layer FROM txns t LEFT JOIN links l ON l.incoming_id = t.id")
def link_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """transactions after the links are written."""
    rows, keep = txns(spark, sf), keeper(spark)
    return dedup.link(rows, dedup.find_duplicates(rows, accounts(spark, sf), keep)).select("id", "superseded_by", "dedup_layer")


@query(_WITH + _FOUND + "SELECT count(*) AS duplicates_linked, count(*) FILTER (WHERE layer = 'CANONICAL') AS canonical, count(*) FILTER (WHERE layer = 'FUZZY') AS fuzzy FROM links")
def duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.summary(dedup.find_duplicates(txns(spark, sf), accounts(spark, sf), keeper(spark)))


_AGAIN = "acct % 10 = 7 AND o_orderkey % 4 <> 0"
_REIMPORT = (
    f", every AS (SELECT id, account_id, txn_seq, date, amount, direction, description_raw, is_deleted, superseded_by, false AS again FROM txns UNION ALL SELECT concat('again-', id), account_id, txn_seq + 1000000000, date, amount, direction, description_raw, is_deleted, superseded_by, true FROM ({_sql(TXN, 'base', _AGAIN)})), "
    f"kinds AS (SELECT *, {_NORM} AS norm FROM every WHERE NOT is_deleted AND superseded_by IS NULL)"
    + _linked_sql("e.account_id = i.account_id AND i.again AND NOT e.again", "i.txn_seq", f"CASE WHEN {_SAME} THEN 0 ELSE 1 END * 1e12 + e.txn_seq", scope="i.account_id, '|', ")
)


@query(_WITH + _REIMPORT + "SELECT * FROM links WHERE layer = 'CANONICAL'")
def reimported_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The statements of each tenth account imported again: their rows link to those that were there."""
    rows = txns(spark, sf)
    again = migrate(_base(spark, sf).where(_AGAIN).selectExpr(_expr(TXN)).withColumn("amount", F.col("amount").cast(MONEY)), "transactions")
    again = again.withColumns({"id": F.concat(F.lit("again-"), "id"), "statement_id": F.concat(F.lit("again-"), "statement_id"), "txn_seq": F.col("txn_seq") + 10**9})
    return dedup.reimported_rows(rows.unionByName(again), again.select("statement_id"), keeper(spark))


def _transfer_rows(spark: SparkSession, sf: str, columns: dict[str, str] = _BASE) -> DataFrame:
    of = accounts(spark, sf).select(F.col("id").alias("account_id"), "is_credit_card", F.expr(_OWNER).alias("owner"))
    return txns(spark, sf, columns=columns).where("not is_deleted and transfer_group_id is null").join(of, "account_id")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}.description_raw), '\\s+'), lambda t: t <> ''))"
_SIMILAR = f"(len(list_intersect({_TOKENS.format('o')}, {_TOKENS.format('i')})) / len(list_distinct(list_concat({_TOKENS.format('o')}, {_TOKENS.format('i')}))))"
_BAND = (
    f", rows AS (SELECT t.*, a.is_credit_card, {_OWNER} AS owner FROM txns t JOIN accounts a ON a.id = t.account_id WHERE NOT is_deleted AND transfer_group_id IS NULL), "
    f"band AS (SELECT o.id AS outflow_id, i.id AS inflow_id, o.date AS o_date, o.amount AS o_amount, o.is_credit_card OR i.is_credit_card AS is_credit_card_payment, abs(date_diff('day', o.date, i.date)) AS days, abs(o.amount - i.amount) AS difference, {_SIMILAR} AS similarity "
    "FROM rows o JOIN rows i ON o.direction = 'Debit' AND i.direction = 'Credit' AND o.account_id <> i.account_id AND abs(date_diff('day', o.date, i.date)) <= 1 AND abs(o.amount - i.amount) <= 1), "
    "scored AS (SELECT *, round(greatest(1.0 - 0.2 * days - 0.2 * cast(difference AS double) + 0.2 * similarity, 0.0), 9) AS score FROM band)"
)
_RUNS = (
    ", runs AS (SELECT id, sum(CASE WHEN amount - before <= 1 THEN 0 ELSE 1 END) OVER (ORDER BY amount, id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT id, amount, lag(amount) OVER (ORDER BY amount, id) AS before FROM rows))"
    + _greedy(
        "SELECT outflow_id AS incoming_id, inflow_id AS existing_id, run, o_date, (days, difference, -similarity, inflow_id) AS liking FROM scored JOIN runs ON runs.id = outflow_id", "run", "(o_date, incoming_id)"
    )
    + ", pairs AS (SELECT s.outflow_id, s.inflow_id, s.is_credit_card_payment, s.score FROM chosen c JOIN scored s ON s.outflow_id = c.incoming_id AND s.inflow_id = c.existing_id) "
)


_OWNERS = " AND o.owner = i.owner AND abs(o.amount - i.amount) <= 1)"


@query(_WITH + _BAND.replace(" AND abs(o.amount - i.amount) <= 1)", _OWNERS) + _RUNS + "SELECT * FROM pairs")
def detect_transfers_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs among the accounts of one person alone."""
    return transfers.detect_transfers(_transfer_rows(spark, sf), keeper(spark), scope="owner").withColumn("score", F.round("score", 9))


@query(_WITH_CROWDED + _BAND + " SELECT outflow_id, inflow_id, is_credit_card_payment, score FROM scored")
def transfer_candidates(spark: SparkSession, sf: str) -> DataFrame:
    pairs = transfers.candidate_pairs(_transfer_rows(spark, sf, _CROWDED))
    return pairs.select("outflow_id", "inflow_id", "is_credit_card_payment", F.round("score", 9).alias("score"))


@query(_WITH + _BAND + _RUNS + "SELECT * FROM pairs")
def detect_transfers(spark: SparkSession, sf: str) -> DataFrame:
    return transfers.detect_transfers(_transfer_rows(spark, sf), keeper(spark)).withColumn("score", F.round("score", 9))


@query(
    _WITH + _BAND + _RUNS + ", legs AS (SELECT outflow_id AS id, outflow_id, inflow_id, is_credit_card_payment AS card FROM pairs UNION ALL SELECT inflow_id, outflow_id, inflow_id, is_credit_card_payment FROM pairs), "
    "done AS (SELECT t.*, l.card, sha256(concat(l.outflow_id, '|', l.inflow_id)) AS new_group, l.id IS NOT NULL AND t.transfer_group_id IS NULL AND (t.categorised_by IS NULL OR t.categorised_by NOT IN ('PERSON', 'PERSON_MEMORY')) AS hit FROM txns t LEFT JOIN legs l ON l.id = t.id) "
    "SELECT id, is_transfer OR hit AS is_transfer, CASE WHEN hit THEN new_group ELSE transfer_group_id END AS transfer_group_id, CASE WHEN NOT hit THEN category_id WHEN card THEN 'CREDIT_CARD_BILL_PAYMENT' ELSE 'SELF_TRANSFER' END AS category_id, CASE WHEN hit THEN 'TRANSFER_DETECTOR' ELSE categorised_by END AS categorised_by FROM done"
)
def link_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """transactions after the pairs are written."""
    pairs = transfers.detect_transfers(_transfer_rows(spark, sf), keeper(spark))
    return transfers.link_transfers(txns(spark, sf), pairs).select("id", "is_transfer", "transfer_group_id", "category_id", "categorised_by")


@query(_WITH + _BAND + _RUNS + "SELECT count(*) AS pairs_linked, count(*) FILTER (WHERE is_credit_card_payment) AS credit_card_payments FROM pairs")
def transfer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return transfers.summary(transfers.detect_transfers(_transfer_rows(spark, sf), keeper(spark)))


# Categories

_MERCHANT_ROWS = [(1, 10, "LITERAL", "Green Grocer", "GROCERIES"), (2, 5, "REGEX", "orbit\\s+cine", "ENTERTAINMENT"), (3, 20, "REGEX", "broken(", "FUEL"), (4, 20, "LITERAL", "nova", "FUEL")]
_RULE_ROWS = [("r1", 1, 50, True, "KEYWORD", "pharmacy", "HEALTH_AND_MEDICAL"), ("r2", 2, 50, False, "REGEX", "PHARM.CY", "SHOPPING"), ("r3", 3, 60, True, "AMOUNT_RANGE", "1000.00, 2500.00", "TRANSPORT"), ("r4", 4, 1, True, "AMOUNT_RANGE", "ten", "RENT_EMI")]
_SOURCE_ROWS = [(1, "ICICI", "FOOD", "FOOD_AND_DINING"), (2, "ICICI", "FOOD", "TRAVEL")]


def _category_facts(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(_MERCHANT_ROWS, TABLES["merchant_map"]), spark.createDataFrame(_RULE_ROWS, TABLES["rules"]), spark.createDataFrame(_SOURCE_ROWS, TABLES["source_category_map"])


def _like_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_CARD_RULE = (
    f"CASE WHEN is_credit_card AND direction = 'Credit' THEN CASE WHEN regexp_matches(lower(description_raw), '^\\s*[0-9]+(\\.[0-9]+)?\\s*%') OR {_like_any('lower(description_raw)', cat.REFUND_WORDS)} THEN 'CASHBACKS_AND_REFUNDS' "
    f"WHEN {_like_any('lower(description_raw)', cat.PAYMENT_WORDS)} THEN 'CREDIT_CARD_BILL_PAYMENT' END "
    "WHEN NOT is_credit_card AND direction = 'Debit' AND regexp_matches(description_raw, '(?i)\\b(PAYMENTS?|AUTOPAY|AUTO\\s+PAY|BBPS|BPAY|PMT)\\b') AND regexp_matches(description_raw, '(?i)\\b(CREDIT\\s+CARD|CC|CARD)\\b') "
    "AND NOT regexp_matches(description_raw, '(?i)\\b(EMI|FEES?)\\b') THEN 'CREDIT_CARD_BILL_PAYMENT' END"
)
_STAGED = (
    f", facts AS (SELECT t.*, a.bank_code, a.is_credit_card, {_norm_sql('t.description_raw')} AS norm FROM txns t JOIN accounts a ON a.id = t.account_id), "
    f"staged AS (SELECT *, {_CARD_RULE} AS t0, CASE WHEN bank_code = 'ICICI' AND source_category = 'FOOD' THEN 'FOOD_AND_DINING' END AS t1, "
    "CASE WHEN regexp_matches(norm, 'orbit\\s+cine') THEN 'ENTERTAINMENT' WHEN contains(norm, 'green grocer') THEN 'GROCERIES' WHEN contains(norm, 'nova') THEN 'FUEL' END AS t2, "
    "CASE WHEN regexp_matches(description_raw, '(?i)PHARM.CY') THEN 'SHOPPING' WHEN contains(lower(description_raw), 'pharmacy') THEN 'HEALTH_AND_MEDICAL' WHEN amount BETWEEN 1000 AND 2500 THEN 'TRANSPORT' END AS t3, "
    "CASE WHEN regexp_matches(description_raw, '(?i)PHARM.CY') THEN 'r2' WHEN contains(lower(description_raw), 'pharmacy') THEN 'r1' WHEN amount BETWEEN 1000 AND 2500 THEN 'r3' END AS rule FROM facts) "
)
_STAGE = "CASE WHEN t0 IS NOT NULL THEN 'CC_RULE' WHEN t1 IS NOT NULL THEN 'T1_SOURCE_CATEGORY' WHEN t2 IS NOT NULL THEN 'T2_MERCHANT_MAP' WHEN t3 IS NOT NULL THEN 'T3_RULE' END"


@query(_WITH + _STAGED + f"SELECT id, coalesce(t0, t1, t2, t3) AS category_ref, {_STAGE} AS stage, CASE WHEN t0 IS NULL AND t1 IS NULL AND t2 IS NULL THEN rule END AS matched_rule_id FROM staged")
def categorize(spark: SparkSession, sf: str) -> DataFrame:
    of = accounts(spark, sf).select(F.col("id").alias("account_id"), "bank_code", "is_credit_card")
    return cat.categorize(txns(spark, sf, wide=True).join(of, "account_id"), *_category_facts(spark)).select("id", "category_ref", "stage", "matched_rule_id")


_MEMORY = [("river books", "EDUCATION"), ("corner bakery", "FOOD_AND_DINING")]
#: A catalog whose built-in category for bill payments has another id, a person's category of a default's name, and a rule that names no category.
_CATALOG = [("CARD_BILL", "credit card bill payment", "CC_PAYMENT", True), ("MINE", "Cashbacks & Refunds", "REFUND", False)]
_LOST_RULE = ("r5", 5, 0, False, "KEYWORD", "metro", "NOWHERE")


def _catalog(spark: SparkSession) -> DataFrame:
    own = spark.createDataFrame(_CATALOG, TABLES["categories"])
    return default_categories(spark).where("id <> 'CREDIT_CARD_BILL_PAYMENT'").unionByName(own)


_REMEMBERED = f"CASE {_portion_sql('description_raw')} WHEN 'river books' THEN 'EDUCATION' WHEN 'corner bakery' THEN 'FOOD_AND_DINING' END"
_MAY = "NOT is_deleted AND superseded_by IS NULL AND NOT is_transfer AND (categorised_by IS NULL OR categorised_by NOT IN ('PERSON', 'PERSON_MEMORY'))"


@query(_WITH + _STAGED + f", known AS (SELECT *, {_REMEMBERED} AS remembered, {_MAY} AS may FROM staged) SELECT id, CASE WHEN may THEN coalesce(remembered, CASE t0 WHEN 'CREDIT_CARD_BILL_PAYMENT' THEN 'CARD_BILL' ELSE t0 END, t1, t2, t3) ELSE category_id END AS category_id, CASE WHEN may THEN CASE WHEN remembered IS NOT NULL THEN 'PERSON_MEMORY' ELSE {_STAGE} END ELSE categorised_by END AS categorised_by FROM known")
def categorize_stored(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("id", "category_id", "categorised_by")


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame(_MEMORY, TABLES["merchant_memory"])
    merchants, rules, source_map = _category_facts(spark)
    rules = rules.unionByName(spark.createDataFrame([_LOST_RULE], TABLES["rules"]))
    return cat.categorize_stored(txns(spark, sf, wide=True), accounts(spark, sf), merchants, rules, source_map, known, _catalog(spark))


@query(_WITH + _STAGED + f", known AS (SELECT {_REMEMBERED} AS remembered, t0, t1, t2, t3 FROM staged WHERE {_MAY}) SELECT count(*) AS considered, count(coalesce(remembered, t0, t1, t2, t3)) AS categorized, count(*) - count(coalesce(remembered, t0, t1, t2, t3)) AS uncategorized FROM known")
def categorize_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cat.summary(_decided(spark, sf))


#: Rules that people wrote, one for each customer and supplier, and one that every customer's name matches. A tenth name no category.
_SEGMENT = "CASE WHEN c_custkey % 10 = 3 THEN 'NOWHERE' ELSE concat('seg-', c_mktsegment) END"
_WRITTEN = {
    "customer": {"id": "concat('rc', cast(c_custkey as string))", "rule_seq": "cast(c_custkey as bigint)", "priority": "cast(c_custkey % 7 as bigint)", "is_system": "c_custkey % 2 = 0", "match_type": "'KEYWORD'", "value": "c_name", "category_id": _SEGMENT},
    "supplier": {
        "id": "concat('rs', cast(s_suppkey as string))", "rule_seq": "cast(1000000000 + s_suppkey as bigint)", "priority": "cast(s_suppkey % 5 as bigint)", "is_system": "false", "match_type": "'REGEX'",
        "value": "concat('Supplier#0+', cast(s_suppkey as string), ' (paid|due)')", "category_id": "concat('nation-', cast(s_nationkey as string))",
    },
    "region": {"id": "'ra'", "rule_seq": "cast(0 as bigint)", "priority": "cast(9 as bigint)", "is_system": "true", "match_type": "'KEYWORD'", "value": "'customer#0000'", "category_id": "'any-customer'"},
}
#: What orders say: a customer's name, a supplier's, both, or neither's.
_SAID = {
    "id": "concat('o', cast(o_orderkey as string))",
    "description_raw": (
        "CASE o_orderkey % 4 WHEN 0 THEN concat('UPI-CUSTOMER#', lpad(cast(o_custkey as string), 9, '0'), ' REF') WHEN 1 THEN concat('pos supplier#', lpad(cast(o_custkey % 97 as string), 9, '0'), CASE WHEN o_orderkey % 3 = 0 THEN ' Paid' ELSE ' open' END) "
        "WHEN 2 THEN concat('Customer#', lpad(cast(o_custkey as string), 9, '0'), ' to Supplier#', lpad(cast(o_orderkey % 89 as string), 9, '0'), ' due') ELSE 'nobody' END"
    ),
    "amount": "cast(1 as decimal(38, 10))",
    "direction": "'Debit'",
    "is_credit_card": "true",
    "bank_code": "'HDFC'",
    "source_category": "cast(null as string)",
}
_WRITTEN_SQL = "written AS (" + " UNION ".join(_sql(c, t) for t, c in _WRITTEN.items()) + ")"


def _written(spark: SparkSession, sf: str) -> DataFrame:
    parts = [spark.read.parquet(f"{sf}/{t}.parquet").selectExpr(_expr(c)).distinct() for t, c in _WRITTEN.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).selectExpr(*(f"cast({c} as {k}) as {c}" for c, k in (x.split(" ", 1) for x in TABLES["rules"].split(", "))))


@query(
    f"WITH {_WRITTEN_SQL}, said AS ({_sql(_SAID, 'orders')}), hits AS (SELECT said.id, min((priority, is_system, rule_seq, category_id, written.id)) AS best FROM said JOIN written "
    "ON CASE match_type WHEN 'KEYWORD' THEN contains(lower(description_raw), lower(value)) ELSE regexp_matches(description_raw, value, 'i') END GROUP BY said.id) "
    "SELECT said.id, best[4] AS category_ref, CASE WHEN best IS NOT NULL THEN 'T3_RULE' END AS stage, best[5] AS matched_rule_id FROM said LEFT JOIN hits USING (id)"
)
def categorize_by_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each customer and supplier, matched by the automaton."""
    said = dealt(spark.read.parquet(f"{sf}/orders.parquet")).selectExpr(_expr(_SAID))
    none = [spark.createDataFrame([], TABLES[t]) for t in ("merchant_map", "source_category_map")]
    return cat.categorize(said, none[0], _written(spark, sf), none[1]).select("id", "category_ref", "stage", "matched_rule_id")


_SEGMENTS = "SELECT DISTINCT concat('seg-', c_mktsegment) AS id, lower(c_mktsegment) AS name, 'SPEND' AS classification, false AS is_builtin FROM customer"


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("concat('seg-', c_mktsegment) as id", "lower(c_mktsegment) as name", "'SPEND' as classification", "false as is_builtin").distinct()


@query(f"WITH {_WRITTEN_SQL}, categories AS ({_SEGMENTS}) SELECT w.id, w.priority, c.name AS category_name FROM written w JOIN categories c ON c.id = w.category_id")
def list_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the customers whose category is in the catalog, in the order they are tried."""
    return cat.list_rules(_written(spark, sf), _segments(spark, sf)).select("id", "priority", "category_name")


@query(f"WITH categories AS ({_SEGMENTS}), map AS (SELECT c_custkey AS id, c_custkey % 7 AS priority, c_name AS pattern, {_SEGMENT} AS category_id FROM customer) SELECT m.id, m.priority, m.pattern, c.name AS category_name FROM map m JOIN categories c ON c.id = m.category_id")
def list_merchants(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as id", "c_custkey % 7 as priority", "'LITERAL' as match_type", "c_name as pattern", f"{_SEGMENT} as category_id")
    return cat.list_merchants(rows, _segments(spark, sf)).select("id", "priority", "pattern", "category_name")


@query(f"WITH categories AS ({_SEGMENTS}), map AS (SELECT c_custkey AS id, c_name AS source_category, {_SEGMENT} AS category_id FROM customer) SELECT m.id, m.source_category, c.name AS category_name FROM map m JOIN categories c ON c.id = m.category_id")
def list_source_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as id", "'HDFC' as bank_code", "c_name as source_category", f"{_SEGMENT} as category_id")
    return cat.list_source_map(rows, _segments(spark, sf)).select("id", "source_category", "category_name")


@query(_WITH + "SELECT CASE WHEN categorised_by = 'T3_RULE' THEN 'categorised_by' ELSE 'direction' END AS column, CASE WHEN categorised_by = 'T3_RULE' THEN 'GUESS' ELSE 'Sideways' END AS value, count(*) AS n FROM txns WHERE (categorised_by = 'T3_RULE') OR (txn_seq % 19 = 0 AND categorised_by IS DISTINCT FROM 'T3_RULE') GROUP BY ALL".replace(" AS column", ' AS "column"'))
def enumeration_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Values that no enumeration has, planted in two columns."""
    guess = F.col("categorised_by") == "T3_RULE"
    way = F.when((F.col("txn_seq") % 19 == 0) & ~F.coalesce(guess, F.lit(False)), "Sideways").otherwise(F.col("direction"))
    rows = txns(spark, sf).withColumns({"direction": way, "categorised_by": F.when(guess, "GUESS").otherwise(F.col("categorised_by"))})
    return violations(rows, "transactions")


_UNLIKE = "NOT (l.categorised_by IS NOT DISTINCT FROM 'PERSON_MEMORY' AND l.category_id IS NOT DISTINCT FROM 'EDUCATION')"


@query(_WITH + f"SELECT a.id AS account_id, a.name AS display_name, count(*) AS n FROM live l JOIN accounts a ON a.id = l.account_id WHERE l.categorised_by IS DISTINCT FROM 'PERSON' AND {_UNLIKE} AND {_portion_sql('l.description_raw')} = 'river books' GROUP BY 1, 2")
def memory_preview(spark: SparkSession, sf: str) -> DataFrame:
    return memory.preview(txns(spark, sf), spark.createDataFrame(_MEMORY, TABLES["merchant_memory"]), accounts(spark, sf), "river books")


@query(_WITH + f", hit AS (SELECT *, NOT is_deleted AND superseded_by IS NULL AND categorised_by IS DISTINCT FROM 'PERSON' AND coalesce({_portion_sql('description_raw')} = 'river books', false) AS h FROM txns) SELECT id, CASE WHEN h THEN 'EDUCATION' ELSE category_id END AS category_id, CASE WHEN h THEN 'PERSON_MEMORY' ELSE categorised_by END AS categorised_by FROM hit")
def apply_memory(spark: SparkSession, sf: str) -> DataFrame:
    rows, known = txns(spark, sf), spark.createDataFrame(_MEMORY, TABLES["merchant_memory"])
    shown = memory.affected(rows, known, "river books").select("id")
    return memory.apply_memory(rows, known, "river books", shown).select("id", "category_id", "categorised_by")


@query(_WITH + "SELECT c.id, c.name, c.classification, c.is_builtin, count(t.id) AS n FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', true)" for a, b, c in DEFAULT_CATEGORIES) + ") c(id, name, classification, is_builtin) LEFT JOIN live t ON t.category_id = c.id GROUP BY ALL")
def category_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The default categories, and how many live rows have each."""
    used = txns(spark, sf).where(live()).groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    return default_categories(spark).join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


# Parsing

_FORMATS = ("dd/MM/yy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd-MMM-yyyy", "dd MMM yy", "dd MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "dd.MM.yyyy", "ddMMMyyyy", "dd MMMM yyyy")


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS parsed_date, round(l_extendedprice, 2) AS parsed_amount FROM lineitem")
def parse_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Dates printed in twelve layouts and amounts in four, read back."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    pick = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(12))
    token = F.coalesce(*(F.when(pick == i, F.date_format(day, f)) for i, f in enumerate(_FORMATS)))
    plain = F.format_number(F.col("l_extendedprice"), 2)
    money = F.when(pick % 4 == 0, plain).when(pick % 4 == 1, F.concat(F.lit("₹ "), plain)).when(pick % 4 == 2, F.concat(F.lit("Rs."), plain)).otherwise(F.concat(F.lit("("), plain, F.lit(")")))
    return df.select("l_orderkey", "l_linenumber", ps.parse_date(token).alias("parsed_date"), ps.parse_amount(money).cast("double").alias("parsed_amount"))


@query("SELECT c_custkey, lpad(cast(c_custkey % 10000 AS varchar), 4, '0') AS card_last4, right(concat('1234567890', lpad(cast(c_custkey AS varchar), 6, '0')), 4) AS account_last4, CASE WHEN c_custkey % 4 < 2 THEN 'Credit' ELSE 'Debit' END AS direction, last_day(make_date(2000 + cast(c_custkey % 30 AS int), cast(1 + c_custkey % 12 AS int), 1)) AS month_end FROM customer")
def parse_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Card and account tails, direction markers and month ends."""
    df = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey")
    four = F.lpad((key % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("Old 4111XXXXXXXX9999 \nCard Number: 4567XXXXXXXX"), four, F.lit("\n"))
    account = F.concat(F.lit("ref 987654321\nAcct "), F.lit("1234567890"), F.lpad(key.cast("string"), 6, "0"))
    cell = F.when(key % 4 == 0, "Cr.").when(key % 4 == 2, "DR")
    month = F.concat(F.date_format(F.make_date(F.lit(2001), (1 + key % 12).cast("int"), F.lit(1)), "MMMM"), F.lit("-"), F.lpad((key % 30).cast("string"), 2, "0"))
    direction = ps.classify(F.when(key % 4 == 1, "Merchant Refund").otherwise("Groceries"), cell)
    return df.select("c_custkey", ps.find_last4(text, "card number").alias("card_last4"), ps.account_tail_last4(account, r"(?i)Account No:\s*([0-9]{4,})").alias("account_last4"), direction.alias("direction"), ps.month_year_end(month).alias("month_end"))


# Readers: statements rendered from line items and read back

#: issuer, head, date format, line, and what stands for a credit and a debit. {s} is a space, a tab or a no-break space.
_CARDS = (
    ("ICICI_AMAZONPAY_CARD", "ICICI Bank\nStatement Date January 31, 2024\nCard 4315XXXXXXXX1000", "dd/MM/yyyy", "{date}1234567{s}{text}{s}12{s}{amount}{cr}", (" CR", "")),
    ("SBI_CASHBACK_CARD", "SBI Card\nStatement Period: 01 Jan 24 to 31 Jan 24\nCredit Card Number 4012XXXXXXXX1001", "dd MMM yy", "{date}{s}{text}{s}{amount}{s}{cr}", ("C", "D")),
    ("YES_KIWI_CARD", "YES BANK\n01/01/2024 To 31/01/2024\nCard Number 3561XXXXXXXX1002\nPurchases Rs. 1,234.50 Dr\nPayment & Credits Received Rs. 200.25 Cr", "dd/MM/yyyy", "{date}{s}{text}{s}{amount}{s}{cr}", ("Cr", "Dr")),
    ("IOB_RUPAY_CARD", "INDIAN OVERSEAS BANK\nStmt Date : 31-Jan-2024\nCredit Card Number 6069XXXXXXXX1003\nACCOUNT SUMMARY\n1,000.00 200.25 1,234.50 0.00 2,034.25", "dd-MMM-yyyy", "{date}{s}{text}{s}{amount}{s}{cr}", ("Cr", "Dr")),
    ("FEDERAL_SCAPIA_CARD", "Scapia\n01 Jan 2024 - 31 Jan 2024\nCard 6529XXXXXXXX1004", "dd-MM-yyyy", "{date} 10:15{s}{text}{s}{cr}₹{amount}", ("+", "")),
    ("HDFC_SWIGGY_CARD", "HDFC Bank Credit Card\nBilling Period 01 Jan, 2024 - 31 Jan, 2024\nCard Number 4893XXXXXXXX1005", "dd/MM/yyyy", "{date} | 09:30{s}{text}{s}{cr}C {amount}", ("+ ", "")),
    ("HDFC_SWIGGY_CARD", "HDFC Bank Credit Card\nfor the period from Jan-24 to Mar-24\nCard Number 4893XXXXXXXX1006", "dd-MMM-yyyy", "{date}{s}{text}{s}{amount}{s}{cr}", ("CR", "DR")),
)
#: Kinds whose rows tell a credit by the wording alone where no marker does.
_WORDED = (0, 4)
#: Orders whose lines make the documents of a group.
ORDERS = 60


def _items(spark: SparkSession, sf: str, kinds: int) -> DataFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    kind = F.pmod("l_orderkey", F.lit(kinds)).cast("int")
    return df.select(
        kind.alias("kind"), F.concat(F.lit("k"), kind.cast("string"), F.lit("-"), F.floor(F.col("l_orderkey") / ORDERS).cast("string")).alias("doc_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("money"), (F.col("l_returnflag") == "R").alias("credit"), F.col("l_partkey").alias("part"),
        F.concat(F.when(F.col("l_partkey") % 40 == 0, "CASHBACK P").otherwise("SHOP P"), F.col("l_partkey").cast("string"), F.lit(" SALE")).alias("shop"),
        F.when(F.col("l_partkey") % 7 == 0, "\u00a0").when(F.col("l_partkey") % 7 == 1, "\t").otherwise(" ").alias("space"),
    )


_ITEM = (
    "l_orderkey % {kinds} AS kind, concat('k', l_orderkey % {kinds}, '-', l_orderkey // {orders}) AS doc_id, CAST(l_shipdate AS DATE) AS value_date, round(l_extendedprice, 2) AS amount, l_returnflag = 'R' AS credit, l_partkey AS part, "
    "concat(CASE WHEN l_partkey % 40 = 0 THEN 'CASHBACK P' ELSE 'SHOP P' END, cast(l_partkey AS varchar), ' SALE') AS shop"
)


def _filled(form: str, values: dict[str, Column]) -> Column:
    parts, rest = [], form
    while rest:
        head, brace, rest = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(values[name])
    return F.concat(*parts)


def _by_kind(values: list[Column]) -> Column:
    out = F.when(F.col("kind") == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col("kind") == i, v)
    return out


def _spread(items: DataFrame) -> DataFrame:
    """Dealt by document to all shuffle partitions, which are not joined though documents be small."""
    return items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "doc_id")


def card_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document for each group of orders and each kind of card statement; one line in 37 has no true date."""
    bad = F.col("part") % 37 == 1
    lines = []
    for _, _, day, form, (plus, minus) in _CARDS:
        date = F.when(bad, F.date_format("day", day.replace("MMM", "'Xyz'").replace("MM", "'99'"))).otherwise(F.date_format("day", day))
        lines.append(_filled(form, {"date": date, "s": F.col("space"), "text": F.col("shop"), "amount": F.format_number("money", 2), "cr": F.when(F.col("credit"), plus).otherwise(minus)}))
    items = _spread(_items(spark, sf, len(_CARDS))).select("kind", "doc_id", F.struct("k", "n", _by_kind(lines).alias("line")).alias("l"))
    body = items.groupBy("kind", "doc_id").agg(F.array_sort(F.collect_list("l")).alias("body"))
    head = _by_kind([F.lit(head) for _, head, *_ in _CARDS])
    return body.select("doc_id", F.concat(head, F.lit("\nCustomer relations\n"), F.array_join(F.transform("body", lambda x: x["line"]), "\n"), F.lit("\nTotal due")).alias("full_text"))


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    return keeper(spark)(statements.detect_issuer(card_documents(spark, sf)), "cards")


_CARD_ITEMS = f"WITH items AS (SELECT {_ITEM.format(kinds=len(_CARDS), orders=ORDERS)} FROM lineitem), named AS (SELECT *, {_case('kind', [c[0] for c in _CARDS])} AS issuer FROM items) "


@query(_CARD_ITEMS + f"SELECT doc_id, issuer, value_date, amount, CASE WHEN credit OR kind IN {_WORDED} AND part % 40 = 0 THEN 'Credit' ELSE 'Debit' END AS direction, shop AS description_raw FROM named WHERE part % 37 <> 1")
def read_cards(spark: SparkSession, sf: str) -> DataFrame:
    return statements.read_cards(_cards(spark, sf)).where("errored_line is null").select("doc_id", "issuer", "value_date", F.col("amount").cast("double").alias("amount"), "direction", "description_raw")


@query(_CARD_ITEMS + "SELECT doc_id, issuer, count(*) AS lines, count(*) AS tell_the_shop FROM named WHERE part % 37 = 1 GROUP BY 1, 2")
def errored_card_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the shape of a row and no true date, by document; each holds its wording."""
    bad = statements.read_cards(_cards(spark, sf)).where("errored_line is not null and amount is null and value_date is null")
    return bad.groupBy("doc_id", "issuer").agg(F.count("*").alias("lines"), F.count(F.when(F.col("errored_line").rlike("(SHOP|CASHBACK) P[0-9]+ SALE"), 1)).alias("tell_the_shop"))


_CARD_ENDS = _case("kind", ["2024-01-31"] * 6 + ["2024-03-31"])


@query(
    _CARD_ITEMS + f"SELECT doc_id, issuer, count(*) FILTER (WHERE part % 37 <> 1) AS n_rows, count(*) FILTER (WHERE part % 37 = 1) AS n_errored, CASE WHEN kind IN (0, 3) THEN NULL ELSE DATE '2024-01-01' END AS period_start, "
    f"cast({_CARD_ENDS} AS DATE) AS period_end, cast(1000 + kind AS varchar) AS card_last4, CASE WHEN kind IN (2, 3) THEN 1234.5 END AS printed_total_debits, CASE WHEN kind IN (2, 3) THEN 200.25 END AS printed_total_credits FROM named GROUP BY ALL"
)
def card_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Whole card statements: numbers of rows and errored lines, period, last digits and totals."""
    out = statements.read_statements(_cards(spark, sf))
    return out.select("doc_id", "issuer", F.size("rows").cast("long").alias("n_rows"), F.size("errored_lines").cast("long").alias("n_errored"), "period_start", "period_end", "card_last4", *(c.alias(n) for n, c in _double("printed_total_debits", "printed_total_credits").items()))


@query(ORACLE_SQL["read_cards"])
def streamed_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of read_cards from a stream of documents."""
    keep = keeper(spark)
    docs = keep(card_documents(spark, sf), "arriving")
    place = docs.inputFiles()[0].rsplit("/", 2)[0]
    stream.drain(stream.card_rows(stream.document_stream(spark, f"{place}/arriving")), f"{place}/rows", f"{place}/state")
    rows = spark.read.parquet(f"{place}/rows")
    return rows.select("doc_id", "issuer", "value_date", F.col("amount").cast("double").alias("amount"), "direction", "description_raw")


_OPENING = 2_000_000_000
#: issuer, head, date format, line, and what a column without an amount holds.
_LEDGERS = (
    ("ICICI_BANK", "ICICI Statement of Transactions in Saving Account\nJanuary 1, 2024 to January 31, 2024\nAccount Number 000000001100\nOpening Balance {open}", "dd.MM.yyyy", "{n} {date}{s}{amount}{s}{balance}", ""),
    ("HDFC_BANK", "HDFC WithdrawalAmt\nFrom : 01/01/2024 To : 31/01/2024\nAccount No : 50100001101\nOpening Balance : {open}", "dd/MM/yy", "{date}{s}X{s}ABC123456 {date}{s}{amount} {balance}", ""),
    ("FEDERAL_BANK", "Federal Bank Statement of Account\nfor the period 2024-01-01 to 2024-01-31\nAccount Number : XXXX1102\nOpening Balance {open}", "dd-MMM-yyyy", "{date}{s}{date}{s}TFR S123 {amount} {balance}{s}Cr", ""),
    ("AU_BANK", "aubank.in Savings Account\nStatement Period : 01 Jan 2024 to 31 Jan 2024\nAccount Number : 123451103\nOpening Balance (Rs) : {open}", "dd MMM yyyy", "{date} {date}{s}{out}{s}{in} {balance}", "-"),
    ("HDFC_BANK", "HDFC Savings Account Details\nFrom : 01/01/2024 To : 31/01/2024\nAccount No : 50100001104\nOpening Balance : {open}", "dd/MM/yyyy", "{date}{s}X{s}{out}{s}{in}{s}{balance}", "0.00"),
    ("FEDERAL_BANK", "Federal Bank Statement of Account\nfor the period of 01/01/2024 to 31/01/2024\nAccount Number : XXXX1105\nOpening Balance {open}", "dd/MM/yyyy", "{date}{s}{date}{s}TFR S123 {out}{s}{in} {balance} Cr", "0"),
)
_INLINE = ("", "X ", "TFR ", "", "X ", "TFR ")


def ledger_documents(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("kind", "doc_id").orderBy("k", "n", "shop", "money")
    signed = F.when(F.col("credit"), F.col("money")).otherwise(-F.col("money"))
    items = _spread(_items(spark, sf, len(_LEDGERS))).withColumns({"balance": F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, 0)) + _OPENING, "place": F.row_number().over(order)})
    lines = []
    for _, _, day, form, none in _LEDGERS:
        date, amount = F.date_format("day", day), F.format_number("money", 2)
        anchor = _filled(form, {"n": F.pmod("place", F.lit(9999)).cast("string"), "date": date, "s": F.col("space"), "amount": amount, "balance": F.format_number("balance", 2), "out": F.when(F.col("credit"), none).otherwise(amount), "in": F.when(F.col("credit"), amount).otherwise(none)})
        # The narration stands on the line above its anchor and on the line below, a blank line after it.
        lines.append(F.concat_ws("\n", F.concat(F.lit("  "), F.col("shop"), F.col("space")), F.concat(anchor, F.lit("\r")), F.concat(F.col("space"), F.lit("BRANCH\r")), F.col("space")))
    items = items.select("kind", "doc_id", F.struct("place", _by_kind(lines).alias("line")).alias("l"))
    body = items.groupBy("kind", "doc_id").agg(F.array_sort(F.collect_list("l")).alias("body"))
    head = _by_kind([F.lit(head.format(open=f"{_OPENING:,}.00") + "\n") for _, head, *_ in _LEDGERS])
    return body.select("doc_id", F.concat(head, F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("full_text"))


def _ledgers(spark: SparkSession, sf: str) -> DataFrame:
    return keeper(spark)(statements.detect_issuer(ledger_documents(spark, sf)), "ledgers")


_LEDGER_ITEMS = f"WITH items AS (SELECT {_ITEM.format(kinds=len(_LEDGERS), orders=ORDERS)} FROM lineitem), named AS (SELECT *, {_case('kind', [c[0] for c in _LEDGERS])} AS issuer, {_case('kind', _INLINE)} AS inline FROM items) "


@query(_LEDGER_ITEMS + "SELECT doc_id, issuer, value_date, amount, CASE WHEN credit THEN 'Credit' ELSE 'Debit' END AS direction, concat(inline, shop, ' BRANCH') AS description_raw, true AS amount_matches_delta FROM named")
def read_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    return statements.read_ledgers(_ledgers(spark, sf)).where("errored_line is null").select("doc_id", "issuer", "value_date", F.col("amount").cast("double").alias("amount"), "direction", "description_raw", "amount_matches_delta")


@query(
    _LEDGER_ITEMS + f"SELECT doc_id, issuer, count(*) AS n_rows, DATE '2024-01-01' AS period_start, DATE '2024-01-31' AS period_end, cast(1100 + kind AS varchar) AS card_last4, {_OPENING}.0 AS printed_opening_balance, "
    f"{_OPENING} + round(sum(CASE WHEN credit THEN amount ELSE -amount END), 2) AS printed_closing_balance, 0 AS suspects FROM named GROUP BY ALL"
)
def ledger_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Whole ledgers: number of rows, period, last digits and balances."""
    out = statements.read_statements(_ledgers(spark, sf))
    suspects = F.size(F.filter("rows", lambda r: r["ledger"]["is_suspect"]))
    return out.select("doc_id", "issuer", F.size("rows").cast("long").alias("n_rows"), "period_start", "period_end", "card_last4", *(F.round(c, 2).alias(n) for n, c in _double("printed_opening_balance", "printed_closing_balance").items()), suspects.alias("suspects"))


@query(
    "SELECT concat('f', c_custkey) AS doc_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'Credit' ELSE 'Debit' END AS direction, CASE WHEN c_custkey % 3 = 0 THEN 'ROW1_X_POSITION' ELSE 'ROW1_PROVISIONAL' END AS direction_source, "
    "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 1000.0 - 100 - c_custkey % 50 ELSE 1000.0 + 100 + c_custkey % 50 END AS opening, 900.0 AS closing, DATE '2024-01-06' AS period_end, 'NEEDS_REVIEW' AS status, 0 AS suspect_count FROM customer"
)
def ledger_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers of two rows without an opening balance: the first direction by place where words have one, else provisional."""
    key = F.col("c_custkey")
    df = spark.read.parquet(f"{sf}/customer.parquet")
    money = F.format_number(100 + key % 50, 2)
    docs = df.select(F.concat(F.lit("f"), key.cast("string")).alias("doc_id"), F.concat(F.lit("ICICI Statement of Transactions in Saving Account\n1 05.01.2024 "), money, F.lit(" 1,000.00\nTO SHOP\n2 06.01.2024 100.00 900.00")).alias("full_text"), "c_custkey")
    left = F.when(key % 2 == 1, 420.0).otherwise(350.0)
    word = lambda text, x0: F.struct(text.alias("text"), x0.alias("x0"), (x0 + 40).alias("x1"))
    words = docs.where(key % 3 == 0).select("doc_id", F.array(word(F.lit("05.01.2024"), F.lit(50.0)), word(money, left), word(F.lit("1,000.00"), F.lit(500.0))).alias("words"))
    read = keeper(spark)(statements.period_end(statements.read_statements(statements.detect_issuer(docs), words)), "first_rows")
    rows = read.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.line_index", "r.amount", "r.ledger.balance", "r.ledger.direction_source", "r.ledger.serial", F.col("r.direction"))
    chain = checks.balance_chain(read, rows)
    first = read.select("doc_id", "period_end", F.col("rows")[0]["direction"].alias("direction"), F.col("rows")[0]["ledger"]["direction_source"].alias("direction_source"), F.col("printed_opening_balance").cast("double").alias("opening"), F.col("printed_closing_balance").cast("double").alias("closing"))
    return first.join(chain.select("doc_id", "status", F.col("suspect_count").cast("int").alias("suspect_count")), "doc_id")


@query(
    "WITH items AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM (SELECT l_orderkey // 60 AS g, * FROM lineitem)) "
    "SELECT concat('d', cast(g AS varchar)) AS doc_id, count(*) AS checked_rows, count(*) FILTER (WHERE place % 7 = 0) + count(*) FILTER (WHERE place % 10 = 0 AND place % 7 <> 0) AS suspect_count, "
    "CASE WHEN count(*) FILTER (WHERE place % 7 = 0 OR place % 10 = 0) = 0 THEN 'RECONCILED' ELSE 'NEEDS_REVIEW' END AS status, least(20, count(*) FILTER (WHERE place % 7 = 0 OR place % 10 = 0)) AS listed, min(place) FILTER (WHERE place % 7 = 0 OR place % 10 = 0) AS first_suspect, max(CASE WHEN place = 7 THEN 'missing running balance' END) AS first_reason FROM items GROUP BY g"
)
def balance_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers in which each seventh balance is missing and each tenth amount is misprinted."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    order = Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = df.withColumn("doc_id", F.concat(F.lit("d"), F.floor(F.col("l_orderkey") / ORDERS).cast("string")))
    rows = rows.withColumns({"line_index": F.row_number().over(order), "amount": F.col("l_extendedprice").cast(MONEY)})
    # A missing balance leaves the next row to be held against the one before: its amount is the sum of both.
    gone, prev_gone = F.col("line_index") % 7 == 0, (F.col("line_index") - 1) % 7 == 0
    total = F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.lag("amount").over(order), F.lit(0).cast(MONEY))
    printed = F.col("amount") + F.when(prev_gone & (F.col("line_index") > 1), before).otherwise(F.lit(0)) + F.when((F.col("line_index") % 10 == 0) & ~gone, F.lit(5)).otherwise(F.lit(0))
    rows = rows.withColumns({"balance": F.when(~gone, total).cast(MONEY), "printed": printed.cast(MONEY), "direction_source": F.lit("BALANCE_DELTA")})
    rows = rows.select("doc_id", "line_index", F.col("printed").alias("amount"), "balance", "direction_source")
    heads = rows.select("doc_id").distinct().withColumn("printed_opening_balance", F.lit(0).cast(MONEY))
    return checks.balance_chain(heads, rows).select("doc_id", "checked_rows", "suspect_count", "status", F.size("suspects").cast("long").alias("listed"), F.get("suspects", F.lit(0))["row"].cast("long").alias("first_suspect"), F.get("suspects", F.lit(0))["reason"].alias("first_reason"))


@query(
    "WITH sums AS (SELECT o_custkey AS c, coalesce(sum(cast(round(o_totalprice, 2) AS decimal(18, 2))) FILTER (WHERE o_orderstatus <> 'O'), 0) AS d, coalesce(sum(cast(round(o_totalprice, 2) AS decimal(18, 2))) FILTER (WHERE o_orderstatus = 'O'), 0) AS cr FROM orders GROUP BY 1) "
    "SELECT concat('d', cast(c AS varchar)) AS doc_id, CASE WHEN c % 10 IN (0, 5, 2, 7, 3) THEN 'RECONCILED' WHEN c % 5 <> 4 THEN 'NEEDS_REVIEW' END AS status, cast(d AS double) AS read_debits, cast(cr AS double) AS read_credits, "
    "cast(CASE c % 5 WHEN 0 THEN d + 1 WHEN 1 THEN d + 2 END AS double) AS printed_debits, cast(CASE c % 5 WHEN 0 THEN cr WHEN 2 THEN cr - 1 END AS double) AS printed_credits, "
    "cast(CASE c % 10 WHEN 3 THEN d - cr + 1 WHEN 8 THEN d - cr + 1.01 END AS double) AS expected_balance_change, CASE WHEN c % 5 = 4 THEN 'no printed totals extracted' END AS reason FROM sums"
)
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Card statements whose printed totals are right or not, by debits, credits or both, by balance, or missing."""
    df = spark.read.parquet(f"{sf}/orders.parquet")
    rows = df.select(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("doc_id"), "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").cast(MONEY).alias("amount"), F.when(F.col("o_orderstatus") == "O", CREDIT).otherwise(DEBIT).alias("direction"))
    total = {d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).cast(MONEY) for d in (DEBIT, CREDIT)}
    heads = rows.groupBy("doc_id", "o_custkey").agg(total[DEBIT].alias("d"), total[CREDIT].alias("c"))
    five, ten, d, c = F.col("o_custkey") % 5, F.col("o_custkey") % 10, F.col("d"), F.col("c")
    printed = {
        "printed_total_debits": F.when(five == 0, d + 1).when(five == 1, d + 2), "printed_total_credits": F.when(five == 0, c).when(five == 2, c - 1),
        "printed_opening_balance": F.when(five == 3, 50), "printed_closing_balance": F.when(ten == 3, d - c + 51).when(ten == 8, d - c + F.lit("51.01").cast(MONEY)),
    }
    heads = heads.select("doc_id", *(x.cast(MONEY).alias(n) for n, x in printed.items()))
    money = ("read_debits", "read_credits", "printed_debits", "printed_credits", "expected_balance_change")
    return checks.reconcile(heads, rows).select("doc_id", "status", "reason", *(x.alias(n) for n, x in _double(*money).items()))


@query("SELECT concat('p', cast(l_orderkey AS varchar)) AS doc_id, count(*) AS n_rows, string_agg(concat(cast(l_linenumber AS varchar), ' P', cast(l_partkey AS varchar)), '|' ORDER BY l_linenumber, l_partkey) AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) GROUP BY 1")
def printed_row_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with two words a line item, set in rows ten points high, read back from positions."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = df.select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("doc_id"), place.alias("place"), F.col("l_linenumber").cast("string").alias("a"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("b"))
    top = F.lit(800.0) - F.col("place") * 20
    words = F.array(
        F.struct((F.col("place") * 100).alias("position"), F.col("a").alias("text"), F.lit(50.0).alias("x0"), F.lit(58.0).alias("x1"), (top - 10).alias("y0"), top.alias("y1")),
        F.struct((F.col("place") * 100 + 2).alias("position"), F.col("b").alias("text"), F.lit(62.0).alias("x0"), F.lit(90.0).alias("x1"), (top - 11).alias("y0"), (top - 1).alias("y1")),
    )
    pages = rows.select("doc_id", F.lit(1).alias("page"), F.explode(words).alias("w")).select("doc_id", "page", "w.*")
    out = printed_rows.printed_rows(pages)
    ordered = F.array_sort(F.collect_list(F.struct("page", "row", "text")))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(ordered, lambda x: x["text"]), "|").alias("text"))

