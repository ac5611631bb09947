"""Import of a parsed statement: one new version of the store, or none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.categorize import categorize_stored
from ..operators.dedup import Keep, find_duplicates, link, reimported_rows, still_open
from ..schema import TABLES, live
from ..sources.store import Store


@dataclass(frozen=True)
class Request:
    bank_code: str
    period_end: str
    now: str
    #: value_date, amount, direction, currency, description_raw, and line_index for their order.
    rows: DataFrame
    period_start: str | None = None
    needs_review: bool = False
    source: str = "Statement"
    account_id: str | None = None
    #: For a new account: name, is_credit_card, currency.
    new_account: tuple[str, bool, str] | None = None
    last4: str | None = None


@dataclass(frozen=True)
class Outcome:
    account_id: str
    account_created: bool
    statement_id: str | None
    rows_read: int
    transactions_added: int
    rows_superseded: int
    duplicates_linked: int
    categorized: int
    uncategorized: int


def _id(*parts: str) -> str:
    """Ids come from what they name, so that a task run twice gives the same ones."""
    import hashlib

    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


def import_statement(store: Store, request: Request, keep: Keep) -> Outcome:
    """Account, statement, rows, links to earlier imports, categories, duplicates; then one write.

    Duplicates are sought among the rows that the statement or the last import can have changed
    something for; a store that doesn't know them is matched in whole once.

    A statement without rows commits its account alone. A last4 only fills a blank.
    """
    spark = store.spark
    accounts, statements, transactions = (store.table(t) for t in ("accounts", "statements", "transactions"))
    created = request.account_id is None
    if created:
        name, is_card, currency = request.new_account
        account_id = _id("account", request.bank_code, name, request.now)
        seq = (accounts.agg(F.max("account_seq")).first()[0] or 0) + 1
        new = spark.createDataFrame([(account_id, seq, name, request.bank_code, is_card, currency, request.now, request.now, request.last4, None)], TABLES["accounts"])
        accounts = accounts.unionByName(new)
    else:
        account_id = request.account_id
        if accounts.where(F.col("id") == account_id).isEmpty():
            raise LookupError("import account does not exist")
        fill = (F.col("id") == account_id) & F.col("last4").isNull() & F.lit(request.last4).isNotNull()
        accounts = accounts.withColumns({"updated_at": F.when(fill, F.lit(request.now)).otherwise(F.col("updated_at")), "last4": F.when(fill, F.lit(request.last4)).otherwise(F.col("last4"))})
    rows = keep(request.rows, "rows")
    n = rows.count()
    if not n:
        store.write({"accounts": accounts})
        return Outcome(account_id, created, None, 0, 0, 0, 0, 0, 0)

    statement_id = _id("statement", account_id, request.period_end, str(len(store.versions())))
    statement = spark.createDataFrame(
        [(statement_id, (statements.agg(F.max("statement_seq")).first()[0] or 0) + 1, account_id, request.bank_code, request.period_start, request.period_end, request.needs_review, request.source, request.now)],
        "id string, statement_seq long, account_id string, bank_code string, period_start string, period_end string, needs_review boolean, source string, created_at string",
    ).withColumns({"period_start": F.to_date("period_start"), "period_end": F.to_date("period_end")})
    last = transactions.agg(F.max("txn_seq")).first()[0] or 0
    # A statement has some hundreds of rows; line_index is unique in it and gives their order.
    new_rows = rows.select(
        F.sha2(F.concat_ws("|", F.lit(statement_id), F.col("line_index")), 256).substr(1, 32).alias("id"), (F.lit(last) + 1 + F.col("line_index")).cast("long").alias("txn_seq"),
        F.lit(account_id).alias("account_id"), F.col("value_date").alias("date"), "description_raw", "amount", "direction", "currency", F.lit(None).cast("string").alias("category_id"),
        F.lit(None).cast("string").alias("categorised_by"), F.lit(False).alias("is_deleted"), F.lit(request.now).alias("created_at"), F.lit(request.now).alias("updated_at"),
        F.lit(None).cast("string").alias("source_category"), F.lit(False).alias("is_transfer"), F.lit(None).cast("string").alias("transfer_group_id"),
        F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("dedup_layer"), F.lit(statement_id).alias("statement_id"),
    )
    every = keep(transactions.unionByName(new_rows), "every")
    again = keep(reimported_rows(every, statement.select(F.col("id").alias("statement_id")), lambda d, n: keep(d, f"again_{n}")), "again")
    every = link(every, again)
    own = F.col("account_id") == account_id
    decided = categorize_stored(every.where(own), accounts, store.table("merchant_map"), store.table("rules"), store.table("source_category_map"), store.table("merchant_memory"), store.table("categories"))
    decided = keep(decided, "decided")
    counts = decided.where("was_eligible").agg(F.count("category_id").alias("yes"), F.count("*").alias("n")).first()
    every = keep(every.where(~own).unionByName(decided.drop("was_eligible")), "categorized")
    # Only amounts that the statement brings, or that the last import left open, can give links.
    reached = None
    if store.has("open_groups"):
        brought = every.where(F.col("statement_id") == statement_id).select("amount", "direction")
        reached = keep(store.table("open_groups").unionByName(brought).distinct(), "reached")
    links = keep(find_duplicates(every, accounts, lambda d, n: keep(d, f"across_{n}"), owner="owner", reached=reached), "across")
    left_open = keep(still_open(links, every), "left_open")
    every = keep(link(every, links), "linked")
    added = every.where(live() & (F.col("statement_id") == statement_id)).count()
    store.write({"accounts": accounts, "statements": statements.unionByName(statement), "transactions": every, "open_groups": left_open})
    return Outcome(account_id, created, statement_id, n, added, n - added, links.count() + again.count(), counts["yes"], counts["n"] - counts["yes"])
