"""Rules of the engine on small tables, against values worked out by hand or by plain Python."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coinloom.functions import narration as nr
from coinloom.functions import parsing as ps
from coinloom.operators import checks, history, matching, memory, transfers
from coinloom.plans import imports
from coinloom.plans.queries import keeper
from coinloom.schema import TABLES, engine_may_decide, migrate, version_of
from coinloom.sources import statements
from coinloom.sources.store import Store


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,23,456.78", "123456.78"), ("₹ 99.00", "99.00"), ("Rs. 1.50", "1.50"), ("(45.00)", "45.00"), ("INR 7.25", "7.25"), ("12", None), ("", None)],
)
def test_amounts(spark, text, want):
    assert one(spark, ps.parse_amount(F.col("a")), a=text) == (want and Decimal(want))


@pytest.mark.parametrize(
    ("text", "want"),
    [("05/03/24", date(2024, 3, 5)), ("05/03/85", date(1985, 3, 5)), ("2024-03-05", date(2024, 3, 5)), ("5 Mar 2024", date(2024, 3, 5)), ("March 5, 2024", date(2024, 3, 5)), ("05.03.2024", date(2024, 3, 5)), ("05Mar2024", date(2024, 3, 5)), ("31/02/2024", None), ("x", None)],
)
def test_dates(spark, text, want):
    assert one(spark, ps.parse_date(F.col("a")), a=text) == want


def test_narrations(spark):
    assert one(spark, nr.normalize_narration(F.col("a")), a="UPI-POS  Corner Bakery RRN123 9876543210") == "corner bakery"
    assert one(spark, nr.merchant_portion(F.col("a")), a="UPI-River/Books 1234 payment") == "river books"
    assert one(spark, nr.merchant_portion(F.col("a")), a="UPI-123456") is None
    assert nr.jaro_winkler_of("same", "same") == 1.0 and nr.jaro_winkler_of("", "a") == 0.0
    assert abs(nr.jaro_winkler_of("martha", "marhta") - 0.9611) < 1e-4


def test_undecided_rows_may_be_decided(spark):
    rows = spark.createDataFrame([(None,), ("PERSON",), ("PERSON_MEMORY",), ("T3_RULE",)], "categorised_by string")
    assert {r[0] for r in rows.where(engine_may_decide()).collect()} == {None, "T3_RULE"}


def test_matching_is_first_come_first_served(spark):
    rng = random.Random(2)
    pairs = sorted({(c, rng.randrange(25)) for c in range(40) for _ in range(3)})
    rows = [(c, k, c, (7 * k + 3 * c) % 101 * 100 + k) for c, k in pairs]
    taken, want = set(), set()
    for c in range(40):
        free = sorted((liking, k) for x, k, _, liking in rows if x == c and k not in taken)
        if free:
            taken.add(free[0][1])
            want.add((c, free[0][1]))
    looks = [(0, c, 1000 + k, sorted(x[3] for x in rows if x[0] == c).index(liking)) for c, k, _, liking in rows]
    events = [(0, c, c, 1, c, True, False) for c in range(40)] + [(0, 1000 + k, 1000 + k, 0, k, False, True) for k in range(25)]
    got = matching.in_order(
        spark.createDataFrame(events, "group long, kind long, number long, epoch long, seq long, claims boolean, serves boolean"), spark.createDataFrame(looks, "group long, kind long, other long, layer int")
    )
    assert {(r["claimant"], r["candidate"] - 1000) for r in got.collect()} == want


def test_pages_equal_one_sort(spark):
    rng = random.Random(3)
    rows = [(f"t{i}", f"a{i % 4}", i % 4, i, date(2024, 1, 1 + rng.randrange(9))) for i in range(57)]
    df = spark.createDataFrame(rows, "id string, account_id string, account_seq long, txn_seq long, date date").cache()
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[4].toordinal(), r[2], r[3]))]
    keep, got, cursor, turn = keeper(spark), [], None, 0
    while True:
        page = history.page(df, 13, cursor=cursor)
        own = [r["id"] for r in history.ordered(page.rows).collect()]
        got += own
        cursor = keep(page.cursor, f"c{turn}")
        turn += 1
        if not own or cursor.isEmpty():
            break
    assert got == want


def request(spark, bank, period_end, rows, **more):
    kind = "line_index int, value_date date, amount decimal(38,10), direction string, currency string, description_raw string"
    df = spark.createDataFrame([(i, d, Decimal(a), way, "INR", text) for i, (d, a, way, text) in enumerate(rows)], kind)
    return imports.Request(bank_code=bank, period_end=period_end, now=f"now-{period_end}", rows=df, **more)


def test_imports_link_what_was_there(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store").create()
    rows = [(date(2024, 1, 5), "100.00", "Debit", "UPI-River Books"), (date(2024, 1, 6), "20.00", "Credit", "Refund Nova Fuel")]
    first = imports.import_statement(store, request(spark, "HDFC", "2024-01-31", rows, new_account=("Savings", False, "INR")), keeper(spark))
    assert (first.account_created, first.transactions_added, first.rows_superseded) == (True, 2, 0)
    again = imports.import_statement(store, request(spark, "HDFC", "2024-02-29", rows[:1], account_id=first.account_id), keeper(spark))
    assert (again.transactions_added, again.rows_superseded) == (0, 1)
    known = store.versions()
    with pytest.raises(LookupError):
        imports.import_statement(store, request(spark, "HDFC", "2024-03-31", rows, account_id="nobody"), keeper(spark))
    assert store.versions() == known and store.table("transactions").count() == 3
    with pytest.raises(ValueError, match="names no row"):
        store.insert("merchant_map", spark.createDataFrame([(1, 1, "LITERAL", "x", "NOWHERE")], TABLES["merchant_map"]))


def test_a_changed_set_is_refused(spark):
    rows = spark.createDataFrame([("t1", "UPI-River Books", None, None, False, None)], "id string, description_raw string, category_id string, categorised_by string, is_deleted boolean, superseded_by string")
    known = spark.createDataFrame([("river books", "EDUCATION")], TABLES["merchant_memory"])
    done = memory.apply_memory(rows, known, "river books", spark.createDataFrame([("t1",)], "id string")).first()
    assert (done["category_id"], done["categorised_by"]) == ("EDUCATION", "PERSON_MEMORY")
    with pytest.raises(memory.StaleSet):
        memory.apply_memory(rows, known, "river books", spark.createDataFrame([("t2",)], "id string"))


CARD = "YES BANK\n01/01/2024 To 31/01/2024\n"


def test_card_rows_keep_what_cannot_be_read(spark):
    """No-break spaces and tabs part fields; a line with the shape of a row and no true date is kept as it is."""
    text = CARD + "05/01/2024\u00a0UPI  PAYER\u00a0\u00a01,234.50 Dr\n99/01/2024 BAD DAY 1.00 Cr\n06/01/2024\tREFUND\t2.00\tCr\nTotal due"
    docs = statements.detect_issuer(spark.createDataFrame([("a", text), ("b", "nothing known"), ("c", None), ("d", CARD)], "doc_id string, full_text string"))
    rows = [(r["line_index"], r["value_date"], r["amount"], r["direction"], r["description_raw"], r["errored_line"]) for r in statements.read_cards(docs).orderBy("line_index").collect()]
    assert rows == [
        (2, date(2024, 1, 5), Decimal("1234.50"), "Debit", "UPI  PAYER", None), (3, None, None, None, None, "99/01/2024 BAD DAY 1.00 Cr"), (4, date(2024, 1, 6), Decimal("2.00"), "Credit", "REFUND", None),
    ]
    whole = {r["doc_id"]: r for r in statements.read_statements(docs).collect()}
    assert set(whole) == {"a", "d"} and whole["a"]["errored_lines"] == ["99/01/2024 BAD DAY 1.00 Cr"] and len(whole["a"]["rows"]) == 2 and whole["d"]["rows"] == []
    assert whole["a"]["period_end"] == date(2024, 1, 31)


def test_long_lines_are_cut(spark):
    docs = spark.createDataFrame([("a", CARD + f"05/01/2024 {'x' * 500} 1.00 Dr\n99/99/2024 {'y' * 500} 1.00 Dr")], "doc_id string, full_text string")
    good, bad = statements.read_card(docs, "YES_KIWI_CARD").orderBy("line_index").collect()
    assert good["description_raw"] == "x" * 240 and len(bad["errored_line"]) == 240


def test_first_layout_that_reads_a_row_counts(spark):
    head = "HDFC Bank Credit Card\n"
    monthly, yearly, broken = "05/01/2024 | 09:30 SHOP C 1.00", "05-Jan-2024 SHOP 2.00 DR", "99-Jan-2024 SHOP 3.00 DR"
    docs = spark.createDataFrame([("both", f"{head}{monthly}\n{yearly}"), ("broken", f"{head}{broken}\n{monthly}"), ("none", f"{head}{broken}")], "doc_id string, full_text string")
    rows = sorted((r["doc_id"], r["amount"], r["errored_line"]) for r in statements.read_card(docs, "HDFC_SWIGGY_CARD").collect())
    assert rows == [("both", Decimal(2), None), ("broken", Decimal(1), None)]


def test_ledger_lines_around_anchors(spark):
    """A broken anchor is kept as errored and reads as narration; statements of balances belong to no row."""
    text = (
        "ICICI Statement of Transactions in Saving Account\nOpening Balance 100.00\n  above one \r\n1 05.01.2024 X 10.00 90.00\r\n\r\n\u00a0below one\t\n2 99.01.2024 Y 5.00 95.00\nClosing Balance 95.00\nabove two\n"
        "3 06.01.2024 20.00 110.00\nlast"
    )
    docs = spark.createDataFrame([("a", text), ("b", "ICICI Statement of Transactions in Saving Account")], "doc_id string, full_text string")
    rows = statements.read_ledgers(statements.detect_issuer(docs)).orderBy("line_index").collect()
    assert [(r["line_index"], r["description_raw"], r["direction"], r["balance_delta"], r["is_suspect"], r["errored_line"]) for r in rows] == [
        (3, "X above one below one 2 99.01.2024 Y 5.00 95.00", "Debit", Decimal(-10), False, None), (6, None, None, None, None, "2 99.01.2024 Y 5.00 95.00"), (9, "above two last", "Credit", Decimal(20), False, None),
    ]
    empty = checks.balance_chain(statements.read_statements(statements.detect_issuer(docs)), rows_of(spark)).where("doc_id = 'b'").first()
    assert (empty["status"], empty["checked_rows"], empty["reason"]) == ("NEEDS_REVIEW", 0, "no parsed transactions")


def rows_of(spark):
    return spark.createDataFrame([], "doc_id string, line_index int, amount decimal(38,10), balance decimal(38,10), direction_source string")


def test_corrections_and_memory(spark):
    rows = spark.createDataFrame([("t1", "UPI-River Books", None, None, False, None), ("t2", "UPI-River Books", None, None, True, None)], "id string, description_raw string, category_id string, categorised_by string, is_deleted boolean, superseded_by string")
    known = spark.createDataFrame([("river books", "EDUCATION")], TABLES["merchant_memory"])
    out, mem, portion, formed = memory.set_transaction_category(rows, known, "t1", "SHOPPING", True)
    assert portion == "river books" and formed and [tuple(r) for r in mem.collect()] == [("river books", "SHOPPING")]
    assert {(r["id"], r["category_id"], r["categorised_by"]) for r in out.collect()} == {("t1", "SHOPPING", "PERSON"), ("t2", None, None)}
    out, mem, _, formed = memory.set_transaction_category(rows, known, "t1", None, True)
    assert not formed and mem.collect() == known.collect() and out.first()["categorised_by"] == "PERSON"
    with pytest.raises(memory.NotFound):
        memory.set_transaction_category(rows, known, "t2", "SHOPPING", False)


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store").create()
    first = store.manifest(1)
    other = Store(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(other, "versions", lambda: [1])
    store.insert("categories", spark.createDataFrame([("A", "a", "SPEND", False)], TABLES["categories"]))
    with pytest.raises(RuntimeError, match="someone else"):
        other.insert("categories", spark.createDataFrame([("B", "b", "SPEND", False)], TABLES["categories"]))
    assert {r["id"] for r in store.table("categories").where("not is_builtin").collect()} == {"A"}
    assert store.manifest(2)["accounts"] == first["accounts"] and store.manifest(2)["categories"] != first["categories"]
    with pytest.raises(ValueError, match="can't be"):
        store.insert("categories", spark.createDataFrame([("C", "c", "WHATEVER", False)], TABLES["categories"]))


def test_earlier_schemas_are_brought_up(spark):
    old = spark.createDataFrame([("t1", 1)], "id string, txn_seq long")
    new = migrate(old, "transactions")
    assert new.columns == [f.split(" ")[0] for f in TABLES["transactions"].split(", ")] and new.first()["is_transfer"] is False
    assert version_of(old.columns, "transactions") == 1 and version_of(new.columns, "transactions") == 5 and version_of(TABLES["accounts"].split(", "), "accounts") == 1
    assert migrate(new, "transactions").collect() == new.collect()


def test_links_and_transfers_written_twice_change_nothing(spark):
    day = date(2024, 1, 1)
    kind = "id string, account_id string, txn_seq long, date date, amount decimal(38,10), direction string, description_raw string, is_credit_card boolean"
    rows = spark.createDataFrame([("o", "a", 1, day, Decimal(5), "Debit", "x", False), ("i", "b", 2, day, Decimal(5), "Credit", "x", True), ("p", "b", 3, day, Decimal(5), "Credit", "x", True)], kind)
    stored = migrate(rows, "transactions")
    pairs = transfers.detect_transfers(rows, keeper(spark))
    once = transfers.link_transfers(stored, pairs)
    assert {(r["id"], r["category_id"], r["categorised_by"]) for r in once.collect()} == {("o", "CREDIT_CARD_BILL_PAYMENT", "TRANSFER_DETECTOR"), ("i", "CREDIT_CARD_BILL_PAYMENT", "TRANSFER_DETECTOR"), ("p", None, None)}
    left = once.where("transfer_group_id is null").select("id").join(rows, "id")
    assert transfers.detect_transfers(left, keeper(spark)).count() == 0
    assert transfers.link_transfers(once, pairs).exceptAll(once).count() == 0
