"""Queries that go over the whole of their tables, counted on the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinloom.plans import queries as own
from coinloom.schema import live


def test_history_by_date_groups_every_live_row(spark, sf_dir):
    rows = own.txns(spark, sf_dir).where(live()).join(own.accounts(spark, sf_dir).select(F.col("id").alias("account_id")), "account_id")
    want = {r["date"]: r["count"] for r in rows.groupBy("date").count().collect()}
    got = own.QUERIES["history_by_date"](spark, sf_dir).collect()
    assert {r["date"]: r["n"] for r in got} == want and sum(want.values()) > 200
    assert all(len(r["ids"].split(",")) == r["n"] for r in got)


CROWDED = "cast(o_orderkey % 700 + CASE copy WHEN 1 THEN CASE o_orderkey % 30 WHEN 6 THEN 1 WHEN 18 THEN 2 ELSE 0 END WHEN 3 THEN CASE o_orderkey % 30 WHEN 17 THEN 1 WHEN 27 THEN 2 ELSE 0 END ELSE 0 END as int)"


def crowded(spark, sf_dir):
    """Transactions with the popular amount on 28 days."""
    return own.txns(spark, sf_dir, columns=own._BASE | {"day": CROWDED}).join(own.accounts(spark, sf_dir).select(F.col("id").alias("account_id"), "is_credit_card"), "account_id")


def test_duplicate_candidates_hold_every_pair_of_crowded_days(spark, sf_dir):
    """Of one popular amount and wording, all bank rows with all card rows of a day and its neighbours."""
    rows = crowded(spark, sf_dir).where(live()).where("amount = 99.00 and upper(description_raw) like 'UPI-CITY METRO%'").select("id", "direction", "date", "is_credit_card").collect()
    want = {(e["id"], i["id"]) for e in rows for i in rows if not e["is_credit_card"] and i["is_credit_card"] and e["direction"] == i["direction"] and abs((e["date"] - i["date"]).days) <= 1}
    got = {(r["existing_id"], r["incoming_id"]) for r in own.QUERIES["duplicate_candidates"](spark, sf_dir).collect()}
    assert want and want <= got


def test_transfer_candidates_hold_every_pair_of_crowded_days(spark, sf_dir):
    """Of the popular amount, all outflows with all inflows of other accounts within a day and 1.00."""
    rows = crowded(spark, sf_dir).where("not is_deleted and transfer_group_id is null and amount between 99.00 and 100.00").select("id", "account_id", "direction", "date", "amount").collect()
    out, into = ([r for r in rows if r["direction"] == d] for d in ("Debit", "Credit"))
    want = {(o["id"], i["id"]) for o in out for i in into if o["account_id"] != i["account_id"] and abs((o["date"] - i["date"]).days) <= 1 and abs(o["amount"] - i["amount"]) <= 1}
    got = {(r["outflow_id"], r["inflow_id"]) for r in own.QUERIES["transfer_candidates"](spark, sf_dir).collect()}
    assert want and want <= got
