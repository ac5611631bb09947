"""Imports that match what a statement reaches against imports that match the whole store."""

from __future__ import annotations

import random
from datetime import date, timedelta

from coinloom.plans import imports
from coinloom.plans.queries import keeper
from coinloom.sources.store import Store

from .test_engine import request

SHOPS = ["UPI-River Books", "River Books", "Nova Fuel", "POS Nova Fuel Station"]


def statements():
    rng, out = random.Random(11), []
    for k in range(3):
        rows = [(date(2024, 1, 1) + timedelta(rng.randrange(3)), rng.choice(["5.00", "6.00", "7.00"]), "Debit", rng.choice(SHOPS)) for _ in range(9)]
        if k == 1:
            rows += out[0][1][:3]
        if k == 2:
            rows = [(date(2024, 1, 1), "99.00", "Credit", "Nothing like it")]
        out.append((k % 2 == 1, rows))
    return out


def test_equal_to_whole_runs(spark, tmp_path, monkeypatch):
    reached = []
    find = imports.find_duplicates
    monkeypatch.setattr(imports, "find_duplicates", lambda *a, **k: reached.append(k.get("reached")) or find(*a, **k))
    found = []
    for whole in (False, True):
        if whole:
            monkeypatch.setattr(Store, "has", lambda self, name: False)
        store, ids, out = Store(spark, f"file://{tmp_path}/{whole}").create(), {}, []
        for k, (card, rows) in enumerate(statements()):
            own = {"account_id": ids[card]} if card in ids else {"new_account": ("Card" if card else "Bank", card, "INR")}
            done = imports.import_statement(store, request(spark, "HDFC", f"2024-0{k + 1}-28", rows, **own), keeper(spark))
            ids[card] = done.account_id
            out.append((done.transactions_added, done.rows_superseded, done.duplicates_linked))
        rows = store.table("transactions").select("txn_seq", "superseded_by", "dedup_layer", "category_id").collect()
        found.append((out, sorted(rows, key=str)))
    assert found[0] == found[1] and sum(x[2] for x in found[0][0]) > 2
    assert [r is None for r in reached] == [False] * 3 + [True] * 3
    # The last statement brings one amount; besides it only what the import before left open is matched.
    assert {(float(r["amount"]), r["direction"]) for r in reached[2].collect()} <= {(99.0, "Credit"), (5.0, "Debit"), (6.0, "Debit"), (7.0, "Debit")}
