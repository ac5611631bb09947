"""Readers: statement documents to typed rows.

A document is doc_id and full_text. Lines come from one split, and all fields of a row from one
match of its layout's pattern. Cards and ledgers of all issuers are read in one scan, each document
inside its own row, without any shuffle; a document has to fit in memory, with its typed rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.narration import trim
from ..functions.parsing import account_tail_last4, bound, classify, find_last4, loose_amount, month_year_end, parse_amount, parse_date, parts
from ..schema import CREDIT, DEBIT, MONEY
from .layouts import BY_ID, HEADER_LINES, ISSUERS, MAX_RAW, ROW_AMOUNT, ROW_DATE, CardLayout, Issuer, LedgerLayout


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_index and line; blank lines are kept."""
    return docs.select("doc_id", F.posexplode(F.split("full_text", "\n", -1)).alias("line_index", "line"))


# Claims


def normalize_for_claim(text: Column) -> Column:
    """Without white space; A-Z alone lower-cased."""
    return F.translate(F.regexp_replace(text, r"(?U)\s", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def regions(full_text: Column) -> tuple[Column, Column]:
    """Identity and header: the text of the lines that are not rows, all and the first HEADER_LINES."""
    plain = F.transform(F.filter(F.split(full_text, "\r?\n", -1), lambda x: ~(x.rlike(ROW_DATE) & x.rlike(ROW_AMOUNT))), normalize_for_claim)
    return F.array_join(plain, ""), F.array_join(F.slice(plain, 1, HEADER_LINES), "")


def claims(issuer: Issuer, identity: Column, header: Column) -> Column:
    where = header if issuer.product_proven else identity

    def has(marker: str) -> Column:
        return where.contains("".join(marker.split()).lower())

    out = F.lit(True)
    for m in issuer.claim_all:
        out = out & has(m)
    if issuer.claim_any:
        some = F.lit(False)
        for m in issuer.claim_any:
            some = some | has(m)
        out = out & some
    return out


def detect_issuer(docs: DataFrame) -> DataFrame:
    """docs with issuer, or null: ledgers before cards, a proven product before a bank, then by id."""
    identity, header = regions(F.col("full_text"))
    rows = docs.withColumns({"_identity": identity, "_header": header})
    ranked = sorted(ISSUERS, key=lambda i: (not i.ledger, not i.product_proven, i.id))
    found = F.coalesce(*(F.when(claims(i, F.col("_identity"), F.col("_header")), F.lit(i.id)) for i in ranked))
    return rows.select(*docs.columns, found.alias("issuer"))


# Rows. A document is read where it stands, by functions over the array of its lines: no line
# leaves its row before it is typed, so nothing is shuffled and every pattern runs once a line.


def _card_lines(layout: CardLayout, issuer: Issuer, lines: Column) -> Column:
    """Typed rows of the lines that have the layout's shape; without a date or amount only the line is given."""

    def typed(h: Column) -> Column:
        p = h["p"]
        text = trim(p[layout.text])
        day, amount = parse_date(p[layout.date], layout.shape), parse_amount(p[layout.amount])
        return F.struct(h["line_index"].alias("line_index"), h["line"].alias("line"), day.alias("value_date"), amount.alias("amount"), text.alias("text"), (p[layout.plus] if layout.plus else p[layout.marker]).alias("sign"))

    def finished(r: Column) -> Column:
        if layout.plus:
            other = classify(r["text"]) if layout.worded else F.lit(DEBIT)
            direction = F.when(r["sign"] != "", F.lit(CREDIT)).otherwise(other)
        else:
            direction = classify(r["text"], r["sign"])
        good = r["value_date"].isNotNull() & r["amount"].isNotNull()
        return _row(issuer, r["line_index"], r["line"], good, r["value_date"], r["amount"], direction, r["text"], F.lit(None).cast(_LEDGER))

    found = F.transform(lines, lambda x, i: F.struct(i.alias("line_index"), x.alias("line"), parts(x, layout.row).alias("p")))
    found = F.filter(found, lambda h: F.size(h["p"]) > 1)
    return F.transform(F.transform(found, typed), finished)


_LEDGER = "struct<balance:decimal(38,10),balance_delta:decimal(38,10),amount_matches_delta:boolean,is_suspect:boolean,direction_source:string,serial:string>"


def _row(issuer: Issuer, line_index: Column, line: Column, good: Column, day: Column, amount: Column, direction: Column, text: Column, ledger: Column) -> Column:
    return F.struct(
        line_index.alias("line_index"), F.when(good, day).alias("value_date"), F.when(good, amount).alias("amount"), F.when(good, direction).alias("direction"), F.when(good, F.lit("INR")).alias("currency"),
        F.when(good, F.substring(text, 1, MAX_RAW)).alias("description_raw"), F.lit(issuer.bank_code).alias("bank_code"), ledger.alias("ledger"), F.when(~good, F.substring(line, 1, MAX_RAW)).alias("errored_line"),
    )


def _card_rows(issuer: Issuer, lines: Column) -> Column:
    """With several layouts, a document is read by the first that gives it a row, else by the last."""
    tried = F.array(*(_card_lines(x, issuer, lines) for x in issuer.layouts))
    if len(issuer.layouts) == 1:
        return tried[0]
    good = lambda rows: F.exists(rows, lambda r: r["errored_line"].isNull())
    return bound(tried, lambda t: F.coalesce(F.get(F.filter(t, good), F.lit(0)), F.element_at(t, -1)))


def _ledger_amount(layout: LedgerLayout, p: Column) -> Column:
    if layout.amount:
        return parse_amount(p[layout.amount])
    paid, got = loose_amount(p[layout.withdrawal]), loose_amount(p[layout.deposit])
    return F.coalesce(F.when(paid != 0, paid), F.when(got != 0, got), paid, got)


_FIELDS = "struct<date:date,amount:decimal(38,10),balance:decimal(38,10),inline:string,serial:string>"


def _anchor(issuer: Issuer, line: Column) -> Column:
    """Fields of a line that has the shape of one of the layouts, the first that fits; else null."""

    def by(layout: LedgerLayout, otherwise: Column) -> Column:
        def fields(p: Column) -> Column:
            got = F.struct(
                parse_date(p[layout.date], layout.shape).alias("date"), _ledger_amount(layout, p).alias("amount"), parse_amount(p[layout.balance]).alias("balance"),
                trim(p[layout.text]).alias("inline"), (p[layout.serial] if layout.serial else F.lit("")).alias("serial"),
            )
            return F.when(F.size(p) > 1, got).otherwise(otherwise)

        return bound(parts(line, layout.row), fields)

    out = F.lit(None).cast(_FIELDS)
    for layout in reversed(issuer.layouts):
        out = by(layout, out)
    return out


def _ledger_rows(issuer: Issuer, lines: Column, opening: Column, words: Column | None) -> Column:
    """Anchor rows with balance, direction by balance change, and narration stitched from the lines around.

    The line just above an anchor belongs to it; those below, up to the line above the next
    anchor, as well. Lines that state a balance belong to none.
    """
    balances = [x for x in (issuer.opening, issuer.closing) if x]

    def whole(h: Column) -> Column:
        return h["f"].isNotNull() & h["f"]["date"].isNotNull() & h["f"]["amount"].isNotNull() & h["f"]["balance"].isNotNull()

    def usable(h: Column) -> Column:
        states = F.lit(False)
        for pattern in balances:
            states = states | h["t"].rlike(f"(?U){pattern}")
        return F.when(~whole(h) & (h["t"] != "") & ~states, h["t"])

    def rows(d: Column) -> Column:
        anchors, texts = d["anchors"], d["texts"]

        def row(a: Column, k: Column) -> Column:
            i, f, none = a["i"], a["f"], F.array().cast("array<string>")
            end = F.coalesce(F.get(anchors, k + 1)["i"] - 1, F.size(texts))
            around = F.concat(
                F.when(f["inline"] != "", F.array(f["inline"])).otherwise(none), F.when(i > 0, F.slice(texts, F.greatest(i, F.lit(1)), 1)).otherwise(none),
                F.slice(texts, i + 2, F.greatest(end - i - 1, F.lit(0))),
            )
            before = F.get(anchors, k - 1)["f"]["balance"]
            by_x = _direction_by_x(words, f["amount"], issuer.column_split) if words is not None and issuer.column_split is not None else F.lit(None).cast("string")
            first = F.when(opening.isNotNull(), F.when(f["balance"] < opening, F.lit(DEBIT)).otherwise(F.lit(CREDIT))).otherwise(F.coalesce(by_x, F.lit(DEBIT)))
            derived = F.when(first == DEBIT, f["balance"] + f["amount"]).otherwise(f["balance"] - f["amount"])
            prev = F.when(k > 0, before).otherwise(F.coalesce(opening, derived)).cast(MONEY)
            direction = F.when(k == 0, first).when(f["balance"] < before, F.lit(DEBIT)).otherwise(F.lit(CREDIT))
            source = F.when(k > 0, "BALANCE_DELTA").when(opening.isNotNull(), "OPENING_BALANCE").when(by_x.isNotNull(), "ROW1_X_POSITION").otherwise("ROW1_PROVISIONAL")
            delta = (f["balance"] - prev).cast(MONEY)
            same = f["amount"] == F.abs(delta)
            ledger = F.struct(f["balance"].alias("balance"), delta.alias("balance_delta"), same.alias("amount_matches_delta"), (~same).alias("is_suspect"), source.alias("direction_source"), f["serial"].alias("serial"))
            return _row(issuer, i, F.lit(None).cast("string"), F.lit(True), f["date"], f["amount"], direction, trim(F.array_join(around, " ")), ledger)

        none = F.lit(None)
        errored = F.transform(d["errored"], lambda h: _row(issuer, h["i"], h["x"], F.lit(False), none.cast("date"), none.cast(MONEY), none.cast("string"), none.cast("string"), none.cast(_LEDGER)))
        return F.concat(F.transform(anchors, row), errored)

    read = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), trim(x).alias("t"), _anchor(issuer, x).alias("f")))
    parted = bound(read, lambda r: F.struct(F.filter(r, whole).alias("anchors"), F.transform(r, usable).alias("texts"), F.filter(r, lambda h: h["f"].isNotNull() & ~whole(h)).alias("errored")))
    return bound(parted, rows)


def read_statements(docs: DataFrame, first_row_words: DataFrame | None = None) -> DataFrame:
    """One row per document of a known issuer: issuer, bank_code, header facts, rows and errored_lines.

    docs: doc_id, full_text, issuer. first_row_words has doc_id and words, the positioned words of
    the first anchor's line; with it a layout with two money columns can tell the first row's
    direction where no opening balance is printed. Rows have value_date, amount, direction,
    currency, description_raw, and for ledgers the struct ledger. A ledger's opening balance is the
    printed one or derived from its first row, its closing balance that of its last.
    """
    rows = docs.where(F.col("issuer").isin([i.id for i in ISSUERS]))
    if first_row_words is not None:
        rows = rows.join(first_row_words.select("doc_id", F.col("words").alias("_words")), "doc_id", "left")
    words = F.col("_words") if first_row_words is not None else None
    text, split = F.col("full_text"), F.split("full_text", "\n", -1)
    facts = {i.id: _facts(i, text) for i in ISSUERS}
    read = {i.id: _ledger_rows(i, split, facts[i.id]["printed_opening_balance"], words) if i.ledger else _card_rows(i, split) for i in ISSUERS}
    rows = rows.withColumns({"_rows": by_issuer(read), "_facts": by_issuer({k: F.struct(*(c.alias(n) for n, c in f.items())) for k, f in facts.items()})})
    good = F.filter("_rows", lambda r: r["errored_line"].isNull())
    rows = rows.select(*(c for c in docs.columns if c != "full_text"), good.alias("rows"), F.transform(F.array_sort(F.transform(F.filter("_rows", lambda r: r["errored_line"].isNotNull()), lambda r: F.struct(r["line_index"].alias("i"), r["errored_line"].alias("e")))), lambda r: r["e"]).alias("errored_lines"), "_facts.*")
    first, last = F.get("rows", F.lit(0)), F.get("rows", F.size("rows") - 1)
    derived = F.when(first["direction"] == DEBIT, first["ledger"]["balance"] + first["amount"]).otherwise(first["ledger"]["balance"] - first["amount"])
    return rows.withColumns({"printed_opening_balance": F.coalesce("printed_opening_balance", derived).cast(MONEY), "printed_closing_balance": F.coalesce(last["ledger"]["balance"], "printed_closing_balance")})


def by_issuer(values: dict[str, Column]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col("issuer") == k, v) if out is None else out.when(F.col("issuer") == k, v)
    return out


_ROW = ("line_index", "value_date", "amount", "direction", "currency", "description_raw", "bank_code")


def _exploded(docs: DataFrame, issuers: list[Issuer], words: DataFrame | None = None) -> DataFrame:
    split = F.split("full_text", "\n", -1)
    if words is not None:
        docs = docs.join(words.select("doc_id", F.col("words").alias("_words")), "doc_id", "left")
    w = F.col("_words") if words is not None else None
    read = {i.id: _ledger_rows(i, split, _facts(i, F.col("full_text"))["printed_opening_balance"], w) if i.ledger else _card_rows(i, split) for i in issuers}
    # The outer form: from the inner one a filter would be inferred that reads all documents a second time.
    return docs.select("doc_id", "issuer", F.explode_outer(by_issuer(read)).alias("r")).where("r is not null")


def read_cards(docs: DataFrame) -> DataFrame:
    """Rows of all card statements: doc_id, issuer, line_index, value_date, amount, direction, currency, description_raw, bank_code, errored_line.

    Rows that have the shape but not a date and an amount carry errored_line and nothing else.
    """
    rows = _exploded(docs, [i for i in ISSUERS if not i.ledger])
    return rows.select("doc_id", "issuer", *(F.col(f"r.{c}") for c in (*_ROW, "errored_line")))


def read_card(docs: DataFrame, issuer_id: str) -> DataFrame:
    """read_cards for documents of one issuer."""
    return _exploded(docs.withColumn("issuer", F.lit(issuer_id)), [BY_ID[issuer_id]]).select("doc_id", *(F.col(f"r.{c}") for c in (*_ROW, "errored_line")))


def read_ledgers(docs: DataFrame, first_row_words: DataFrame | None = None) -> DataFrame:
    """Rows of all bank ledgers: the columns of read_cards, and balance, balance_delta, amount_matches_delta, is_suspect, direction_source and serial."""
    rows = _exploded(docs, [i for i in ISSUERS if i.ledger], first_row_words)
    return rows.select("doc_id", "issuer", *(F.col(f"r.{c}") for c in (*_ROW, "errored_line")), "r.ledger.*")


def _direction_by_x(words: Column, amount: Column, split: float) -> Column:
    """By the place of the first word that prints the amount, the rightmost money word left out."""
    money = F.filter(words, lambda w: trim(w["text"]).rlike(r"^[\d,]+\.\d{2}$"))
    ranked = F.transform(money, lambda w, i: F.struct(w["x1"].alias("x1"), i.alias("i")))
    balance_at = F.array_max(ranked)["i"]
    indexed = F.transform(money, lambda w, i: F.struct(i.alias("i"), w["text"].alias("text"), ((w["x0"] + w["x1"]) / 2).alias("middle")))
    hit = F.filter(indexed, lambda w: (w["i"] != balance_at) & (parse_amount(w["text"]) == amount))
    middle = F.get(hit, F.lit(0))["middle"]
    return F.when(middle < split, F.lit(DEBIT)).when(middle.isNotNull(), F.lit(CREDIT))


def _facts(issuer: Issuer, text: Column) -> dict[str, Column]:
    """Statement-level facts: period, last four digits, printed totals and balances."""
    nothing_date, nothing = F.lit(None).cast("date"), F.lit(None).cast(MONEY)
    start = end = nothing_date
    for pattern in reversed(issuer.period):
        two = re.compile(pattern).groups > 1
        wide = f"(?U){pattern}"
        a, b = F.regexp_extract(text, wide, 1), F.regexp_extract(text, wide, 2 if two else 1)
        if issuer.month_year and "period from" in pattern:
            this_start, this_end = F.trunc(month_year_end(a), "month"), month_year_end(b)
        else:
            clean = (F.replace(x, F.lit(","), F.lit("")) if "Billing" in pattern else x for x in (a, b))
            this_start, this_end = (parse_date(x, *issuer.period_shapes) for x in clean)
        start = F.when(text.rlike(wide), this_start if two else nothing_date).otherwise(start)
        end = F.when(text.rlike(wide), this_end).otherwise(end)

    def amount(spec) -> Column:
        return parse_amount(F.regexp_extract(text, f"(?U){spec[0]}", spec[1])) if spec else nothing

    return {
        "bank_code": F.lit(issuer.bank_code), "period_start": start, "period_end": end,
        "card_last4": account_tail_last4(text, issuer.account) if issuer.account else find_last4(text, issuer.card_anchor),
        "printed_total_debits": amount(issuer.total_debits), "printed_total_credits": amount(issuer.total_credits),
        "printed_opening_balance": amount((issuer.opening, 1) if issuer.opening else None), "printed_closing_balance": amount((issuer.closing, 1) if issuer.closing else None),
    }


def period_end(statements: DataFrame) -> DataFrame:
    """statements as read, with the latest date of the rows where no end of the period is printed."""
    return statements.withColumn("period_end", F.coalesce("period_end", F.array_max(F.transform("rows", lambda r: r["value_date"]))))
