"""Layouts of the statements that can be read: fixed values, one entry an issuer.

Row patterns name their groups by number: date, text, amount and so on say which group holds
what, 0 that a layout has none.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CardLayout:
    """One row per line. marker: group of a Dr/Cr cell; plus: group whose presence makes a credit."""

    row: str
    date: int
    text: int
    amount: int
    #: Shape of the dates (a name in parsing.SHAPES).
    shape: str
    marker: int = 0
    plus: int = 0
    #: Wording decides the direction where there is no marker.
    worded: bool = True


@dataclass(frozen=True)
class LedgerLayout:
    """Anchor lines with a running balance, and narration on the lines around."""

    row: str
    date: int
    text: int
    balance: int
    shape: str
    serial: int = 0
    amount: int = 0
    withdrawal: int = 0
    deposit: int = 0


@dataclass(frozen=True)
class Issuer:
    id: str
    display_name: str
    bank_code: str
    ledger: bool
    layouts: tuple
    #: The document is claimed if it has all of the first and, if there are any, one of the second.
    claim_all: tuple[str, ...] = ()
    claim_any: tuple[str, ...] = ()
    #: The markers must stand in the header, and name the product.
    product_proven: bool = False
    opening: str | None = None
    closing: str | None = None
    #: Where two money columns part, in points.
    column_split: float | None = None
    #: Period: patterns of one date (the end) or two.
    period: tuple[str, ...] = ()
    #: Shapes of the period's dates, and whether they may be like Mar-25.
    period_shapes: tuple[str, ...] = ()
    month_year: bool = False
    total_debits: tuple[str, int] | None = None
    total_credits: tuple[str, int] | None = None
    card_anchor: str | None = None
    account: str | None = None


_M = r"([\d,]+\.\d{2})"
_SUMMARY = rf"(?is)ACCOUNT SUMMARY\b.*?([\d,]+(?:\.\d+)?)\s+{_M}\s+{_M}\s+([\d,]+(?:\.\d+)?)\s+([\d,]+(?:\.\d+)?)"

ISSUERS = (
    Issuer(
        "AU_BANK", "AU Small Finance Bank Account", "AU", True,
        (LedgerLayout(rf"^(\d{{2}} [A-Za-z]{{3}} \d{{4}})\s+\d{{2}} [A-Za-z]{{3}} \d{{4}}\s+(.*?)\s*([\d,]+\.\d{{2}}|-)\s+([\d,]+\.\d{{2}}|-)\s+{_M}\s*$", 1, 2, 5, "d mon y", withdrawal=3, deposit=4),),
        ("aubank.in",), ("Savings Account", "Current Account"),
        opening=rf"(?i)Opening Balance\s*\([^)]*\)\s*:\s*{_M}", closing=rf"(?i)Closing Balance\s*\([^)]*\)\s*:\s*{_M}",
        period=(r"(?i)Statement Period\s*:\s*(\d{2} [A-Za-z]{3} \d{4})\s+to\s+(\d{2} [A-Za-z]{3} \d{4})",), period_shapes=("d mon y",),
        account=r"(?i)Account\s+Number\s*:?\s*X*([0-9]{6,})",
    ),
    Issuer(
        "FEDERAL_BANK", "Federal Bank Account", "FEDERAL", True,
        (
            LedgerLayout(rf"(?i)^(\d{{2}}-[A-Za-z]{{3}}-\d{{4}})\s+\d{{2}}-[A-Za-z]{{3}}-\d{{4}}\s+(.*?)(?:\s+(S\d+))?\s+{_M}\s+{_M}\s+(?:Cr|Dr)\s*$", 1, 2, 5, "d-mon-y", serial=3, amount=4),
            LedgerLayout(rf"(?i)^(\d{{2}}/\d{{2}}/\d{{4}})\s+\d{{2}}/\d{{2}}/\d{{4}}\s+(.*?)(?:\s+(S\d+))?\s+([\d,]+(?:\.\d{{2}})?)\s+([\d,]+(?:\.\d{{2}})?)\s+{_M}\s+(?:Cr|Dr)\s*$", 1, 2, 6, "d/m/y", serial=3, withdrawal=4, deposit=5),
        ),
        ("Federal Bank", "Statement of Account"),
        opening=rf"(?i)Opening Balance\s+(?:[A-Z]+\s+)?{_M}",
        period=(r"(?i)for the period(?:\s+of)?\s+(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})\s+to\s+(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})",), period_shapes=("y-m-d", "d/m/y"),
        account=r"(?i)Account\s+Number\s*:?\s*X*([0-9]{4,})",
    ),
    Issuer(
        "HDFC_BANK", "HDFC Bank Account", "HDFC", True,
        (
            LedgerLayout(rf"^(\d{{2}}/\d{{2}}/\d{{2}})\s+(.*?)\s+([A-Za-z0-9]{{6,}})\s+\d{{2}}/\d{{2}}/\d{{2}}\s+{_M}\s+{_M}\s*$", 1, 2, 5, "d/m/y", serial=3, amount=4),
            LedgerLayout(rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.*?)\s+{_M}\s+{_M}\s+{_M}\s*$", 1, 2, 5, "d/m/y", withdrawal=3, deposit=4),
        ),
        ("HDFC",), ("WithdrawalAmt", "Savings Account Details", "Statementof account"),
        opening=rf"(?i)(?:Opening Balance\s*:\s*|OpeningBalance\b[^\n]*\n\s*){_M}",
        period=(r"(?i)From\s*:\s*(\d{2}/\d{2}/\d{4})\s+To\s*:?\s*(\d{2}/\d{2}/\d{4})",), period_shapes=("d/m/y",),
        account=r"(?i)Account\s*(?:Number|No\.?)\s*:?\s*X*([0-9]{4,})",
    ),
    Issuer(
        "ICICI_BANK", "ICICI Bank Account", "ICICI", True,
        (LedgerLayout(rf"^(\d{{1,4}})\s+(\d{{2}}\.\d{{2}}\.\d{{4}})(?:\s+\d{{2}}\.\d{{2}}\.\d{{4}})?\s+(.*?)\s*{_M}\s+{_M}\s*$", 2, 3, 5, "d.m.y", serial=1, amount=4),),
        ("Statement of Transactions", "ICICI"), ("Saving", "Current"),
        opening=rf"(?i)(?:Opening Balance|BALANCE\s+B/F|B/F)\s+{_M}", closing=rf"(?i)Closing Balance\s+{_M}", column_split=400.0,
        period=(r"(?i)([A-Za-z]+ \d{1,2}, \d{4})\s+to\s+([A-Za-z]+ \d{1,2}, \d{4})",), period_shapes=("mon d, y",),
        account=r"(?i)Account\s+(?:Number|No\.?)\s*:?\s*([0-9]{6,})",
    ),
    Issuer(
        "FEDERAL_SCAPIA_CARD", "Scapia Credit Card", "FEDERAL", False,
        (CardLayout(rf"^(\d{{2}}-\d{{2}}-\d{{4}})[ ]*[^\d\s]?[ ]*\d{{2}}:\d{{2}}\s+(.+?)\s+(\+)?₹{_M}$", 1, 2, 4, "d-m-y", plus=3),),
        claim_any=("Scapia", "Federal Bank"),
        period=(r"(\d{1,2}[ ]?[A-Za-z]{3}[ ]?\d{4})\s*-\s*(\d{1,2}[ ]?[A-Za-z]{3}[ ]?\d{4})",), period_shapes=("d mon y", "dmony"),
    ),
    Issuer(
        "HDFC_SWIGGY_CARD", "HDFC Swiggy Credit Card", "HDFC", False,
        (
            CardLayout(rf"^(\d{{2}}-[A-Za-z]{{3}}-\d{{4}})\s+(.+?)\s+{_M}\s+(DR|CR)\b", 1, 2, 3, "d-mon-y", marker=4),
            CardLayout(rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s*\|?\s*\d{{1,2}}:\d{{2}}\s+(.+?)\s+(\+\s*)?C\s*{_M}\b", 1, 2, 4, "d/m/y", plus=3, worded=False),
        ),
        claim_any=("HDFC Bank Credit Card", "HDFC Bank Credit Cards"), product_proven=True,
        period=(r"(?i)period from\s+([A-Za-z]+-\d{2})\s+to\s+([A-Za-z]+-\d{2})", r"(?i)Billing Period\s+(\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4})\s*-\s*(\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4})"), period_shapes=("d mon y",),
        month_year=True, card_anchor="Card Number",
    ),
    Issuer(
        "ICICI_AMAZONPAY_CARD", "ICICI Amazon Pay Credit Card", "ICICI", False,
        (CardLayout(rf"^(\d{{2}}/\d{{2}}/\d{{4}})\d*\s+(.+?)(?:\s+\d+)?\s+{_M}(?:\s+(CR))?$", 1, 2, 3, "d/m/y", marker=4),),
        claim_any=("ICICI Bank",), period=(r"\b([A-Z][a-z]{2,8} \d{1,2}, \d{4})\b",), period_shapes=("mon d, y",),
    ),
    Issuer(
        "IOB_RUPAY_CARD", "IOB RuPay Credit Card", "IOB", False,
        (CardLayout(rf"^(\d{{2}}-[A-Za-z]{{3}}-\d{{4}})\s+(.+?)\s+{_M}\s+(Dr|Cr)$", 1, 2, 3, "d-mon-y", marker=4),),
        claim_any=("INDIAN OVERSEAS BANK", "iobnet.co.in"), period=(r"(?i)Stmt Date\s*:\s*(\d{2}-[A-Za-z]{3}-\d{4})",), period_shapes=("d-mon-y",),
        total_debits=(_SUMMARY, 3), total_credits=(_SUMMARY, 2), card_anchor="Credit Card Number",
    ),
    Issuer(
        "SBI_CASHBACK_CARD", "SBI Cashback Credit Card", "SBI", False,
        (CardLayout(rf"^(\d{{2}} [A-Za-z]{{3}} \d{{2}})\s+(.+?)\s+{_M}\s+([CD])$", 1, 2, 3, "d mon y", marker=4),),
        claim_any=("SBI Card", "GSTIN of SBI Card"), period=(r"(?i)Statement Period:\s*(\d{2} [A-Za-z]{3} \d{2})\s+to\s+(\d{2} [A-Za-z]{3} \d{2})",), period_shapes=("d mon y",),
        card_anchor="Credit Card Number",
    ),
    Issuer(
        "YES_KIWI_CARD", "Kiwi (YES Bank) Credit Card", "YES", False,
        (CardLayout(rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.+?)\s+{_M}\s+(Dr|Cr)$", 1, 2, 3, "d/m/y", marker=4),),
        claim_any=("YES BANK",), period=(r"(?i)(\d{2}/\d{2}/\d{4})\s+To\s+(\d{2}/\d{2}/\d{4})",), period_shapes=("d/m/y",),
        total_debits=(rf"(?i)Purchases[^\n]*?Rs\.?\s*{_M}\s*Dr", 1), total_credits=(rf"(?i)Payment\s*&?\s*Credits Received[^\n]*?Rs\.?\s*{_M}\s*Cr", 1),
        card_anchor="Card Number",
    ),
)

BY_ID = {i.id: i for i in ISSUERS}
#: A line with a date and an amount is a row and says nothing about the issuer.
ROW_DATE = r"\d{2}/\d{2}/\d{4}|\d{2}/\d{2}/\d{2}|\d{2}-[A-Za-z]{3}-\d{4}"
ROW_AMOUNT = r"[\d,]+\.\d{2}"
HEADER_LINES = 15
MAX_RAW = 240
