"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Cases: a null text counts as empty and has no spans; null ids pass through; repeated rows
give repeated rows; other columns of the input are ignored by ``find`` and kept by ``mask``.
Every search is linear in the length of the text, so very long texts need no special path.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the contract.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Further kinds of this operator. They need a checksum, or a context word close by.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Score of a span by its pattern and checksum alone.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
#: Words that raise the score of a span when they stand within WINDOW characters of it.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that lower it: numbers of versions, sections and parts only look like personal data.
AGAINST = {"ip": ("version", "section", "release"), "card": ("isbn", "part"), "phone": ("isbn",)}
WINDOW, BONUS, MALUS, THRESHOLD = 48, 0.3, 0.3, 0.5

SPAN = "array<struct<kind:string,start:int,stop:int,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    value = iban.replace(" ", "")
    if not 15 <= len(value) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches. A match has one @, so each @ is tried with the run left of it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _propose(text: str, digits: bool):
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not digits:
        return
    for m in IP.finditer(text):
        # a part of four or more significant digits is over 255, and may be too long for int()
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        yield "ssn", *m.span()


_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _score(kind: str, text: str, start: int, stop: int) -> float:
    near = set(_WORD.findall(text[max(0, start - WINDOW) : start].lower()))
    near |= set(_WORD.findall(text[stop : stop + WINDOW].lower()))
    score = PRIOR[kind]
    score += BONUS * any(w in near for w in CONTEXT[kind])
    score -= MALUS * any(w in near for w in AGAINST.get(kind, ()))
    return round(min(1.0, max(0.0, score)), 6)


_ANY = re.compile("[0-9@]")
_ONE = re.compile("[0-9]")


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans of one text: (kind, start, stop, score), code points, stop exclusive.

    The kinds of the contract always stay; of the others, those scored THRESHOLD or more.
    """
    if not text or not _ANY.search(text):
        return []
    out = [(k, a, b, _score(k, text, a, b)) for k, a, b in _propose(text, bool(_ONE.search(text)))]
    out = [s for s in out if s[0] in BASE_KINDS or s[3] >= THRESHOLD]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans, kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in kinds)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind, overlapping spans by the first one's."""
    spans = sorted(spans_of(text), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    out, at = [], 0
    for kind, start, stop, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def pii_spans(text: Column) -> Column:
    """The spans of a text, as array<struct<kind, start, stop, score>>."""

    def each(texts: pd.Series) -> pd.Series:
        keys = ("kind", "start", "stop", "score")
        return texts.map(lambda t: [dict(zip(keys, s, strict=True)) for s in spans_of(t)])

    return F.pandas_udf(each, SPAN)(text)


def pii_masked(text: Column) -> Column:
    """The text with its spans replaced; a null text stays null."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(masked)

    return F.pandas_udf(each, "string")(text)


_FOUND = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans", "top_score"]
_FOUND_TYPE = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, top_score double"


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = spans_of(text)
        of = [s[0] for s in spans]
        base = joined(spans, BASE_KINDS)
        rows.append((*(of.count(k) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans), len(spans), max((s[3] for s in spans), default=0.0)))
    return pd.DataFrame(rows, columns=_FOUND)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, counts by kind, and its spans as text.

    Null and empty texts have zero counts and the digest of an empty string.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(_found, _FOUND_TYPE)(F.col(text)).alias("f")).select("doc_id", "f.*")


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with personal data in its text replaced by [KIND], and the length kept true."""
    done = docs.withColumn(text, pii_masked(F.col(text)))
    if n_chars in docs.columns:
        kind = dict(docs.dtypes)[n_chars]
        done = done.withColumn(n_chars, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(n_chars)).cast(kind))
    return done.select(docs.columns)
