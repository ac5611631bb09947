"""Narrations: normal forms, merchant portions and similarities, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of payment channels at the head of a narration.
CHANNEL_PREFIX = r"POS\s|UPI[-/]|NEFT/|IMPS/|ACH/|BIL/|RTGS/|INT\.PD\./|TO TRANSFER-|BY TRANSFER-"
#: Characters that end a segment, besides white space.
SEPARATORS = "-/\\|*:;,#_%()[]\"'"
#: Words that name a channel, an instrument or the scaffold of a narration.
STOP_WORDS = (
    "upi", "pos", "neft", "neftcr", "neftdr", "imps", "rtgs", "ach", "nach", "ecs", "ecm", "eft", "ift", "bil", "bbps", "atm",
    "tfr", "trf", "transfer", "transaction", "txn", "chq", "cheque", "inf", "mps", "ib", "imb", "onl", "online", "www", "net", "mobile",
    "ref", "refno", "rrn", "no", "dr", "cr", "cc", "card", "credit", "debit", "emi", "fee", "fees", "charge", "charges", "gst", "int",
    "payment", "payments", "pymt", "pmt", "paid", "recd", "received", "recvd", "autopay", "bpay", "purchase", "withdrawal", "cash",
    "thank", "you", "to", "by", "in", "ind", "at", "on", "for", "from", "via", "and", "the", "of",
)
PREFIX_CHARS = 60
MAX_SEGMENTS, REFERENCE_DIGITS = 2, 4

_SPACE = r"(?U)\s+"


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_description(text: Column) -> Column:
    """White space collapsed, upper case."""
    return F.upper(trim(F.regexp_replace(text, _SPACE, " ")))


def amount_text(amount: Column) -> Column:
    """Plain digits of a decimal without trailing zeros."""
    plain = amount.cast("string")
    return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def dedup_fingerprint(date: Column, amount: Column, description: Column, direction: Column) -> Column:
    return F.concat_ws("|", date.cast("string"), amount_text(amount.cast("decimal(38,10)")), normalize_description(description), direction)


def normalize_narration(text: Column) -> Column:
    """Without channel prefixes, RRN references and a trailing reference number; lower case."""
    out = F.regexp_replace(trim(text), rf"(?iU)^(?:(?:{CHANNEL_PREFIX})\s*)+", "")
    out = F.regexp_replace(out, r"(?iU)\bRRN\d+\b", "")
    out = F.regexp_replace(out, _SPACE, " ")
    out = F.regexp_replace(out, r"(?U)\b[0-9]{10,16}\b\s*$", "")
    return trim(F.lower(out))


def prefix60(normalized: Column) -> Column:
    return F.substring(normalized, 1, PREFIX_CHARS)


def merchant_portion(text: Column) -> Column:
    """The first two segments that can name a merchant, or null."""
    marks = "".join("\\" + c for c in SEPARATORS)
    segments = F.split(normalize_narration(text), rf"(?U)[\s{marks}]")
    # Discarded: one character or none; digits alone; four digits or more; a stop word.
    useful = F.filter(
        segments,
        lambda s: (F.length(s) > 1) & ~s.rlike("^[0-9]+$") & (F.length(F.regexp_replace(s, "[^0-9]", "")) < REFERENCE_DIGITS) & ~s.isin(*STOP_WORDS),
    )
    return F.transform(F.array(useful), lambda u: F.when(F.size(u) > 0, F.array_join(F.slice(u, 1, MAX_SEGMENTS), " ")))[0]


def tokens(text: Column) -> Column:
    """The distinct words of a text, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _SPACE), lambda t: t != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two token sets; 0 if either has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def narration_similarity(a: Column, b: Column) -> Column:
    return token_similarity(tokens(a), tokens(b))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity plus a tenth of what is missing for each of up to four equal first characters."""
    if a == b:
        jaro = 1.0
    elif not a or not b:
        jaro = 0.0
    else:
        reach = max(max(len(a), len(b)) // 2 - 1, 0)
        free = [True] * len(b)
        own: list[str] = []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
                if free[j] and b[j] == c:
                    free[j] = False
                    own.append(c)
                    break
        m = len(own)
        if m:
            other = [c for c, f in zip(b, free, strict=True) if not f]
            swaps = sum(x != y for x, y in zip(own, other, strict=True)) // 2
            jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0
        else:
            jaro = 0.0
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1.0 - jaro)


def may_be_alike(a: Column, b: Column, least: float) -> Column:
    """False only where jaro_winkler(a, b) is below least, by lengths and first characters alone.

    With all of the shorter text found in the longer one, Jaro is (2 + shorter / longer) / 3; four
    equal first characters add 0.4 of what is missing, none add nothing.
    """
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    bonus = F.when(F.left(a, F.lit(1)) == F.left(b, F.lit(1)), F.lit(0.4)).otherwise(F.lit(0.0))
    jaro = (F.lit(2.0) + ratio) / 3
    return (a == b) | (jaro + bonus * (1 - jaro) >= least - 1e-9)


#: Characters that a bag counts, up to four of each; what is beyond is counted together.
BAG = "abcdefghijklmnopqrstuvwxyz0123456789 -/.*_@#&:,%"


def letter_bag(text: Column) -> Column:
    """The characters of a text as three longs, four bits a character: as many bits set as it occurs, four at most."""
    longs = []
    for start in range(0, len(BAG), 16):
        bits = F.lit(0).cast("long")
        for slot, c in enumerate(BAG[start : start + 16]):
            times = F.least(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))), F.lit(4))
            unary = F.element_at(F.array(*(F.lit((1 << k) - 1).cast("long") for k in range(5))), times + 1)
            bits = bits.bitwiseOR(F.shiftleft(unary, 4 * slot))
        longs.append(bits)
    return F.array(*longs)


def bags_may_be_alike(a: Column, b: Column, bag_a: Column, bag_b: Column, least: float) -> Column:
    """False only where jaro_winkler(a, b) is below least, by the letters that two texts share.

    Jaro finds no more characters of one text in the other than both have; with unary counts that is the
    number of bits that both bags have, and at most all of what the bags don't count.
    """

    def size(of) -> Column:
        return F.bit_count(of(0)) + F.bit_count(of(1)) + F.bit_count(of(2))

    shared = size(lambda k: bag_a[k].bitwiseAND(bag_b[k]))
    rest = F.least(F.length(a) - size(lambda k: bag_a[k]), F.length(b) - size(lambda k: bag_b[k]))
    most = (shared + rest).cast("double")
    jaro = (most / F.greatest(F.length(a), F.lit(1)) + most / F.greatest(F.length(b), F.lit(1)) + F.lit(1.0)) / 3
    same = F.lit(0.0)
    for k in range(1, 5):
        same = same + F.when((F.left(a, F.lit(k)) == F.left(b, F.lit(k))) & (F.length(a) >= k) & (F.length(b) >= k), F.lit(0.1)).otherwise(F.lit(0.0))
    return (a == b) | (F.least(jaro, F.lit(1.0)) + same * (1 - F.least(jaro, F.lit(1.0))) >= least - 1e-9)


def jaro_winkler(a: Column, b: Column) -> Column:
    """The similarity of two texts; Spark has no built-in for it, so pairs go in Arrow batches."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(each, "double")(a, b)
