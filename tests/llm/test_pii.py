"""Spans against the plain patterns, run one by one over whole texts."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from coinloom.llm import pii


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(s: str) -> bool:
    pairs = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(s))]
    return sum(x // 10 + x % 10 for x in pairs) % 10 == 0


def plain(text: str) -> list[str]:
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def base(text: str) -> list[str]:
    return [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans_of(text) if k in pii.BASE_KINDS]


PIECES = st.sampled_from(["a@b.c", "@", "x.y@", "é", " ", ".", "-", "+", "1", "22", "255", "256", "0001", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "1.2.3.4", "GB82 WEST 1234 5698 7654 32", "\n", "😀", "a", "@@", "_%"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert base(text) == plain(text)


def test_whole_documents(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.find(docs).collect():
        want = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k + ":") for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r["spans"].split(","))


def test_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s[0] for s in pii.spans_of("IBAN GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert pii.spans_of("GB82 WEST 1234 5698 7654 33") == []
    assert [s[0] for s in pii.spans_of("my social security number 123-45-6789")] == ["ssn"]
    assert pii.spans_of("item 123-45-6789") == []
    near, far = pii.spans_of("server 10.0.0.1")[0][3], pii.spans_of("value 10.0.0.1")[0][3]
    assert near > far > pii.spans_of("version 10.0.0.1")[0][3]


def test_edges(edge_docs, no_docs):
    assert pii.find(edge_docs).count() == edge_docs.count()
    assert pii.find(no_docs).count() == 0
    masked = pii.mask(edge_docs)
    assert masked.columns == edge_docs.columns and masked.count() == edge_docs.count()
    row = masked.where("doc_id = 11").first()
    assert row["text"] == "mail [EMAIL] or [IP], card [CARD], [PHONE]" and row["n_chars"] == len(row["text"])
    assert masked.where("doc_id = 2").first()["text"] is None


def test_very_long_text_is_linear():
    assert len(pii.spans_of("1" * 300_000 + " a@b.co " + "." * 300_000 + "@" * 100_000)) == 1
