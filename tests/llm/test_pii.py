"""Personal data: base kinds against plain patterns, checksums, context words, odd rows."""

import hashlib
import random
import re

import pytest

from seqrec.llm import pii, queries

rng = random.Random(9)
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for at, d in enumerate(reversed(digits)):
        value = int(d) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def base_of(text):
    return [(s.kind, s.start, s.end) for s in pii.scan(text) if s.kind in pii.BASE_KINDS]


def test_base_kinds_equal_plain_patterns():
    pieces = ["@", ".", "a", "Z9", "-", "+1", "+", " ", "(", ")", "12", "255", "1.2.3.4", "4111 1111 1111 1111", "é", "_",
              "x@y.z", "%", "\n", "5500-0000-0000-0004", "0" * 20, "256"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert base_of(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "a@", "+1", "1 ", "A1", "+1(", "11:"):
        assert len(pii.scan(unit * 200_000 + "@")) < 10**6


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    found = {s.kind for s in pii.scan("IBAN GB82 WEST 1234 5698 7654 32 and DE89 3704 0044 0532 0130 01")}
    assert "iban" in found and sum(s.kind == "iban" for s in pii.scan("DE89370400440532013001")) == 0


@pytest.mark.parametrize("account", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947",
                                     "DE89 3704 0044 0532 0130 00", "MT84MALT011000012345MTLCAST001S"])
@pytest.mark.parametrize("after", ["", " Please pay", " BIC COBADEFF", " 50 EUR", " Thanks", ", B", "\nA1", " and", " DE12 3456"])
def test_account_numbers_end_where_they_end(account, after):
    text = f"IBAN {account}{after}"
    found = [text[s.start:s.end] for s in pii.scan(text) if s.kind == "iban"]
    assert found == [account]
    assert not any(s.kind == "iban" for s in pii.scan(f"IBAN {account}X{after}"))
    two = f"{account} {account}{after}"
    assert sum(s.kind == "iban" for s in pii.scan(two)) == 2


def test_account_numbers_of_other_countries():
    digits = next(f"ZZ{n:02}12345678901234" for n in range(2, 99) if pii.mod97(f"ZZ{n:02}12345678901234"))
    assert [(s.start, s.end) for s in pii.scan(f"{digits} Please") if s.kind == "iban"] == [(0, len(digits))]
    assert len(pii.scan("AB12 " * 200_000)) < 10**6


def test_context_words_move_the_score():
    def scores(text):
        return [(s.kind, s.score) for s in pii.scan(text)]

    assert scores("my ssn is 123-45-6789") == [("ssn", 0.6)] and scores("item 123-45-6789") == []
    assert scores("server 10.0.0.1") == [("ip", 0.9)] and scores("version 10.0.0.1") == [("ip", 0.3)]
    assert scores("call +1 (555) 555-0100") == [("phone", 1.0)]


def test_redaction():
    assert pii.redact("mail a.b@c.org now") == "mail [EMAIL] now" and pii.redact(None) is None


def test_odd_rows(odd_docs, no_docs):
    found = pii.find(odd_docs)
    assert found.columns == [*odd_docs.columns, "spans_"] and found.count() == odd_docs.count()
    assert all(r["spans_"] == [] for r in found.collect())
    assert pii.find(no_docs).count() == 0


def test_query(spark, sf_dir):
    got = queries.op6_pii(spark, sf_dir).collect()
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(rows)
    for r in got:
        base = plain_base(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


@pytest.mark.parametrize("text", [None, ""])
def test_nothing_in_nothing(text):
    assert pii.scan(text) == []
