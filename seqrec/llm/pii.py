"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern, a validator and a starting score. Luhn (cards) and
mod-97 (account numbers) settle a proposal; other kinds check the ranges of
their parts. Words near a span raise its score ("card", "iban", "call") or
lower it ("version", "order"). Four base kinds (email, ip, card, phone) are
reported whenever their validator agrees, whatever the score; the further
kinds (iban, ssn, mac) only from ``THRESHOLD`` on.

All patterns run in time linear in the text: an address is found from its
``@`` outwards, an account number from its country code on within a bounded
run, and the others start only where a run of their characters starts and do
not back up.

Defined cases: null and empty texts have no spans; spans of one kind do not
overlap, spans of different kinds may; positions are code points, end
exclusive; repeated rows are answered row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm.common import column, fresh

# The base kinds in the order of reports.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "mac")
THRESHOLD = 0.5
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LETTER_OR_DIGIT = re.compile(r"[A-Za-z0-9]")
IBAN_LONGEST = 34
# Lengths of account numbers by country.
IBAN_LENGTHS = {code[:2]: int(code[2:]) for code in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 "
    "YE30").split()}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each @ with a domain, the local part reaches back to the last match at most."""
    done = 0
    for domain in _DOMAIN.finditer(text):
        start = at = domain.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = domain.end()
            yield start, done


def _found(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of international account numbers."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers from each country code on: as long as the country has them, or, for a country that is not
    listed, to the last end of a group at which the checksum holds."""
    at = 0
    while head := _IBAN_HEAD.search(text, at):
        start, at = head.start(), head.start() + 4
        run, places = [], []
        for place in range(start, min(len(text), start + 2 * IBAN_LONGEST)):
            c = text[place]
            if c in _IBAN_CHARS:
                run.append(c)
                places.append(place + 1)
            elif c != " " or text[place - 1] == " ":
                break
            if len(run) == IBAN_LONGEST:
                break
        country = IBAN_LENGTHS.get(text[start:start + 2])
        for n in [country] if country else range(IBAN_LONGEST, 14, -1):
            if n <= len(run) and not _LETTER_OR_DIGIT.match(text, places[n - 1]) and mod97("".join(run[:n])):
                at = places[n - 1]
                yield start, at
                break


def _small_parts(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def _card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _iban(text: str) -> bool:
    account = text.replace(" ", "")
    return 15 <= len(account) <= 34 and mod97(account)


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in {"000", "666"} and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Rule:
    kind: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    score: float
    raising: frozenset[str]
    lowering: frozenset[str]


# Patterns of the kinds, starting scores, and words that speak for or against them.
RULES = (
    Rule("email", _emails, lambda s: True, 0.9,
         frozenset(["email", "mail", "contact", "write", "kontakt", "correo", "courriel"]),
         frozenset(["noreply", "example"])),
    Rule("ip", _found(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), _small_parts, 0.6,
         frozenset(["ip", "address", "host", "server", "login", "adresse"]),
         frozenset(["version", "release", "section", "chapter"])),
    Rule("card", _found(r"[0-9](?:[ -]?[0-9])++"), _card, 0.8,
         frozenset(["card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"]),
         frozenset(["order", "invoice", "tracking", "isbn", "serial"])),
    Rule("phone", _found(r"\+[0-9][ ().0-9-]+[0-9]"), lambda s: 10 <= len(_digits(s)) <= 15, 0.7,
         frozenset(["phone", "call", "tel", "mobile", "fax", "telefon", "appelez", "llame"]),
         frozenset(["version", "score", "offset"])),
    Rule("iban", _ibans, _iban, 0.8,
         frozenset(["iban", "account", "bank", "konto", "compte", "cuenta"]), frozenset(["serial", "part"])),
    Rule("ssn", _found(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn, 0.3,
         frozenset(["ssn", "social", "security", "taxpayer"]), frozenset(["part", "order", "serial"])),
    Rule("mac", _found(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
         lambda s: len(set(s)) > 2, 0.4,
         frozenset(["mac", "ethernet", "device", "adapter", "hardware"]), frozenset(["checksum", "hash"])),
)
RAISE, LOWER = 0.3, 0.3


def _context(text: str, start: int, end: int) -> set[str]:
    near = text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]
    return {w.lower() for w in _WORD.findall(near)}


def scan(text: str | None) -> list[Span]:
    """All spans of a whole text by start, then by the order of the kinds."""
    text, spans = text or "", []
    for rule in RULES:
        for start, end in rule.propose(text):
            if not rule.confirm(text[start:end]):
                continue
            words = _context(text, start, end)
            score = rule.score + RAISE * bool(words & rule.raising) - LOWER * bool(words & rule.lowering)
            if rule.kind in BASE_KINDS or score >= THRESHOLD:
                spans.append(Span(start, end, rule.kind, round(min(1.0, max(0.0, score)), 2)))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("score", pa.float64())]))


def spans(text: Column) -> Column:
    """The spans of a text column, as an array of structs in order."""
    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[vars(s) for s in scan(t.as_py())] for t in texts], _ARROW)

    return find.asNondeterministic()(text)


def find(docs: DataFrame, text: str = "text", spans_as: str = "spans") -> DataFrame:
    """All columns of ``docs`` and the spans; a clashing name gets an underscore more."""
    (name,) = fresh(docs, spans_as)
    return docs.withColumn(name, spans(column(text)))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if text is None:
        return None
    out, done = [], 0
    for span in scan(text):
        if span.start >= done:
            out += [text[done:span.start], f"[{span.kind.upper()}]"]
        done = max(done, span.end)
    return "".join([*out, text[done:]])


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
