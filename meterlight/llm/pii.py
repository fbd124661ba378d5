"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Spans count code points, ends are exclusive. The four base kinds follow fixed patterns and always
stay, whatever their score. Two kinds are added: ``iban`` (confirmed by mod-97) and ``ssn``
(group rules, and a score that needs a word such as "ssn" nearby).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from meterlight.llm.arrow_text import map_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40
KEEP_SCORE = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A match ends with a whole run of digits, so a match can begin at the first digit of a run only.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

# Score of a confirmed match without any context, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
}
LOWERING = ("example", "version", "sample", "test")
RAISE, LOWER = 0.3, 0.2


class Span(NamedTuple):
    kind: str
    begin: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a number's last digit is its Luhn check digit."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number without blanks leaves 1 by the ISO 7064 rule."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(found: str) -> str:
    return "".join(c for c in found if c.isdigit())


def _byte(part: str) -> bool:
    number = part.lstrip("0") or "0"
    return len(number) <= 3 and int(number) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" with the run of local characters before it and a domain after it.

    A match begins where that run does, or where the match before ended; looking back from each
    "@" keeps the work linear also in texts without blanks.
    """
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and _LOCAL.match(text, begin - 1, begin):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        last = domain.end() if domain else at + 1
        if domain:
            yield begin, domain.end()
        at = text.find("@", last)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, leftmost and not overlapping within a kind."""
    if "@" in text:
        for begin, end in _emails(text):
            yield "email", begin, end
    if not _DIGIT.search(text):
        return
    for found in _IP.finditer(text):
        if all(_byte(part) for part in found[0].split(".")):
            yield "ip", *found.span()
    for found in _CARD.finditer(text):
        digits = _digits(found[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *found.span()
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(_digits(found[0])) <= 15:
                yield "phone", *found.span()
    for found in _IBAN.finditer(text):
        code = found[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", *found.span()
    for found in _SSN.finditer(text):
        area, group, serial = found[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *found.span()


def _near(text: str, begin: int, end: int) -> set[str]:
    around = text[max(0, begin - CONTEXT_CHARS) : begin] + " " + text[end : end + CONTEXT_CHARS]
    return set(re.findall(r"[a-z]+", around.lower()))


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by kind, then place, each with its score from 0 to 1.

    Added kinds whose score stays below ``KEEP_SCORE`` are left out. Null is an empty text.
    """
    found = []
    for kind, begin, end in proposals(text or ""):
        near = _near(text, begin, end)
        score = PRIOR[kind] + RAISE * any(word in near for word in CONTEXT[kind])
        score = min(1.0, max(0.0, score - LOWER * any(word in near for word in LOWERING)))
        if kind in BASE_KINDS or score >= KEEP_SCORE:
            found.append(Span(kind, begin, end, round(score, 3)))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{span.kind}:{span.begin}:{span.end}" for span in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span's place taken by its kind in brackets; of overlapping ones the first."""
    out, last = [], 0
    for span in sorted(spans, key=lambda span: (span.begin, -span.end)):
        if span.begin >= last:
            out += [text[last : span.begin], f"[{span.kind}]"]
            last = span.end
    return "".join([*out, text[last:]])


_SPANS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
    )
)


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts of the base kinds, digests, spans and the spans' scores.

    Works text by text without a shuffle; a text is searched whole. Null and empty texts have no
    span, repeated rows are searched each, an empty table gives an empty result. Only the columns
    ``id`` and ``text`` are read. Columns: n_email, n_ip, n_card, n_phone; base_sha256 of the
    joined base spans; spans (all kinds, joined); found (kind, begin, end, score).
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [find_spans(text) for text in texts]
            base = [[span for span in row if span.kind in BASE_KINDS] for row in spans]
            columns = [batch.column(0)]
            for kind in BASE_KINDS:
                columns.append(
                    pa.array([sum(s.kind == kind for s in row) for row in base], pa.int64())
                )
            digests = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
            columns.append(pa.array(digests, pa.string()))
            columns.append(pa.array([joined(row) for row in spans], pa.string()))
            columns.append(pa.array([[s._asdict() for s in row] for row in spans], _SPANS))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind_of_id = dict(docs.dtypes)[id]
    names = ["_id", *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans", "found"]
    schema = (
        f"_id {kind_of_id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,"
        " spans string, found array<struct<kind:string,begin:long,end:long,score:double>>"
    )
    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))
    return map_batches(rows, search, schema).withColumnRenamed("_id", id)
