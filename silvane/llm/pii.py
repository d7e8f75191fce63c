"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Base kinds are email, ip, card and phone; the leftmost non-overlapping matches of each kind that pass
its validator always stay. Added kinds are iban (mod-97 confirms), ssn and national phone numbers
(``local``), which stay only if their score, adjusted by the words nearby, reaches a threshold. An iban
ends where its country's fixed length ends, so that words and numbers after it are not read as part of it.

Every matcher runs in time linear in the text: no pattern can restart inside a run that it has read.
Null and empty texts have no spans. Rows are independent, so repeated rows repeat; other columns play
no part. No shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import Span, digest, masked, ordered

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local")
#: Added spans of a lower score are dropped.
THRESHOLD = 0.6
#: Code points on either side of a span in which words adjust its score.
NEARBY = 48
#: Score of a confirmed proposal before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local": 0.4}
#: Words that raise a score by RAISE each kind once, and words that lower it.
RAISE, FALL = 0.3, 0.3
CONTEXT = {
    "email": {"mail", "email", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "client", "login"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "cvv"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "contact", "cell"},
    "iban": {"iban", "bank", "account", "transfer", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "local": {"phone", "call", "tel", "telephone", "mobile", "fax", "cell"},
}
AGAINST = {"version", "release", "isbn", "issn", "serial", "order", "invoice", "part", "chapter", "section"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+)])(?<!\+[0-9] )\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])")
#: Lengths of account numbers by country code.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(LENGTHS.values())}
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number, its first four characters moved to the end and letters as 10..35, is 1 modulo 97."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Each @ is tried once, with the whole run of local characters before it."""
    taken = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            taken = found.end()
            yield start, taken
        at = text.find("@", max(at + 1, taken))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) <= 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """Each country code and check number is tried once, with as many characters as its country's numbers have."""
    taken = 0
    for m in _IBAN.finditer(text):
        rest = _REST[LENGTHS[m[1]]].match(text, m.end()) if m.start() >= taken and m[1] in LENGTHS else None
        if rest and mod97(m[0] + rest[0]):
            taken = rest.end()
            yield m.start(), taken


class Taken:
    """Spans that others may not overlap: for each start, in order, how far any span up to it reaches."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, moved by the words on either side."""
    near = set(_WORD.findall((text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]).lower()))
    value = PRIOR[kind] + RAISE * bool(near & CONTEXT[kind]) - FALL * bool(near & AGAINST)
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, each in order."""
    base: list[Span] = []
    added: list[Span] = []
    if "@" in text:
        base += [Span("email", *s, score("email", text, *s)) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, matcher in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            base += [Span(kind, *s, score(kind, text, *s)) for s in matcher(text)]
        spans = lambda pattern: (m.span() for m in pattern.finditer(text))
        # Spans of one kind never overlap, so what is taken changes from kind to kind only.
        for kind, proposed in (("iban", _ibans(text)), ("ssn", spans(_SSN)), ("local", spans(_NATIONAL))):
            taken = Taken([(s.start, s.end) for s in base + added])
            added += [Span(kind, *s, value) for s in proposed if (value := score(kind, text, *s)) >= THRESHOLD and not taken.meets(*s)]
    return ordered(base, KINDS), ordered(added, KINDS)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, all spans with their scores, the digest of those of the base kinds, and, if ``with_text``, the text with the spans masked."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN), ("base_sha256", pa.string()), *([("masked", pa.string())] if with_text else [])])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, digests, texts = [], [], []
        for text in batch.column("text").to_pylist():
            base, added = find(text)
            all_spans = ordered(base + added, KINDS)
            spans.append([s._asdict() for s in all_spans])
            digests.append(digest(base))
            if with_text:
                texts.append(masked(text, all_spans) if all_spans else text)
        return common.batch_of(schema, doc_id=batch.column("doc_id"), spans=spans, base_sha256=digests, masked=texts)

    return common.map_batches(common.id_text(docs), each, f"doc_id long, spans {SPANS}, base_sha256 string" + ", masked string" * with_text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with spans masked and n_chars recounted; a null text stays null, other columns stay as they are."""
    text_at, names = docs.columns.index("text"), docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(text_at).to_pylist():
            found = [s for part in find(text) for s in part] if text else []
            out.append(masked(text, found) if found else text)
        columns = [pa.array(out, batch.schema.field(i).type) if i == text_at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    done = common.map_batches(docs, each, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done


def query(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the operator's spans."""
    found = find_pii(common.documents(spark, sf_dir), with_text=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *map(count, BASE), "base_sha256", F.concat_ws(",", name).alias("spans"))
