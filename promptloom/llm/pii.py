"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All offsets are code points of the whole text, the end exclusive. Patterns are possessive, so that
a long run of digits or letters is read once. Map-only: nothing is shuffled or broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm.words import slices, text_bytes

# The base kinds in their order, and the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Signs of an account code by country; one of another country has 15 to 34.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Score of a confirmed span, and words nearby that raise or lower it.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
NEAR_WORDS = {
    "email": {"mail": 0.1, "email": 0.1, "contact": 0.1, "write": 0.05, "noreply": -0.3},
    "ip": {"ip": 0.3, "address": 0.2, "host": 0.2, "server": 0.2, "version": -0.4, "release": -0.3},
    "card": {"card": 0.2, "visa": 0.2, "credit": 0.2, "payment": 0.1, "order": -0.2, "serial": -0.3, "isbn": -0.4},
    "phone": {"phone": 0.2, "call": 0.2, "tel": 0.2, "mobile": 0.2, "fax": 0.1, "version": -0.3},
    "iban": {"iban": 0.2, "account": 0.1, "bank": 0.1},
    "ssn": {"ssn": 0.5, "social": 0.3, "security": 0.3, "part": -0.3, "serial": -0.3},
}
#: Characters on either side of a span in which nearby words count.
NEAR_CHARS = 48
#: An added span needs this score; a base span stays whatever its score.
LEAST_SCORE = 0.5


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = (ord(c) - 48) << (k & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod_97(code: str) -> bool:
    """Whether an account code, its first four signs moved to the end, leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` decides for itself: the name goes back from it as far as it can, to the end of
    the match before at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def account_codes(text: str) -> Iterator[tuple[int, int]]:
    """Codes as long as their country has them, longest first where it isn't known; mod-97 confirms.
    A capital or digit may follow after a space, not at once."""
    m = _IBAN.search(text)
    while m:
        run, start = m.group(), m.start()
        ends = [k + 1 for k, sign in enumerate(run) if sign != " "]
        known = IBAN_LENGTHS.get(run[:2])
        end = None
        for length in (known,) if known else range(len(ends), 14, -1):
            if length <= len(ends):
                stop = start + ends[length - 1]
                after = text[stop : stop + 1]
                if not (after.isascii() and after.isalnum()) and mod_97(run[: ends[length - 1]].replace(" ", "")):
                    end = stop
                    break
        if end is not None:
            yield start, end
        m = _IBAN.search(text, start + 2 if end is None else end)


def _proposed(text: str) -> Iterator[tuple[int, int, str]]:
    for start, end in emails(text):
        yield start, end, "email"
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield m.start(), m.end(), "phone"
    for start, end in account_codes(text):
        yield start, end, "iban"
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.start(), m.end(), "ssn"


def score_of(text: str, start: int, end: int, kind: str) -> float:
    """Start score of the kind plus the weights of its words nearby, within 0 and 1."""
    near = f"{text[max(0, start - NEAR_CHARS) : start]} {text[end : end + NEAR_CHARS]}".lower()
    near_words = set(re.findall(r"[a-z]+", near))
    return min(1.0, max(0.0, START_SCORE[kind] + sum(w for word, w in NEAR_WORDS[kind].items() if word in near_words)))


def find(text: str) -> list[Span]:
    """All spans by start, then kind. Base spans always stay; added ones need the least score."""
    found = [Span(s, e, k, score_of(text, s, e, k)) for s, e, k in _proposed(text)]
    found = [f for f in found if f.kind in BASE_KINDS or f.score >= LEAST_SCORE]
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or stretch of spans that overlap, replaced by ``[KIND]``, again
    until none is found: what stood beside a span can be a span of its own without it."""
    while spans:
        text = _replaced(text, spans)
        spans = find(text)
    return text


def _replaced(text: str, spans: list[Span]) -> str:
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k].start, spans[k].end, spans[k].kind
        while k + 1 < len(spans) and spans[k + 1].start < end:
            k += 1
            end = max(end, spans[k].end)
        out += [text[at:start], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def _candidates(texts: pa.Array) -> np.ndarray:
    """Texts with a digit or an ``@``; no kind does without both."""
    data, ends = text_bytes(texts)
    seen = np.concatenate([[0], np.cumsum((data - np.uint8(48) < 10) | (data == 64))])
    return np.diff(seen[ends]) > 0


def _found(texts: pa.Array) -> list[list[Span]]:
    wanted = _candidates(texts)
    chosen = iter(texts.filter(pa.array(wanted)).to_pylist())
    return [find(next(chosen)) if w else [] for w in wanted.tolist()]


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), found (array of structs
    with kind, start, end, score) of every row.

    Null and empty texts hold nothing; repeated rows give repeated results; an empty table gives an
    empty one; other columns aren't read. Spans of different kinds may overlap; of one kind they
    don't. Ties by start are ordered by kind.
    """
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "found array<struct<kind: string, start: bigint, end: bigint, score: double>>"
    )
    span_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _found(batch["text"])
            base = [[s for s in f if s.kind in BASE_KINDS] for f in found]
            counts = [pa.array([sum(s.kind == kind for s in b) for b in base], pa.int64()) for kind in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    *counts,
                    pa.array([hashlib.sha256(_text_of(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_text_of(f) for f in found], pa.string()),
                    pa.array([[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in f] for f in found], pa.list_(span_type)),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "found"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the spans in ``text`` replaced by ``[KIND]``, and
    ``n_chars``, if it is a column, counted again where the text has changed. Null stays null."""
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _found(batch["text"])
            changed = np.array([bool(f) for f in found])
            if changed.any():
                texts = [redacted(t, f) if f else t for t, f in zip(batch["text"].to_pylist(), found)]
                columns = {n: batch[n] for n in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    sizes = [len(t) if f else n for t, f, n in zip(texts, found, batch["n_chars"].to_pylist())]
                    columns["n_chars"] = pa.array(sizes, batch["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names)
            yield batch

    return docs.mapInArrow(run, plain)
