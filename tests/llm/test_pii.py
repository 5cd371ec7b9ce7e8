import hashlib
import random
import re

import pytest

from promptloom.llm import pii
from promptloom.llm.queries import QUERIES

from .conftest import rows_of, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def luhn(number):
    value = [int(c) for c in number][::-1]
    return (sum(value[::2]) + sum(sum(divmod(2 * v, 10)) for v in value[1::2])) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in text.split(".")) if kind == "ip" else None,
        "card": 14 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def plain(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(spans)


def expected(rows):
    found = []
    for i, text in rows:
        spans = plain(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        counts = [sum(s[2] == k for s in spans) for k in PATTERNS]
        found.append((i, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(found, key=repr)


def odd_texts():
    draw = random.Random(5)
    signs = ["a", "b.c", "@", ".", "x@y.z", "+1", " (", ")", "-", " ", "4111111111111111", "255", "256", "1.2.3.4", "0", "00000000000001",
             "é", "%", "555-0100", "\n", "..", "@@", "９", "+49 30 1234567"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 25))) for _ in range(3000)]
    return texts + ["1" * 40000, "a" * 40000 + "@", "a@" * 5000, "1." * 9000, "+1" * 5000, "1 " * 9000, None, ""]


def test_base_spans_as_the_patterns(spark):
    rows = list(enumerate(odd_texts()))
    rows += rows[:3]
    assert rows_of(pii.report(table(spark, rows)), *NAMES) == expected([(i, t if t is None or len(t) < 9000 else None) for i, t in rows if t is None or len(t) < 9000] + [(i, t) for i, t in rows if t and len(t) >= 9000])


def test_query(spark, sf):
    stored = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op2_pii"](spark, sf)
    assert rows_of(found, *NAMES) == expected(stored)
    assert found.where("n_email + n_ip + n_card + n_phone > 0").count() > 0
    assert pii.report(table(spark, [])).count() == 0


def test_added_kinds_and_context():
    assert [s.kind for s in pii.find("IBAN DE89 3704 0044 0532 0130 00 is mine")] == ["iban"]
    assert pii.find("DE89 3704 0044 0532 0130 01") == []
    assert [s.kind for s in pii.find("his social security number is 123-45-6789")] == ["ssn"]
    assert pii.find("part 123-45-6789") == []
    near, far = pii.find("my card 4111111111111111!")[0], pii.find("serial 4111111111111111!")[0]
    assert near.score > far.score
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


@pytest.mark.parametrize("text", ["", "a", "mail me: x.y@z.org, or +1 (017) 555-7713.", "9.9.9.9", "4111 1111 1111 1111 1.2.3.4"])
def test_redaction_leaves_no_base_span(text):
    assert plain(pii.redacted(text, pii.find(text))) == []


def test_redacted_rows_keep_their_columns(spark):
    docs = table(spark, [(1, "write to a@b.cd now"), (2, None), (3, "clean"), (3, "clean")])
    done = pii.redact(docs)
    assert done.schema.simpleString() == docs.schema.simpleString()
    rows = rows_of(done, "doc_id", "text", "n_chars", "score")
    assert rows == [(1, "write to [EMAIL] now", 20, 0.5), (2, None, None, 0.5), (3, "clean", 5, 0.5), (3, "clean", 5, 0.5)]


def test_account_codes_end_with_their_country_s_length():
    for text in (
        "DE89 3704 0044 0532 0130 00 is my account",
        "Account DE89 3704 0044 0532 0130 00 IBAN",
        "GB82WEST12345698765432 OK",
        "IBAN: DE89370400440532013000 BIC COBADEFF",
        "pay AB12 DE89 3704 0044 0532 0130 00 7 EUR",  # a false beginning before it, digits behind
        "NO93 8601 1117 947",
    ):
        (start, end), = pii.account_codes(text)
        assert pii.mod_97(text[start:end].replace(" ", "")) and text[start:end][:2] in ("DE", "GB", "NO")
        assert len(text[start:end].replace(" ", "")) == pii.IBAN_LENGTHS[text[start : start + 2]]
        assert [s for s in pii.find("account " + text) if s.kind == "iban"]
    for text in ("DE89 3704 0044 0532 0130 01", "DE89370400440532013000X", "xDE89370400440532013000", "DE89 3704"):
        assert not list(pii.account_codes(text))
    code = "ZZ" + str(98 - int("0" * 16 + "353500") % 97).zfill(2) + "0" * 16  # no known country
    assert list(pii.account_codes(f"{code} ABC")) == [(0, 20)]
    assert not list(pii.account_codes("AB12 " * 20000))  # read in pieces of bounded size
