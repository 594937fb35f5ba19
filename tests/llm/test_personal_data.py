"""Operator 11 against its contract's patterns, run as they are, and against planted cases."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import Row

from letterloom.llm import personal, queries

SF = "/root/testdata/sf0.001"
KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), KINDS.index(k), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m.group())]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_on_hostile_texts():
    rng = random.Random(3)
    alphabets = ["a.@-b", "0123456789", "12.@", "0 -4", "+1 (2).-3", "a1@.+- _%\n", "é1 +@.ab", "0255.13"]
    for _ in range(4_000):
        text = "".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.3 else alphabets[_ % len(alphabets)]) for _ in range(rng.randint(0, 60)))
        got = [(s.kind, s.start, s.end) for s in personal.spans(text) if s.base]
        assert got == base(text), text


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "+" + "1(" * 150_000, "a@b" * 100_000, ":" * 300_000, "AB12" * 75_000, "1-" * 150_000):
        personal.spans(text)


def test_contract(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in queries.op11_personal_data(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, text in docs:
        want = base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[doc]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("my IBAN is DE89 3704 0044 0532 0130 00 THE end", "iban", "DE89 3704 0044 0532 0130 00"),
        ("GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("number 123-45-6789 here", "ssn", "123-45-6789"),
        ("call (377) 555-0271 now", "phone", "(377) 555-0271"),
        ("write to jane.doe [at] example [dot] com", "email", "jane.doe [at] example [dot] com"),
        ("host 2001:db8::8a2e:370:7334 is down", "ip6", "2001:db8::8a2e:370:7334"),
    ],
)
def test_further_spans(text, kind, value):
    assert [(s.kind, text[s.start : s.end]) for s in personal.spans(text) if not s.base] == [(kind, value)]


@pytest.mark.parametrize("text", ["", "DE89 3704 0044 0532 0130 01", "000-12-3456", "it was 377 555-0271 of them", "at 12:30:45 and 1:2", "see version 1.2.3", "we met at ten dot com"])
def test_clean_texts(text):
    assert personal.spans(text) == []


def test_context_changes_scores():
    score = lambda t: next(s.score for s in personal.spans(t) if s.kind == "card")
    plain, near, other = (score(t.format("4111 1111 1111 1111")) for t in ("{}", "credit card {}", "invoice {}"))
    assert other < plain < near


def test_rows(spark):
    rows = [Row(text=None, doc_id=1, spans=5, n_email="x"), Row(text="", doc_id=None, spans=5, n_email="x"), Row(text="a@b.c", doc_id=2, spans=5, n_email="x"), Row(text="é a@b.c", doc_id=2, spans=None, n_email=None)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, spans int, n_email string")
    got = [(r["doc_id"], r["n_email"], r["spans"]) for r in personal.report(personal.find_personal_data(docs)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, ""), (None, 0, ""), (2, 1, "email:0:5"), (2, 1, "email:2:7")], key=str)
    assert [r["text"] for r in personal.masked(docs).collect()] == [None, "", "[EMAIL]", "é [EMAIL]"]
    assert personal.report(personal.find_personal_data(docs.limit(0))).collect() == []
