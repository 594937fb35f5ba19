"""The value audit of agg_audit: all verdicts, totals and shares, as the standard library finds them."""

import difflib
import re
from collections import Counter

import __spark_entry__
from letterloom.functions import rules, text, validate
from letterloom.sources.letters import records

MONTHS = dict(enumerate(("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember"), 1))


def norm(value):
    return re.sub(r"[^a-z0-9/]+", " ", (value or "").lower()).strip()


def sought(value, t):
    v = norm(value)
    if not v:
        return "empty"
    if v in t or v.replace(" ", "") in t.replace(" ", ""):
        return "found"
    return "similar" if difflib.SequenceMatcher(None, t, v).find_longest_match(0, len(t), 0, len(v)).size / len(v) >= 0.85 else "not_found"


def variants(iso):
    m = re.match(r"(\d{4})-(\d{2})-(\d{2})", iso)
    if not m or int(m[2]) not in MONTHS:
        return []
    y, mm, dd, d, name = m[1], m[2], m[3], str(int(m[3])), MONTHS[int(m[2])]
    return [norm(v) for v in (f"{d} {name} {y}", f"{dd} {name} {y}", f"{name} {d} {y}", f"{d}-{mm}-{y}", f"{dd}-{mm}-{y}", f"{d}/{mm}/{y}", f"{dd}/{mm}/{y}")]


def verdict(field, value, t):
    if not value:
        return "empty"
    digits = lambda x: re.sub("[^0-9]", "", x)
    if field == "letter_date":
        m = re.match(r"(\d{4})-(\d{2})-(\d{2})", value)
        if any(v in t for v in variants(value)):
            return "found"
        return "similar" if m and re.search(rf"\b{int(m[3])}\b.{{0,20}}{m[1]}", t) else "not_found"
    if field == "signer_id":
        d = digits(value)
        return "found" if d and d in digits(t) else "similar" if len(d) >= 12 and d[:8] in digits(t) else "not_found"
    if field == "doc_number":
        core = re.sub("[^0-9/]", "", value)
        if len(core) >= 5 and core in re.sub("[^0-9/]", "", t):
            return "found"
    return sought(value, t)


def test_all_verdicts_totals_and_shares(spark):
    sf = "/root/testdata/sf0.001"
    scope = {name: fields for name, _, fields in rules.DOC_TYPES}
    want = {f: Counter() for f in (*rules.FIELDS, "all")}
    for r in records(spark, sf).collect():
        for f in rules.FIELDS:
            for k in (f, "all"):
                want[k][verdict(f, r[f"m_{f}"], norm(r["text"]))] += 1
                want[k]["out_of_scope"] += bool(scope[r["doc_type"]]) and f not in scope[r["doc_type"]]
    got = {r["field"]: r.asDict() for r in __spark_entry__.queries()["agg_audit"](spark, sf).collect()}
    assert set(got) == set(want)
    for f, r in got.items():
        assert {k: r[k] for k in ("found", "similar", "not_found", "empty", "out_of_scope")} == {k: want[f][k] for k in ("found", "similar", "not_found", "empty", "out_of_scope")}, f
        filled = r["found"] + r["similar"] + r["not_found"]
        assert r["filled"] == filled and all(abs(r[f"{v}_percent"] - r[v] * 100 / filled) < 1e-9 for v in ("found", "similar", "not_found"))
    assert all(got["all"][v] for v in ("found", "similar", "not_found", "empty", "out_of_scope"))


def test_normal_forms(spark):
    values = ["".join(map(chr, range(1, 127))), "A/B - c.9:0;é/ß", None, "  ", "x" + chr(0x2F) + chr(0x2E) + chr(0x3A)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(text.audit_norm("v")).collect()] == [norm(v) for v in values]
    days = ["2024-03-05", "2024-12-31 extra", "2024-00-05", "2024-13-05", "x", None]
    df = spark.createDataFrame([(v,) for v in days], "v string")
    assert [r[0] for r in df.select(validate.date_variants("v")).collect()] == [variants(v or "") for v in days]
