"""Operator 13 against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import Row

from letterloom.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                found.setdefault((i - q, j), q)  # periods rise: the smallest of a stretch comes first
            i = max(j, i + 1)
    inner = lambda s, e, q: any(a <= s and e <= b and p < q and q % p == 0 for (a, b), p in found.items())
    return sorted((s, e - s, q) for (s, e), q in found.items() if not inner(s, e, q))


@pytest.mark.parametrize("chunk", [1, 40, 32_768])
def test_runs_of_random_texts(chunk, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.choice([0, 1, 23, 24, 60, 200, 500]), rng.choice([1, 2, 3, 40])
            words = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 10 else 0):
                i, p = rng.randrange(n), rng.randint(1, n // 4)
                for j in range(i + p, min(n, i + p * rng.randint(2, 6) + rng.randrange(p))):
                    words[j] = words[j - p]
            docs.append([str(w).encode() for w in words])
        assert periodic.runs_of_texts(docs) == [brute(d) for d in docs]


def test_long_texts():
    assert periodic.runs_of_texts([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    words = [str(i).encode() for i in range(30_001)]
    assert periodic.runs_of_texts([words * 3 + [b"x"]]) == [[(0, 90_003, 30_001)]]
    assert periodic.runs_of_texts([words * 2 + words[:-2]]) == [[]]


def expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_contract(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 20000 OR text IS NULL").fetchall()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(docs) > 150 and all(got[d] == expected(d, t) for d, t in docs)
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_rows(spark):
    line = " ".join("abc") + " d\n"
    rows = [Row(doc_id=1, text=None, runs=1), Row(doc_id=None, text=line * 20, runs=1), Row(doc_id=2, text=" \n", runs=1), Row(doc_id=3, text=line * 20, runs=None), Row(doc_id=3, text=line * 20, runs=None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]]) for r in periodic.find_runs(docs).collect()), key=str)
    assert found == sorted([(1, []), (None, [(0, 60, 3)]), (2, []), (3, [(0, 60, 3)]), (3, [(0, 60, 3)])], key=str)
    assert [r["text"] for r in periodic.collapse(docs).collect()] == [None, "a b c d", " \n", "a b c d", "a b c d"]
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(periodic.run_report(docs.where("doc_id = 1")).first()) == (1, 0, None, None, None, None, empty, empty)
    assert periodic.run_report(docs.limit(0)).collect() == []
