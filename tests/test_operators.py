"""Operators on small frames: round trips of sources and sinks, duplicates, sheets, providers, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from letterloom import api
from letterloom.operators import assess, dedup, metrics, providers, relations, review
from letterloom.sources import readers, writers
from letterloom.streaming import ingest

LONG = "isi surat yang cukup panjang untuk dibandingkan dengan salinannya, " * 5


def test_duplicates(spark):
    data = [("a.pdf", "421/1/AB", LONG), ("a (1).pdf", "421/1/AB", LONG + "x"), ("b.pdf", "421/1/AB", "lain sekali " * 30), ("c.pdf", None, LONG + "sama"), ("cc.pdf", None, LONG + "sama"), ("d.pdf", None, "pendek"), ("e.pdf", None, "pendek")]
    df = spark.createDataFrame([(*r, "stale") for r in data], "filename string, doc_number string, text string, duplicate_of string")
    marked = dedup.mark(df)
    assert {r["filename"]: r["duplicate_of"] for r in marked.collect()} == {"a (1).pdf": "a.pdf", "cc.pdf": "c.pdf"}
    assert tuple(dedup.summary(df, marked).first()) == (7, 5, 2)
    assert dedup.mark(df.where("1 = 0")).count() == 0


def test_best_reading(spark):
    rows = [("f", 1, "fast", 0, "x" * 100, 0.7), ("f", 1, "sharp", 1, "x" * 96, 0.9), ("f", 1, "short", 2, "x" * 10, 0.99), ("f", 2, "a", 0, "y", 0.5), ("f", 2, "b", 1, "y", 0.5)]
    df = spark.createDataFrame(rows, "filename string, page_no int, variant string, pos int, text string, conf double")
    assert {(r["page_no"], r["variant"]) for r in dedup.readings_best(df).collect()} == {(1, "sharp"), (2, "a")}


def test_sheet_round_trip(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("﻿no;filename;field;true_value;clearly_absent\n1;a.pdf;agency;=;\n2;a.pdf;subject;-;\n3;a.pdf;letter_date;1/9/2025;\n4;a.pdf;bad;x;\n5;a.pdf;agency;DINAS;\n6;a.pdf;signer_id;;ya\n", encoding="utf-8")
    shape, rows = readers.csv_sheet(spark, str(path))
    assert shape == "long"
    decided = {r["field"]: (r["decision"], r["value"]) for r in review.decide(review.parse_long(rows).withColumn("machine", F.lit("dinas."))).collect()}
    assert decided == {"agency": ("confirmed", "DINAS"), "subject": ("absent", ""), "letter_date": ("typed", "2025-09-01"), "signer_id": ("remaining", "")}
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.csv_sheet(spark, str(path))
    wide = spark.createDataFrame([("a.pdf", 1, "x", "")], "filename string, pos int, value_agency string, value_subject string")
    assert {(r["field"], r["raw"]) for r in review.parse_wide(wide).collect()} == {("agency", "x"), ("subject", "")}
    writers.csv_sheet(spark.createDataFrame([(1, "a")], "no int, filename string"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8").startswith("﻿")


def test_files_and_providers(spark, tmp_path):
    for name in ("a.pdf", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"one|two|three|four|five")
    found = readers.files(spark, str(tmp_path))
    assert {r["filename"] for r in found.select("filename").collect()} == {"a.pdf", "b.PNG"}

    def provider(name, content):
        if name.endswith("PNG"):
            raise RuntimeError("no text layer")
        return content.decode().split("|")

    pages = readers.pages(found, provider, most=3).collect()
    assert sorted((r["filename"], r["page_no"], r["text"], r["error"]) for r in pages if r["text"]) == [("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None), ("a.pdf", 2, "three", None)]
    assert [r["error"] for r in pages if r["error"]] == ["no text layer"]
    assert readers.images(found).first()["is_scanned"]
    images = spark.createDataFrame([("a", 1, b"x"), ("b", 1, b"")], "filename string, page_no int, content binary")

    def make():
        return lambda content: [providers.Reading(text=content.decode(), conf=0.5, codes=["https://x"])] if content else 1 / 0

    read = {r["filename"]: (r["text"], r["error"]) for r in providers.read_pages(images, make).collect()}
    assert read == {"a": ("x", None), "b": (None, "division by zero")}
    assert providers.send_with_retries(lambda: {"ok": 1}) == ({"ok": 1}, 1, None) and providers.send_with_retries(lambda: 1 / 0)[1] == 3


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"innovation_id": "i", "evidences": [{"filename": "a", "evidence_tag": "x", "pos": 1}, {"filename": "a", "evidence_tag": "y", "pos": 2}]}))
    rows = relations.last_wins(readers.manifest(spark, str(tmp_path / "m.json")), "filename", "pos", "evidence_tag").collect()
    assert [(r["filename"], r["evidence_tag"]) for r in rows] == [("a", "y")]
    assert readers.manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"a.pdf": {"agency": "D", "subject": None}}))
    truth = {(r["field"], r["value"]) for r in readers.ground_truth(spark, str(tmp_path / "g.json")).collect()}
    assert ("agency", "D") in truth and ("subject", None) in truth and len(truth) == 8
    (tmp_path / "log.jsonl").write_text('{"action": "SEND", "file": "a"}\n{"action": "SE\n{"action": "REFUSE", "file": "b"}\n')
    assert readers.audit_log(spark, str(tmp_path / "log.jsonl")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"indicators": [{"id": "IND-01", "active": True, "parameters": [{"id": "IND-01-P1", "score": 1.0}, {"id": "IND-01-P2", "score": 2.0}], "max_score": 2.0}]}))
    catalog = readers.catalog(spark, str(tmp_path / "c.json"))
    assert assess.template(catalog).count() == 2
    version = writers.new_version(catalog, str(tmp_path / "table"))
    assert version.endswith("v000001") and writers.new_version(catalog, str(tmp_path / "table")).endswith("v000002")


def test_numbering_and_metrics(spark):
    df = spark.createDataFrame([(i, f"f{i % 50:03d}-{i}") for i in range(500)], "k int, filename string")
    assert [r["no"] for r in relations.numbered_by(df, "filename").orderBy("filename").select("no").collect()] == list(range(1, 501))
    cells = spark.createDataFrame([("agency", "Dinas", "DINAS A"), ("agency", "", "x"), ("agency", None, "x"), ("agency", "y", None)], "field string, machine string, label string")
    r = metrics.prf(cells).first()
    assert (r["correct"], r["expected"], r["predicted"]) == (1, 3, 3)
    assert "| a |" in writers.markdown(spark.createDataFrame([("a",)], "t string"))


@pytest.mark.parametrize("partitions", [4, 8, 200])
def test_numbering_of_many_rows(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(0, 25_000, 1, 7).select(F.xxhash64("id").alias("k"), F.concat(F.lit("wide "), F.col("id").cast("string")).alias("text"))
        got = relations.numbered_by(df, "k").orderBy("k").select("no").toPandas()["no"]
        assert got.tolist() == list(range(1, 25_001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_numbering_of_nothing(spark):
    assert relations.numbered_by(spark.createDataFrame([], "k long"), "k").count() == 0


def test_api(spark):
    docs = spark.createDataFrame([(1, "2024-01-01", True), (2, "2024-01-02", False)], "id long, created_at string, needs_review boolean")
    ext = spark.createDataFrame([(1, 1, "https://x"), (2, 1, "")], "id long, document_id long, verification_url string")
    runs = spark.createDataFrame([(1, 50.0), (2, 60.0)], "id long, accuracy double")
    assert tuple(api.stats(docs, ext, runs).first()) == (2, 1, 1, 60.0)
    assert [(r["id"], len(r["children"])) for r in api.latest_documents(docs, ext).collect()] == [(2, 0), (1, 2)]
    truth = spark.createDataFrame([(1, "doc_number", "421/1/AB/2024")], "letter_id long, field string, label string")
    letters = spark.createDataFrame([(1, "DINAS CONTOH\nNomor : 421/1/AB/2024")], "letter_id long, text string")
    assert {(r["run_name"], r["correct"]) for r in api.run_benchmark(letters, truth).collect()} == {("baseline", 1), ("heuristics", 1)}


def test_streaming_equals_batch(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "1.json").write_text("\n".join(json.dumps({"filename": n, "text": t, "received": "2024-01-01T00:00:00"}) for n, t in (("a.pdf", "DINAS CONTOH\nNomor : 421/1/AB/2024"), ("b.pdf", "undangan"), ("copy.pdf", "undangan"))))
    stream = ingest.deduplicated(ingest.inbox(spark, str(box)))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("doc_number = '421/1/AB/2024'").count() == 1


def test_values_in_documents(spark, monkeypatch):
    from letterloom.operators import finding

    rows = [(1, "one two three four"), (2, "someone else"), (3, None), (4, "onetwo threefour five"), (None, "one"), (4, "x"), (5, "")]
    sought = [(1, "one"), (2, "two three"), (3, "one two three"), (4, "six"), (5, "one"), (6, None), (7, ""), (8, "threefour fi"), (9, "three four fi"), (9, "three four fi")]
    bare = lambda t: t.replace(" ", "")
    want = sorted((d, i, "found" if n in h else "found_without_spaces") for d, h in rows if d and h for i, n in sought if n and bare(n) in bare(h))
    hay, needles = spark.createDataFrame(rows, "doc_id long, hay string"), spark.createDataFrame(sought, "item_id long, needle string")
    assert sorted(map(tuple, finding.find_values(hay, needles).collect())) == want and len(want) == 13
    for name, value in (("SHARD", 8), ("TASK", 1), ("BROADCAST", 2)):
        monkeypatch.setattr(finding, name, value)
    assert sorted(map(tuple, finding.find_values(hay, needles).collect())) == want
    found = finding.find_values(hay, needles)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert finding.find_values(hay, needles.limit(0)).collect() == [] and finding.find_values(hay.limit(0), needles).collect() == []


def test_blocks_of_values_as_difflib_finds_them(spark):
    import difflib
    import random

    from letterloom.functions.text import audit_norm
    from letterloom.operators import dedup

    rng, cells = random.Random(5), []
    for k in range(10_000):
        text = " ".join("".join(rng.choice("abcde1") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(3, 80)))
        n = rng.choice([1, 2, 5, 7, 13, 20, 40, 199, 200, 260])
        at = rng.randrange(max(1, len(text) - n))
        value = list(text[at : at + n])
        for _ in range(rng.choice([0, 1, 1, 2])):
            value[min(len(value) - 1, int(len(value) * rng.choice([0, 0.05, 0.1, 0.15, 0.2, 0.5, 0.86, 0.95])))] = "z"
        cells.append((k, "".join(value), text, None if k % 10 else "found"))
    df = spark.createDataFrame(cells, "id long, machine string, text_norm string, verdict string")
    values = {r["id"]: r["v"] for r in df.select("id", audit_norm("machine").alias("v")).collect()}
    got = {r["id"]: r["verdict"] for r in dedup.similar_values(df).collect()}

    def want(k, text, given):
        v = values[k]
        block = difflib.SequenceMatcher(None, text, v).find_longest_match(0, len(text), 0, len(v)).size
        return given or ("similar" if block / max(1, len(v)) >= 0.85 else "not_found")

    assert got == {k: want(k, text, given) for k, _, text, given in cells}
    assert {v: sum(g == v for g in got.values()) > 500 for v in ("similar", "not_found", "found")} == {"similar": True, "not_found": True, "found": True}


def test_order_of_a_sheet_in_parts(spark, tmp_path):
    for name, rows in (("part-1.csv", ["a.pdf,agency,first,"]), ("part-2.csv", ["a.pdf,agency,then,", "a.pdf,subject,x,"] + [f"b{k}.pdf,agency,{'y' * 40},"  for k in range(50)]), ("part-3.csv", ["a.pdf,agency,last,"])):
        (tmp_path / name).write_text("\n".join(["filename,field,true_value,clearly_absent", *rows]))
    _, rows = readers.csv_sheet(spark, str(tmp_path))
    assert {(r["field"], r["raw"]) for r in review.parse_long(rows).where("filename = 'a.pdf'").collect()} == {("agency", "last"), ("subject", "x")}


def test_key_that_holds_most_rows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 5 else f"k{i}") for i in range(200)] + [(900, None), (901, "alone")], "id long, k string")
    one = spark.createDataFrame([("hot", "H"), ("k5", "five"), ("unused", "u"), (None, "n")], "k string, v string")
    want = sorted((i, "hot", "H") for i in range(200) if i % 5) + [(5, "k5", "five")]
    for limit in (7, 10_000):
        got = relations.join_to_one(rows, one, "k", limit)
        assert got.columns == ["k", "id", "v"] and sorted((r["id"], r["k"], r["v"]) for r in got.collect()) == sorted(want)


def test_copies_under_one_number(spark, monkeypatch):
    monkeypatch.setattr(relations, "HOT", 5)
    body = "isi surat yang panjang " * 12
    rows = [(f"d{k:02d}.pdf", "421/1/AB/2024", body if k % 3 else body + str(k)) for k in range(20)] + [("other.pdf", "421/1/AB/2024", "lain sekali " * 30), ("x.pdf", "9/9/ZZ/2024", body), ("short.pdf", "421/1/AB/2024", "a")]
    got = {r["filename"]: r["duplicate_of"] for r in dedup.by_number(spark.createDataFrame(rows, "filename string, doc_number string, text_norm string")).collect()}
    assert got == {f"d{k:02d}.pdf": "d00.pdf" for k in range(1, 20)}
