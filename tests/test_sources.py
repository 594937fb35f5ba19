"""The file data source: planning, conditions on names, and writing in two steps."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from letterloom.sources import database, document_files, readers, writers
from letterloom.sources.bucket_table import BucketTable


def batch(*rows):
    names, contents = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names), pa.array(contents)], names=["filename", "content"])


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_partitions_follow_bytes(tmp_path, monkeypatch):
    for k, size in enumerate([10, 10, 5_000, 10, 10, 10]):
        (tmp_path / f"{k}.txt").write_bytes(b"x" * size)
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp" / "a.txt").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.TXT").write_text("yes")
    monkeypatch.setattr(document_files, "PARTITION", 1_000)
    monkeypatch.setattr(document_files, "OPENING", 100)
    reader = document_files.FileReader(str(tmp_path), True, (".txt",))
    planned = [[p.rsplit("/", 1)[-1] for p, _ in part.found] for part in reader.partitions()]
    assert planned == [["0.txt", "1.txt"], ["2.txt"], ["3.txt", "4.txt", "5.txt", "b.TXT"]]
    assert document_files.FileReader(str(tmp_path), False, ()).listed()[-1][0].endswith("5.txt")
    assert document_files.FileReader(str(tmp_path / "none"), True, ()).partitions()[0].found == []


def test_conditions_that_are_taken(tmp_path):
    for n in ("a1.pdf", "a2.png", "b1.pdf"):
        (tmp_path / n).write_text(n)
    at = ("filename",)

    def left(*filters):
        reader = document_files.FileReader(str(tmp_path), True, ())
        rest = list(reader.pushFilters(list(filters)))
        return [p.rsplit("/", 1)[-1] for p, _ in reader.listed()], rest

    assert left(ds.IsNotNull(at), ds.StringEndsWith(at, ".pdf"), ds.StringStartsWith(at, "a")) == (["a1.pdf"], [])
    assert left(ds.Not(ds.StringContains(at, "1")))[0] == ["a2.png"] and left(ds.In(at, ("b1.pdf", "x")))[0] == ["b1.pdf"] and left(ds.EqualTo(at, "a2.png"))[0] == ["a2.png"]
    other = ds.GreaterThan(("length",), 3)
    assert left(other) == (["a1.pdf", "a2.png", "b1.pdf"], [other])


def test_nothing_shows_before_all_tasks_have_ended(tmp_path):
    (tmp_path / "old.json").write_text("old")
    writer = document_files.FileWriter(str(tmp_path), False, 2)
    one = writer.write(iter([batch(("a.json", '{"x": ["é"]}'), ("old.json", "{}"))]))
    writer.write(iter([batch(("killed.json", "{}"))]))  # an attempt whose message never came
    assert names(tmp_path) == [writer.staging, "old.json"] and (one.written, one.skipped) == (1, 1)
    assert document_files.FileReader(str(tmp_path), True, ()).listed()[0][0].endswith("old.json") and len(document_files.FileReader(str(tmp_path), True, ()).listed()) == 1
    two = writer.write(iter([batch(("b.json", "{}"))]))
    writer.commit([one, two, None])
    assert names(tmp_path) == ["a.json", "b.json", "old.json"]
    assert (tmp_path / "a.json").read_text() == json.dumps({"x": ["é"]}, ensure_ascii=False, indent=2) and (tmp_path / "old.json").read_text() == "old"
    forced = document_files.FileWriter(str(tmp_path), True, None)
    forced.commit([forced.write(iter([batch(("old.json", "new"))]))])
    assert (tmp_path / "old.json").read_text() == "new"
    failed = document_files.FileWriter(str(tmp_path), False, None)
    failed.abort([failed.write(iter([batch(("c.json", "{}"))])), None])
    failed.abort([])
    assert names(tmp_path) == ["a.json", "b.json", "old.json"]
    with pytest.raises(ValueError):
        failed.write(iter([batch(("../c.json", "{}"))]))


def test_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("filename"), F.when(F.col("id") == 35, F.lit("{no json")).otherwise("{}").alias("content"))
    with pytest.raises(Exception, match="JSON|Expecting"):
        document_files.write(rows, str(out), indent=2)
    assert not out.exists() or names(out) == []
    document_files.write(rows.where("id <> 35"), str(out), indent=2)
    assert len(names(out)) == 39


def test_records_as_files(spark, tmp_path):
    records = spark.createDataFrame([("x.v1.pdf", 2), ("y.png", None)], "filename string, page_count int")
    writers.record_json(records, str(tmp_path))
    (tmp_path / "z.json").write_text("{broken")
    assert names(tmp_path) == ["x.v1.json", "y.json", "z.json"]
    assert sorted((r["filename"] or "", r["page_count"]) for r in readers.json_records(spark, str(tmp_path)).collect()) == [("", None), ("x.v1.pdf", 2), ("y.png", None)]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "StringContains(filename,1)" in readers.files(spark, str(tmp_path), name_part="1")._jdf.queryExecution().explainString(mode)


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    rows = spark.range(-5, 100).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.lit(None).cast("string").alias("text"))
    database.write_table(rows, url + ";create=true", "numbers", {"kind": "VARCHAR(8)"})
    back = database.read_table(spark, url, "numbers", key="id", rows_per_part=20)
    assert back.rdd.getNumPartitions() == 6 and sorted(r["id"] for r in back.collect()) == list(range(-5, 100))
    some = back.where("kind = 'even' and id > 50").select("id")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = some._jdf.queryExecution().explainString(mode)
    assert "EqualTo(kind,even)" in plan and "GreaterThan(id,50)" in plan and some.count() == 24
    database.write_table(rows.where("id < 0"), url, "negative", {"kind": "VARCHAR(8)"})
    assert database.read_table(spark, url, "negative", key="id").count() == 5
    database.write_table(rows.limit(0), url, "nothing", {"kind": "VARCHAR(8)"})
    assert database.read_table(spark, url, "nothing", key="id").count() == 0


def test_database_falls_back(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "copy"))
    for url in (f"jdbc:derby:{tmp_path}/none", "jdbc:unknown://host/db", "jdbc:derby:"):
        found, source = database.table_or_copy(spark, url, "t", str(tmp_path / "copy"), seconds=5)
        assert (found.count(), source) == (3, "copy")
    database.write_table(spark.range(7), f"jdbc:derby:{tmp_path}/db;create=true", "t")
    found, source = database.table_or_copy(spark, f"jdbc:derby:{tmp_path}/db", "t", str(tmp_path / "copy"))
    assert (found.count(), source) == (7, "database")


def test_database_that_does_not_answer(spark, tmp_path):
    import time

    spark.range(3).write.parquet(str(tmp_path / "copy"))
    began = time.time()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(database, "_answers", lambda *a: time.sleep(30))
        assert database.table_or_copy(spark, "jdbc:derby:x", "t", str(tmp_path / "copy"), seconds=0.5)[1] == "copy"
    assert time.time() - began < 15


def test_merge_touches_only_its_buckets(spark, tmp_path):
    made = BucketTable(spark, f"file://{tmp_path}/t", "k", buckets=8)
    with pytest.raises(ValueError):
        made.read()
    kind = "k long, status string, name string, pos int"
    first = made.merge(spark.createDataFrame([(i, "NEW", f"n{i}", 0) for i in range(100)] + [(None, "x", "x", 1)], kind), ("status",), "pos")
    files = {b: sorted(p.name for p in (tmp_path / "t" / f).iterdir()) for b, f in first["folders"].items()}
    second = made.merge(spark.createDataFrame([(5, "A", "later", 1), (5, None, "later", 3), (5, "B", "later", 2), (500, "C", "one", 7), (500, "D", "two", 9)], kind), ("status",), "pos")
    changed = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    assert 1 <= len(changed) <= 2 and second["number"] == 2
    assert all(sorted(p.name for p in (tmp_path / "t" / second["folders"][b]).iterdir()) == files[b] for b in files if b not in changed)
    rows = {r["k"]: (r["status"], r["name"]) for r in made.read().collect()}
    assert len(rows) == 101 and rows[5] == (None, "n5") and rows[500] == ("D", "one") and rows[6] == ("NEW", "n6")
    assert made.merge(spark.createDataFrame([], kind), ("status",), "pos")["folders"] == second["folders"] and made.read().count() == 101


def test_second_of_two_merges_at_once_fails(spark, tmp_path, monkeypatch):
    kind = "k long, status string, pos int"
    made = BucketTable(spark, f"file://{tmp_path}/t", "k", buckets=4)
    made.merge(spark.createDataFrame([(1, "a", 0)], kind), ("status",), "pos")
    stale = made.manifest()
    made.merge(spark.createDataFrame([(1, "b", 0)], kind), ("status",), "pos")
    other = BucketTable(spark, f"file://{tmp_path}/t", "k")
    monkeypatch.setattr(other, "manifest", lambda: stale)
    with pytest.raises(Exception, match="xist"):
        other.merge(spark.createDataFrame([(1, "c", 0)], kind), ("status",), "pos")
    assert [tuple(r) for r in made.read().collect()] == [(1, "b")]


def test_repeated_keys_in_a_merge(spark):
    from letterloom.operators.relations import upsert

    old = spark.createDataFrame([(1, "o", "x"), (2, "o", "x")], "k long, a string, b string")
    new = spark.createDataFrame([(1, "n1", "y", 2), (1, "n2", "z", 1), (3, "n3", "y", 1), (3, "n4", "z", 2), (None, "n", "n", 1)], "k long, a string, b string, pos int")
    assert sorted(tuple(r) for r in upsert(old, new, "k", ("a",), "pos").collect()) == [(1, "n1", "x"), (2, "o", "x"), (3, "n4", "y")]
    assert upsert(old, new.drop("pos"), "k", ("a",)).count() == 3
