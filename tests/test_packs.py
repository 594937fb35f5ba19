"""Small files in packs: what a name holds after several writes, and how many files lie in the folder."""

import json

import pytest
from pyspark.sql import functions as F

from letterloom.sources import packs, readers, writers


def held(spark, folder, *args):
    return {r["filename"]: (bytes(r["content"]).decode(), r["length"]) for r in packs.read(spark, folder, *args).collect()}


def test_first_write_stays_unless_forced(spark, tmp_path):
    folder, kind = f"file://{tmp_path}/p", "filename string, content string"
    assert packs.read(spark, folder).count() == 0
    for force, rows in ((False, [("a.png", "1"), ("b.PNG", "é"), ("none.png", None)]), (False, [("a.png", "2"), ("c.txt", "")]), (True, [("a.png", "3")]), (False, [("a.png", "4")]), (True, [("a.png", "5"), ("d.png", "6")])):
        packs.write(spark.createDataFrame(rows, kind), folder, force=force)
    assert held(spark, folder) == {"a.png": ("5", 1), "b.PNG": ("é", 2), "c.txt": ("", 0), "d.png": ("6", 1)}
    assert set(held(spark, folder, ("png",))) == {"a.png", "b.PNG", "d.png"} and set(held(spark, folder, (), "d.p")) == {"d.png"}
    for bad in ("x/y", ".x", "_x", ""):
        with pytest.raises(Exception, match="no name"):
            packs.write(spark.createDataFrame([(bad, "x")], kind), folder)
    (tmp_path / "p" / "000099-forced").mkdir()  # a write that never ended
    assert len(held(spark, folder)) == 4


def test_records_in_packs_have_the_bytes_of_files_and_few_files(spark, tmp_path):
    rows = spark.range(0, 500, 1, 2).select(F.concat(F.lit("r"), "id", F.lit(".v1.pdf")).alias("filename"), F.lit("é").alias("is"), F.col("id").cast("int").alias("page_count"))
    writers.record_packs(rows, f"file://{tmp_path}/packs")
    writers.record_json(rows, str(tmp_path / "files"))
    assert {n: c for n, (c, _) in held(spark, f"file://{tmp_path}/packs").items()} == {p.name: p.read_text() for p in (tmp_path / "files").iterdir()}
    assert len([p for p in (tmp_path / "packs").rglob("*.parquet")]) <= 2
    assert readers.packed_records(spark, f"file://{tmp_path}/packs").where("page_count = 7").first()["filename"] == "r7.v1.pdf"
    assert json.loads(held(spark, f"file://{tmp_path}/packs")["r7.v1.json"][0])["is"] == "é"


@pytest.mark.parametrize("name", ["src_files", "src_json_records", "sink_record_json"])
def test_queries_leave_few_files(spark, name, tmp_path, monkeypatch):
    from letterloom.plans import QUERIES, table_queries

    monkeypatch.setattr(table_queries, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 10
    assert sum(1 for p in tmp_path.rglob("*") if p.is_file()) < 100  # 1 500 letters
