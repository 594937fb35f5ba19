"""Review sheets of many rows are several files, each a sheet of its own."""

from pyspark.sql import functions as F

from letterloom.sources import readers, writers


def test_long_sheets_are_cut_into_files_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SHEET", 100)
    rows = spark.range(950, -1, -1, 3).select((F.col("id") + 1).alias("no"), F.concat(F.lit('a "b",\n'), "id").alias("filename"), F.lit("").alias("value_agency"))
    writers.csv_sheet(rows, str(tmp_path / "s"))
    parts = sorted((tmp_path / "s").glob("part-*.csv"))
    assert len(parts) == 10 and all(p.read_text(encoding="utf-8").startswith("﻿no,filename,value_agency\n") for p in parts)
    shape, back = readers.csv_sheet(spark, str(tmp_path / "s"))
    assert shape == "wide" and max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) < 250
    assert [(int(r["no"]), r["filename"]) for r in back.orderBy("pos").collect()] == [(i + 1, f'a "b",\n{i}') for i in range(951)]
    writers.csv_sheet(rows.limit(100), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1


def test_source_sheet_has_a_file_for_each_task_of_letters(spark, tmp_path, monkeypatch):
    from letterloom import shared
    from letterloom.plans import QUERIES, table_queries
    from letterloom.sources import letters

    monkeypatch.setattr(letters, "dealt", lambda df, key, rows: shared.dealt(df, key, rows, 100))
    monkeypatch.setattr(table_queries, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    assert QUERIES["src_csv_sheet"](spark, "/root/testdata/sf0.001").count() == 12_000
    assert len(list((tmp_path / "sheet").glob("part-*.csv"))) == 15
