"""Letters are made in tasks of bounded rows, by code that the JVM compiles."""

from letterloom import shared
from letterloom.sources import letters

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_rows_and_code_stays_small(spark, monkeypatch):
    df = spark.range(1_000).withColumnRenamed("id", "k")
    assert [shared.dealt(df, "k", rows, 100).rdd.getNumPartitions() for rows in (0, 100, 1_000)] == [4, 4, 10]
    asked = []
    monkeypatch.setattr(letters, "dealt", lambda df, key, rows: asked.append(rows) or shared.dealt(df, key, rows, 100))
    made = letters.letters(spark, SF)
    assert asked == [1_500] and made.rdd.getNumPartitions() == 15 and made.count() == 1_500
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8_000


def test_small_joins_do_not_decide_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(letters, "dealt", lambda df, key, rows: shared.dealt(df, key, rows, 100))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many customers
    try:
        assert letters.records(spark, SF).rdd.getNumPartitions() == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
