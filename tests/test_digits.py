"""Digits of texts are found by removing whole stretches, and values are normalised once."""

from pyspark.sql import functions as F

from letterloom.functions import audit, text


def test_stretches_are_removed_whole_and_results_stay(spark):
    rows = spark.createDataFrame([("a1 b/2\n-3", "12/3"), ("", ""), (None, None), ("٣ x9", "x")], "t string, v string")
    assert [r[0] for r in rows.select(text.digits("t")).collect()] == ["123", "", "", "9"]
    for expression in (text.digits("t"), audit.aud_docnum("v", "t")):
        assert "]+" in str(expression) and "[^0-9]," not in str(expression) and "[^0-9/]," not in str(expression)
    found = rows.select(audit.aud_contains("v", "t"), audit.aud_docnum(F.lit("421.5/9"), F.lit("no 4 2 1 5 / 9"))).collect()
    assert [r[0] for r in found] == [None, "empty", "empty", "found"] and found[0][1] == "found"


def test_a_value_is_normalised_once(spark):
    assert str(audit.aud_contains("v", "t")).count("[^a-z0-9/]+") == 1
