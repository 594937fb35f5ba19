"""What spares the extraction work leaves its results: strips of ends, cleaned lines made once, searched types, batches."""

import itertools

from pyspark.sql import functions as F

from letterloom.functions import classify, extract, rules, text
from letterloom.plans import extraction, stream_queries


def test_a_repeated_batch_is_a_small_part_of_many_files():
    assert [stream_queries._per_batch(n) for n in (1, 12, 48, 90, 540)] == [4, 4, 4, 8, 45]
    assert all(stream_queries._per_batch(n) * 11 < n + 12 for n in range(48, 5_000))


def test_ends_are_stripped_as_by_a_search(spark):
    marks = ["", " ", ".", ".\n", ";\r\n", " ", "\u0085", " ", ", ", "x", "x y"]
    df = spark.createDataFrame([("".join(p),) for p in itertools.product(marks, ["", "a.b", "a\n b"], marks)] + [(None,)], "v string")
    for chars in (r"\s", ".,;:"):
        assert df.where(~text.strip_bound(F.col("v"), chars).eqNullSafe(text.strip("v", chars))).count() == 0


def test_lines_cleaned_once_are_the_same(spark):
    texts = ["3 / 7 PEMERINTAHKOTAMAKASSAR\n 12/3 DINASPENDIDIKAN.\nNomor: 1\nKepala Badan,\n x ", "PERENCANAAN\nPEMERINTAH\n/\n1/2 a", "", None]
    df = extraction.with_clean_lines(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = df.withColumns({"a": extract.unmarked_lines("_clean"), "b": extract.cleaned_lines("lines"), "c": extract.agency("lines", "_clean"), "d": extract.agency("lines")})
    assert df.where("not a <=> b or not c <=> d").count() == 0
    assert df.first()["_clean"][:2] == ["PEMERINTAH KOTA MAKASSAR", "DINAS PENDIDIKAN."]


def test_types_in_columns(spark):
    assert classify.required_words(r"\bnota\s+dinas\b") == ["dinas", "nota"] and classify.required_words("a|b") == []
    words = ["surat undangan", "Nota\nDinas", "nota", "dinas", "surat tugas", "ſk", "SK", "perihal :", "laporan kegiatan", "x"]
    rows = [(" ".join(p), n) for p in itertools.permutations(words, 2) for n in ("f.pdf", "f.png")] + [(None, "f"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, filename string")
    got = extraction.process(df).select("text", "filename", "doc_type", "type_confidence", classify.doc_type("text", "filename").alias("t"))
    assert got.count() == len(rows) and got.where("not doc_type <=> t.type or not type_confidence <=> t.confidence").count() == 0
    assert set(rules.DOC_TYPES[k][0] for k in (1, 4, 8)) < {r["doc_type"] for r in got.collect()}
