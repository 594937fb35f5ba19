"""Duplicate marking moves the texts of documents that share a number, and no others; hashes are made once."""

from letterloom.operators import dedup, relations


def _recorded(monkeypatch):
    """Names, columns and rows of what is written on the way."""
    tables, write = {}, dedup.written

    def record(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(dedup, "written", record)
    return tables


def _documents(spark):
    body = "surat edaran tentang rapat " * 12
    rows = [(f"s{i}.pdf", f"NO/{i:05d}", body + str(i)) for i in range(30)]
    rows += [("a.pdf", "SHARED/1", body), ("a (1).pdf", "SHARED/1", body), ("b.pdf", "SHARED/1", body + " x"), ("c.pdf", "OTHER/22", "lain sekali " * 40), ("d.pdf", "OTHER/22", body)]
    return spark.createDataFrame(rows, "filename string, doc_number string, text string")


def test_only_texts_under_shared_numbers_are_joined(spark, monkeypatch):
    tables = _recorded(monkeypatch)
    monkeypatch.setattr(relations, "HOT", 2)  # the number of three documents is split
    got = dedup.by_number(_documents(spark).withColumn("text_norm", dedup.dup_norm("text")))
    assert sorted(map(tuple, got.collect())) == [("a (1).pdf", "a.pdf"), ("b.pdf", "a.pdf")]
    assert sorted(r["filename"] for r in tables["shared"].collect()) == ["a (1).pdf", "a.pdf", "b.pdf", "c.pdf", "d.pdf"]


def test_hashes_are_written_once_without_texts(spark, monkeypatch):
    tables = _recorded(monkeypatch)
    documents = _documents(spark).unionByName(spark.createDataFrame([("e.pdf", "", "lain sekali " * 40)], "filename string, doc_number string, text string"))
    assert sorted(map(tuple, dedup.mark(documents).collect())) == [("a (1).pdf", "a.pdf"), ("b.pdf", "a.pdf"), ("d.pdf", "a.pdf"), ("e.pdf", "c.pdf")]
    assert set(tables["hashes"].columns) == {"filename", "text_sha256"}
