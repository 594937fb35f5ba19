"""Streams against their batch forms: late copies, failures between storing and committing, state."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from letterloom.plans.extraction import process
from letterloom.streaming import ingest


def arrive(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"filename": n, "text": t, "received": r}) for n, t, r in rows))


def test_copies_weeks_later(spark, tmp_path):
    box, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    arrive(box, "1.json", ("a", "x", "2024-01-01T00:00:00"), ("b", "y", "2024-01-01T00:00:00"), ("n", None, "2024-01-01T00:00:00"))
    first = ingest.store(ingest.deduplicated(ingest.inbox(spark, str(box), 1)), out, check)
    first.awaitTermination()
    arrive(box, "2.json", ("late", "x", "2024-03-01T00:00:00"), ("new", "z", "2024-03-01T00:00:00"), ("empty", "", "2024-03-01T00:00:00"))
    second = ingest.store(ingest.deduplicated(ingest.inbox(spark, str(box), 1)), out, check)
    second.awaitTermination()
    assert sorted(r["filename"] for r in spark.read.parquet(out).collect()) == ["a", "b", "n", "new"]
    assert sum(s["numRowsTotal"] for s in second.lastProgress["stateOperators"]) == 4  # a row per different text
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_copies_after_the_horizon(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    for k, day in enumerate(("2024-01-01", "2024-02-01", "2024-03-01")):
        arrive(box, f"{k}.json", (f"f{k}", "x" if k != 1 else "other", f"{day}T00:00:00"))
        ingest.store(ingest.deduplicated(ingest.inbox(spark, str(box), 1), delay="1 day"), out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["filename"] for r in spark.read.parquet(out).collect()) == ["f0", "f1", "f2"]


@pytest.mark.parametrize("when", [0, 1, 2])
def test_failure_between_storing_and_committing(spark, tmp_path, when):
    box, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(3):
        arrive(box, f"{k}.json", (f"f{k}.pdf", f"DINAS CONTOH\nNomor : 421/{k}/AB/2024", "2024-01-01T00:00:00"))

    def fail(number):
        if number == when:
            raise RuntimeError("stopped here")

    with pytest.raises(StreamingQueryException):
        ingest.ingest(ingest.inbox(spark, str(box), 1), out, check, written=fail).awaitTermination()
    seen = []
    ingest.ingest(ingest.inbox(spark, str(box), 1), out, check, written=seen.append).awaitTermination()
    assert seen == list(range(when, 3))
    got = spark.read.parquet(out).select("filename", "doc_number", "region").collect()
    want = process(spark.read.schema(ingest.INBOX).json(str(box))).select("filename", "doc_number", "region").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3
