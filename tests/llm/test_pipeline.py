"""The pipeline's stages on the smallest tables, each against a plain check on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_stages(spark, stages):
    docs, good, unique, cut, clean, packed = stages
    for frame in (good, unique, cut, clean):
        assert frame.columns == docs.columns and dict(frame.dtypes) == dict(docs.dtypes)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = labels.join(good.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").fillna(0, "kept")
    assert judged.where("kept = quality").count() >= 0.9 * labels.count()

    assert unique.groupBy("text").count().where("count > 1").count() == 0 and unique.count() < good.count()
    assert cut.count() == unique.count() and cut.agg(F.sum("n_chars")).first()[0] < unique.agg(F.sum("n_chars")).first()[0]
    assert cut.where("n_chars <> length(text)").count() == 0
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in cut.collect() if any(i in r["text"] for i in items)}
    kept = {r["doc_id"] for r in clean.collect()}
    assert not held & kept and kept
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_equals_stages(spark, stages):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SF).select(columns).collect()) == sorted(stages[-1].select(columns).collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Null texts and ids, empty and repeated rows, and columns whose names the stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "source")
    more = [(None, "a text without a number", "en", "web"), (None, None, None, None), (9_000, None, "en", "web"), (9_001, "", "en", "web"), (9_002, " \n", None, "web")]
    rows = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame(more, docs.schema))
    return rows.withColumns({"score": F.lit("kept"), "component_id": F.lit("kept"), "node": F.lit(1), "piece_hash": F.lit(None).cast("string")}).persist()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, odd, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, odd, SF)
    assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes)
    assert got.where("score <> 'kept' or component_id <> 'kept' or node <> 1").count() == 0 and 0 < got.count() <= odd.count()
    if name == "simhash_near_dedup":
        assert got.where("doc_id is null").count() == 2 and got.where("doc_id >= 9000").count() == 1  # wordless documents are one group
    if name == "suffix_array_dedup":
        assert got.count() == odd.count() and got.where("text is null").count() == odd.where("text is null").count()
    empty = dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), SF)
    assert empty.columns == odd.columns and empty.count() == 0


def test_last_stage_on_odd_rows(spark, odd):
    packed = corpus_pipeline.best_fit_packing(spark, odd, SF)
    assert packed.where("piece = 0").count() == odd.count()
    assert corpus_pipeline.best_fit_packing(spark, odd.limit(0), SF).count() == 0
