"""Entry points: the calls that an application makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.operators import metrics, relations
from letterloom.plans import extraction

process = extraction.process


def stats(documents: DataFrame, extractions: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: documents, those that need review, extractions with a verification address, accuracy of the latest run."""
    d = documents.agg(F.count(F.lit(1)).alias("total"), F.count_if("needs_review").alias("review"))
    e = extractions.agg(F.count_if(F.coalesce("verification_url", F.lit("")) != "").alias("verified"))
    r = runs.agg(F.coalesce(F.max_by("accuracy", "id"), F.lit(0.0)).alias("accuracy"))
    return d.join(e).join(r)  # three single rows


def latest_documents(documents: DataFrame, extractions: DataFrame, n: int = 100) -> DataFrame:
    newest = documents.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return relations.nested_children(newest, extractions.withColumnRenamed("id", "extraction_id").withColumnRenamed("document_id", "id"), "id", "extraction_id", *[c for c in extractions.columns if c not in ("id", "document_id")])


def runs(df: DataFrame) -> DataFrame:
    return df.orderBy("id")


def run_benchmark(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Both local extractors against labels (letter_id, field, label): run_name and the legacy measures per field."""
    out = None
    for name, extractor in (("baseline", extraction.baseline), ("heuristics", extraction.extract_all)):
        made = extractor(documents.select("letter_id", "text"))
        have = [f for f in ("doc_number", "agency", "letter_date", "signer_id") if f in made.columns]
        cells = made.select("letter_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("machine")) for f in have))).alias("c")).select("letter_id", "c.*")
        measured = metrics.prf(truth.join(cells, ["letter_id", "field"], "left")).withColumn("run_name", F.lit(name))
        out = measured if out is None else out.unionByName(measured)
    return out
