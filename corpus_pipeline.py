"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark copies, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import decontam, packing, quality, repeats, simhash
from letterloom.llm.common import crc_fold, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go. Labels are learned from the training folds only.

    A null text is judged as an empty one, repeated rows each; rows without doc_id are judged but not learned from.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more), the document with the smallest doc_id stays.

    Texts without words (null, empty) are one group; rows without doc_id stay; rows that repeat a doc_id go or stay together.
    """
    found = simhash.similar_texts(docs.select("doc_id", "text"), shingle=5, similarity=0.8)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has, too, are cut; documents stay.

    Null texts stay null; rows without doc_id are left alone; rows that repeat a doc_id are one document's. Where there
    is a column ``n_chars`` it follows the text.
    """
    cut = repeats.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go; null and empty texts hold none, repeated rows are judged each."""
    return decontam.drop_copies(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what remains, placed in sequences of 4096 tokens; a null text is the end id alone, repeated rows are packed each."""
    pieces = written(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1), "pieces")
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).drop("uid")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, fingerprints and alignments have no SQL form: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
