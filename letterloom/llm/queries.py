"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.llm import decontam, embeddings, language, packing, periodic, personal, quality, repeats, sharding, simhash, token_counts, token_files, whitening
from letterloom.llm.common import crc_fold, scratch, table, written

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back. A null text has the end id alone; a null doc_id comes first; a repeated one is ordered by text."""
    folder = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with all their columns, written to the folders of their shards and read back: place, size and checksum of each. Equal and null ids share a shard."""
    folder, docs = scratch(spark, "shards"), table(spark, sf_dir, "documents")
    sharding.write_shards(docs, "doc_id", SHARDS, folder)
    back = spark.read.schema(T.StructType([*(f for f in docs.schema if f.name not in ("slot", "shard", "shard_name")), T.StructField("shard_name", T.StringType())])).parquet(folder)
    shard = (F.array_position(F.lit(SHARDS), F.col("shard_name")) - 1).cast("int").alias("shard")
    return back.select("doc_id", sharding.slot_of(F.col("doc_id")).alias("slot"), shard, "shard_name", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut from each document, as ``repeats.repeated_spans`` says; null texts are empty, rows without doc_id lose nothing."""
    return repeats.removal_report(repeats.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; see ``embeddings.near_duplicates`` for nulls, lengths and repeated rows."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; null and empty texts have none."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the token pieces of all documents; a null text is the end id alone, repeated rows are packed each."""
    pieces = written(packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1), "pieces")
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).drop("uid")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document. A row without doc_id is in no fold: held_out is null and it is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, crc_fold("doc_id", 4) != 2)
    return language.identify(docs, model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null, empty and wordless texts have fingerprint zero."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document. A row without doc_id is in no fold: held_out is null and it is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in any document; see ``decontam.find_copies``."""
    return decontam.find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; null and empty texts have none."""
    return personal.report(personal.find_personal_data(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened, 32 components; see ``whitening.whiten`` for nulls, lengths and repeated rows."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, one in ten of which is made periodic first; null, empty and wordless texts have none."""
    return periodic.run_report(table(spark, sf_dir, "documents"), periodic.repeated_words)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_token_files, op2_sharding, op3_suffix_dedup, op4_embedding_dedup, op5_token_counts, op6_packing, op7_language_id, op8_simhash_dedup, op9_quality, op10_decontamination,
           op11_personal_data, op12_whitening, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query; the others are tested against brute force in tests/llm."""
    return {}
