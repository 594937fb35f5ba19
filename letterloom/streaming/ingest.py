"""Streaming ingest: the batch projection over an inbox of documents, and deduplication by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from letterloom.plans.extraction import process

INBOX = "filename string, text string, received timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def inbox(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(INBOX).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def deduplicated(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """One row per content hash (``file_hash``, 32 bytes): however much later a copy comes, it is dropped.

    The state is a hash per different text, for good. With ``delay`` hashes are forgotten after that time, and
    copies that come later pass.
    """
    hashed = stream.withColumn("file_hash", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    return hashed.dropDuplicates(["file_hash"]) if delay is None else hashed.withWatermark("received", delay).dropDuplicatesWithinWatermark(["file_hash"])


def ingest(stream: DataFrame, out: str, checkpoint: str, written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Process what is in the inbox, then stop; a batch that is repeated after a failure replaces its own output.

    ``written`` is called with a batch's number when its rows are stored and the checkpoint doesn't know it yet.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if written:
            written(number)

    return process(stream).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is in the inbox to Parquet files at ``out``, then stop. State lies in RocksDB, so it may exceed an executor's memory."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query keeps what it starts with
    try:
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
