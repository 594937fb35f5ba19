"""Operator 1: token ids of documents in files of directly addressable codes, in ascending document order."""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.llm import dac
from letterloom.llm.common import partitions, text_batches
from letterloom.llm.tokens import id_encoder

#: Parts that a worker remembers: rare words come again after long stretches, and 150 000 more take about 40 MB.
REMEMBERED = 350_000
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"
READ = "file string, place int, doc_id long, begin long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, ids_per_file: int = 8_000_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files into ``folder``; returns the manifest, one row per file.

    Rows are range-partitioned by doc_id (the same id twice: ordered by text); a null id comes first and stays
    null, a null text is empty. ``end_id`` closes each document. A partition writes several files when it holds
    over ``ids_per_file`` ids, so memory is bounded. A repeated or speculative task writes files of its own names;
    the manifest, committed by Spark, names only those of the task that counted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = id_encoder(vocabulary, REMEMBERED)
        end = np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list = []
        ends: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, names, ends
            name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(posixpath.join(root, name)) as out:
                out.write(dac.encode(np.frombuffer(b"".join(ids), "<u4"), names, np.array(ends, np.int64)))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(names)], pa.int64()), pa.array([ends[-1]], pa.int64())], names=["part", "seq", "file", "n_docs", "n_ids"])
            seq, ids, names, ends = seq + 1, [], [], []
            return row

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for begin, texts in text_batches(batch.column("text"), 2_000_000):
                for k, values in enumerate(encode(texts)):
                    values.append(end)
                    ids.append(b"".join(values))
                    names.append(keys[begin + k])
                    ends.append((ends[-1] if ends else 0) + len(ids[-1]) // 4)
                    if ends[-1] >= ids_per_file:
                        yield flush()
        if names:
            yield flush()

    spark = docs.sparkSession
    docs.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back through the codes: file, place, doc_id, begin (in its file), n_tokens, ids_crc32, start."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                file = dac.Reader(content.as_buffer())
                begins = np.append(0, file.ends[:-1]).astype(np.int64)
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in file.documents()]
                yield pa.record_batch(
                    [pa.array([name] * file.n_docs), pa.array(range(file.n_docs), pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(begins), pa.array(file.ends - begins), pa.array(sums, pa.int64())],
                    names=["file", "place", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    # the manifest is one small row per file: it meets the digests, so no file content is shuffled
    read_back = files.mapInArrow(read, READ)
    return read_back.join(manifest, "file").withColumn("start", F.col("ids_before") + F.col("begin")).drop("ids_before")
