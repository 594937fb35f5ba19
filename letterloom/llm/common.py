"""What the training-data operators share: reading tables, shared scratch space, packed groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.shared import scratch, shared_dir, spread, written

__all__ = ["scratch", "shared_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader; one of fewer partitions than cores is dealt over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def text_batches(column: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts (null: empty) of about ``limit`` characters, each with its first row's number."""
    run: list[str] = []
    begin = size = 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= limit:
            yield begin, run
            run, begin, size = [], i + 1, 0
    if run:
        yield begin, run


#: Small tables of two numbers a row are broadcast up to so many rows, whose count is checked before.
BROADCAST_ROWS = 100_000


def split_hot(df: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Split groups that must be compared pairwise.

    Adds ``block`` and ``other`` (ints). A group of at most ``limit`` rows keeps one copy of each row with
    (0, 0). A larger one is dealt by a hash of ``member`` into blocks of about ``limit``; every unordered pair
    of blocks becomes a group of its own, named by ``pair`` = (smaller, larger), so that each pair of members
    still meets exactly once between different blocks, and once in the block's own group. No row is dropped.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = written(hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_blocks")), "hot-groups")
    found = hot.count()  # at most the rows divided by the limit
    if not found:
        return df.withColumns({"block": F.lit(0), "low_block": F.lit(0), "high_block": F.lit(0)})
    dealt = df.join(F.broadcast(hot) if found <= BROADCAST_ROWS else hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(
        *df.columns, "block",
        F.least("block", "_other").alias("low_block"), F.greatest("block", "_other").alias("high_block"),
    )


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in columns sorted together, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected row number of each of ``n`` rows linked by pairs (a, b), by minimum labels and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new[root]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole groups of ``keys`` from batches sorted by them; at least ``rows`` rows where there are so many."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        data = pa.Table.from_batches(held)
        last = [data.column(k)[-1].as_py() for k in keys]
        same = np.ones(data.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= data.column(k).to_numpy() == v
        cut = int(np.argmax(same))  # sorted: the last group is one run at the end
        if cut:
            yield data.slice(0, cut)
        held = data.slice(cut).to_batches()
        count = data.num_rows - cut
        rows = max(rows, 2 * count) if not cut else rows
    if count:
        yield pa.Table.from_batches(held)
