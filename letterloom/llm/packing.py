"""Operator 6: best-two-fit packing of token pieces into sequences of fixed capacity.

Only piece lengths matter to a packing, and there are at most ``capacity`` of them. So the lengths are counted
in Spark, the packing is planned over the counts (its size depends on the capacity, never on the data), and the
plan is dealt to the pieces by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.common import partitions, text_batches
from letterloom.llm.tokens import id_encoder

PIECES = "uid long, doc_id long, piece int, start long, length long, ids binary"


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(vocabulary)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        try:
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                for begin, texts in text_batches(batch.column("text")):
                    rows: list[tuple] = []
                    for k, ids in enumerate(encode.joined(texts)):
                        ids += end
                        rows += [(keys[begin + k], p // step, p // 4, min(len(ids) - p, step) // 4, ids[p : p + step]) for p in range(0, len(ids), step)]
                    doc, piece, start, length, ids = zip(*rows, strict=True)
                    yield pa.record_batch(
                        [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "piece", "start", "length", "ids"],
                    )
        finally:  # workers stay for other stages, and by this much larger otherwise
            encode.forget()

    return run


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: uid (one per row), doc_id, piece, start, length, ids.

    A null text is empty and gives the end id alone; repeated doc_ids stay rows of their own. ids are
    little-endian uint32. Write the result before packing it: uid numbers the rows of this computation.
    """

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = docs.mapInArrow(_pieces(vocabulary, end_id, capacity), "doc_id long, piece int, start long, length long, ids binary")
    return pieces.select(F.monotonically_increasing_id().alias("uid"), "*")


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Plan sequences for ``counts`` pieces of each length; returns (runs, number of sequences).

    A sequence starts with the longest length left and is filled greedily with the longest that fits. Then,
    while that packs it more tightly, its smallest piece goes and the two unpacked pieces come that leave the
    least of the gap so enlarged. The sequence found is repeated as often as the counts allow, which uses up a
    length, so there are at most as many kinds of sequences as lengths. Runs are rows (length, first rank,
    pieces per sequence, first sequence, first offset), sorted by length and rank.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} in sequences of {capacity}")
        left[length] = n
    below = np.zeros(capacity + 1, np.int64)  # the longest length with pieces left, up to each length

    def refresh() -> None:
        np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0), out=below)

    refresh()
    used = np.zeros(capacity + 1, np.int64)

    def longest(gap: int) -> int:
        at = int(below[gap])
        while at and used[at] >= left[at]:
            at = int(below[at - 1])
        return at

    ranks = np.zeros(capacity + 1, np.int64)
    runs, sequences = [], 0
    while below[capacity]:
        bin_: list[int] = []
        gap = capacity
        while gap and (take := longest(gap)):
            fits = min(int(left[take] - used[take]), gap // take)
            bin_ += [take] * fits
            used[take] += fits
            gap -= take * fits
        while gap and len(bin_) > 1:  # longest first, so the last one is the smallest
            wide = gap + bin_[-1]
            free = np.flatnonzero(left[: wide + 1] > used[: wide + 1])
            mates = below[wide - free]
            sums = np.where((mates > 0) & (mates <= free) & (left[mates] > used[mates] + (mates == free)), free + mates, 0)
            if not len(sums) or (best := int(sums.max())) <= bin_[-1]:
                break
            first = int(free[int(sums.argmax())])
            used[bin_.pop()] -= 1
            for x in (first, best - first):
                used[x] += 1
                bin_.append(x)
            bin_.sort(reverse=True)
            gap = wide - best
        kinds, each = np.unique(bin_, return_counts=True)
        times = int((left[kinds] // each).min())
        offset = 0
        for length, n in zip(kinds[::-1].tolist(), each[::-1].tolist(), strict=True):
            runs.append((length, int(ranks[length]), n, sequences, offset))
            ranks[length] += n * times
            offset += length * n
        left[kinds] -= each * times
        used[kinds] = 0
        sequences += times
        refresh()
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (uid, length, ... from a written table) with sequence_id and offset.

    Ranks within a length are counted in salted parts, as a third of all pieces may have one length: row
    numbers within (length, salt), then the salts' counts are added up. Columns sequence_id and offset of the input
    are replaced, those that begin with an underscore are dropped; all others keep their names.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop(*(c for c in pieces.columns if c.startswith("_")))
    salts = partitions(spark)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan_sequences(totals, capacity)
    plan = spark.sparkContext.broadcast(runs)
    before = counts.select(
        "length", "_salt",
        F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("uid"))
    ranked = pieces.withColumn("_within", within).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        starts = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            run = runs[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    names = [c for c in pieces.columns if c not in ("_salt", "sequence_id", "offset")]
    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, length, ids (little-endian uint32). A group holds one sequence, so ``capacity`` ids at most."""
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return whole.select("sequence_id", "length", F.expr("aggregate(_parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
