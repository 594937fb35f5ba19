"""Joins, orderings and merges that the reference's loops stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.classify import split_rank
from letterloom.shared import written
from letterloom.sources.bucket_table import reduced


def numbered_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``no``, 1 up in the given order: sorted in ranges, numbered by the sizes of those before; no single task sorts all.

    The sorted ranges are written once, and both the sizes and the rows are read from there: computed twice, the
    ranges could differ, as their bounds come from a sample. Rows that tie may stand in any order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn("no", F.col("_before") + F.col("_row") + 1).drop("_row", "_part", "_before")


def seeded_split(df: DataFrame, key: str, train: float = 0.6, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first part of a seeded order is train, the rest test."""
    placed = numbered_by(df.withColumn("_place", split_rank(key, seed)), "_place", key)
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return placed.join(F.broadcast(total)).withColumn("split", F.when(F.col("no") <= F.floor(F.col("_total") * train), "train").otherwise("test")).drop("_place", "_total", "no")


def left_broadcast(df: DataFrame, small: DataFrame, on: str, limit_bytes: int = 64 << 20) -> DataFrame:
    """Left equi-join that broadcasts ``small`` only where its estimated size is within ``limit_bytes``."""
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.join(F.broadcast(small) if size <= limit_bytes else small, on, "left")


#: Rows of a key from which it is split, and keys whose list is broadcast at most.
HOT, HOT_KEYS = 100_000, 100_000


def join_to_one(df: DataFrame, one: DataFrame, key: str, limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``df`` with ``one``, which has one row per key, where a single key may hold a large part of ``df``.

    Keys of more than ``limit`` rows are counted first, by an aggregate that combines before its shuffle. Their rows
    are dealt by a hash of all their columns over parts of about ``limit``, the same if a task is repeated, and their
    row of ``one`` goes to each part; other keys have one part. ``sizes`` (key, _n) spares the count where it is known.
    """
    limit = limit or HOT
    hot = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes).where(F.col("_n") > limit)
    hot = written(hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot-keys")
    found = hot.count()  # at most the rows of ``df`` divided by the limit
    if not found:
        return df.join(one, key)
    known = F.broadcast(hot) if found <= HOT_KEYS else hot
    parts = F.coalesce("_parts", F.lit(1))
    dealt = df.join(known, key, "left").withColumn("_part", F.pmod(F.xxhash64(*df.columns), parts).cast("int")).drop("_parts")
    copies = one.join(known, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def nested_children(parents: DataFrame, children: DataFrame, on: str, order: str, *columns: str) -> DataFrame:
    """Parents with their children as an ordered list, empty for none."""
    lists = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))
    return parents.join(lists, on, "left").withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def upsert(old: DataFrame, new: DataFrame, key: str, update: tuple[str, ...], position: str | None = None) -> DataFrame:
    """Keyed merge as a new relation: known keys take ``update`` columns from ``new``, unknown ones are added.

    A key that repeats in ``new`` is one row: ``update`` columns of its last row by ``position`` (without one, in the
    order of rows), the others of its first. Rows of ``new`` without a key are left out.
    """
    if position is None:
        new, position = new.withColumn("_position", F.monotonically_increasing_id()), "_position"
    a, b = old.alias("a"), reduced(new.select(*old.columns, position), key, update, position).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    known = F.col(f"a.{key}").isNotNull()

    def column(c: str) -> Column:
        if c in update:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
        return F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))

    return joined.select(*(column(c).alias(c) for c in old.columns))


def last_wins(df: DataFrame, key: str, position: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("_v")).select(key, "_v.*")


def first_k(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps ``k`` per group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= k).drop("_r")
