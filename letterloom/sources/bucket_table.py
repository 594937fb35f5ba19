"""Keyed tables in hash buckets: a merge rewrites only the buckets that its keys fall into.

A version is a small manifest that names, for each bucket, the folder with its rows; folders are written once and
never changed. A merge writes the touched buckets into folders of its own, then its manifest, and swaps the pointer
to it last: readers see the version before or the one after. Two merges at once cannot both write the next manifest;
the second fails and can be repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.shared import written


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; fails where it is already there."""
    place, fs = _path(spark, path)
    out = fs.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    place, fs = _path(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _swap(spark: SparkSession, source: str, target: str) -> None:
    """Rename over what is there, in one step where the file system can."""
    files = spark._jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(files.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    options[0] = files.Options.Rename.OVERWRITE
    context.rename(files.Path(source), files.Path(target), options)


def reduced(new: DataFrame, key: str, update: tuple[str, ...], position: str) -> DataFrame:
    """One row per key of ``new``: ``update`` columns of its last row by ``position``, the others of its first, as if merged row by row.

    Rows without a key are left out. The extremes are combined before the shuffle, however often a key repeats.
    """
    rest = [c for c in new.columns if c not in (key, position, *update)]
    packed = [f(F.struct(*columns), position).alias(name) for f, columns, name in ((F.max_by, update, "_last"), (F.min_by, rest, "_first")) if columns]
    one = new.where(F.col(key).isNotNull()).groupBy(key).agg(*packed) if packed else new.where(F.col(key).isNotNull()).select(key).distinct()
    return one.select(key, *(F.col(f"_last.{c}") for c in update), *(F.col(f"_first.{c}") for c in rest))


class BucketTable:
    """A table at ``path``, keyed by ``key``. ``buckets`` counts when the table is made, and is kept."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def manifest(self) -> dict | None:
        """The current version: number, buckets, schema, and the folder of each bucket that has rows."""
        current = _get(self.spark, f"{self.path}/_current")
        return json.loads(_get(self.spark, f"{self.path}/_versions/{current}.json")) if current else None

    def read(self) -> DataFrame:
        found = self.manifest()
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(T.StructType.fromJson(found["schema"]), list(found["folders"].values()))

    def _rows(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def merge(self, new: DataFrame, update: tuple[str, ...], position: str) -> dict:
        """Merge ``new`` and return the new manifest: keys that are known take ``update``, others are added; see ``reduced`` for repeats.

        ``new`` has the table's columns and ``position``; on the first merge it gives the table its columns. An empty
        ``new`` makes a version without touching a bucket.
        """
        before = self.manifest()
        buckets = before["buckets"] if before else self.buckets
        schema = T.StructType.fromJson(before["schema"]) if before else T.StructType([f for f in new.schema.fields if f.name != position])
        columns = [f.name for f in schema.fields]
        rows = written(reduced(new.select(*columns, position), self.key, update, position).withColumn("_bucket", self._bucket(buckets)), "merge")
        touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets``
        folders = dict(before["folders"]) if before else {}
        old = self._rows(schema, [folders[str(b)] for b in touched if str(b) in folders]).withColumn("_old", F.lit(True))
        a, b = old.alias("a"), rows.alias("b")
        joined = a.join(b, F.col(f"a.{self.key}") == F.col(f"b.{self.key}"), "full_outer")
        known, added = F.col("a._old").isNotNull(), F.col(f"b.{self.key}").isNotNull()

        def column(c: str) -> Column:
            mine, theirs = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
            return (F.when(added, theirs).otherwise(mine) if c in update else F.when(known, mine).otherwise(theirs)).cast(schema[c].dataType).alias(c)

        number, own = (before["number"] + 1 if before else 1), f"data/{uuid.uuid4().hex}"
        merged = joined.select(*(column(c) for c in columns)).withColumn("_bucket", self._bucket(buckets))
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{own}")
        after = {"number": number, "buckets": buckets, "schema": schema.jsonValue(), "folders": {**folders, **{str(b): f"{own}/_bucket={b}" for b in touched}}}
        _put(self.spark, f"{self.path}/_versions/{number}.json", json.dumps(after))  # fails if another merge was first
        pointer = f"{self.path}/_pointer-{uuid.uuid4().hex}"
        _put(self.spark, pointer, str(number))
        _swap(self.spark, pointer, f"{self.path}/_current")
        return after
