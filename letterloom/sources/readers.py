"""Sources: files, page providers, records, labels, manifests, catalogs, review sheets, audit logs and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import rules
from letterloom.sources import document_files, packs

#: Suffixes of supported evidence files.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff")

RECORD = (
    "filename string, is_scanned boolean, page_count int, doc_type struct<type: string>, region struct<code: string>, relevant_fields array<string>, "
    f"metadata struct<{', '.join(f + ': string' for f in rules.FIELDS)}>, missing_reasons map<string, string>, "
    f"verified struct<status: string, verified_by: string, values: struct<{', '.join(f + ': string' for f in rules.FIELDS)}>>"
)
MANIFEST = "innovation_id string, manifest_version string, evidences array<struct<filename: string, indicator_id: string, evidence_tag: string, pos: bigint>>"
CATALOG = "id string, name string, active boolean, mandatory boolean, evidence_tags array<string>, parameters array<struct<id: string, score: double>>, max_score double"
AUDIT = "action string, file string, sha256 string, reason string, pages_sent int, time string"


def supported(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, name_part: str = "", limit: int | None = None) -> DataFrame:
    """Files of supported suffixes whose name holds ``name_part``; ``limit`` keeps the first by name."""
    kept = files.where(F.lower("filename").rlike(rf"\.({'|'.join(suffixes)})$") & F.contains("filename", F.lit(name_part)))
    return kept.orderBy("filename").limit(limit) if limit is not None else kept


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, name_part: str = "", limit: int | None = None) -> DataFrame:
    """filename, path, length, content of supported files; suffixes and the name are tested before a file is opened. ``limit`` keeps the first by name."""
    found = document_files.read(spark, folder, suffixes)
    found = found.where(F.contains("filename", F.lit(name_part))) if name_part else found
    return found.orderBy("filename").limit(limit) if limit is not None else found


def pages(found: DataFrame, provider: Callable[[str, bytes], list[str]], most: int | None = None) -> DataFrame:
    """filename, page_no, text, error of files through a page provider (text layer, OCR).

    A provider's failure is a row with ``error`` and no text, so one bad file never fails the job. ``most`` keeps
    the first pages (3 for inspection, 4 for mapping, all for the dataset).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    rows += [(name, i, t, None) for i, t in enumerate(provider(name, bytes(content)))]
                except Exception as problem:  # noqa: BLE001 - a provider is foreign code
                    rows.append((name, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["filename", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    out = found.select("filename", "content").mapInPandas(read, "filename string, page_no int, text string, error string")
    return out if most is None else out.where(F.col("page_no").isNull() | (F.col("page_no") < most))


def images(found: DataFrame) -> DataFrame:
    """Image files as scans of one page without text."""
    return supported(found, SUFFIXES[1:]).select("filename", F.lit(1).alias("page_count"), F.lit(True).alias("is_scanned"), F.lit("").alias("text"))


def join_pages(df: DataFrame, key: str, page: str) -> DataFrame:
    """Page texts of each document joined by line ends, in page order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page), F.coalesce("text", F.lit("")).alias("text"))))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder, one file each as ``writers.record_json`` leaves them; a file that is no record is a row of nulls."""
    return records_from_json(document_files.read(spark, folder, ("json",)).select(F.col("content").cast("string").alias("json")))


def packed_records(spark: SparkSession, folder: str) -> DataFrame:
    """As ``json_records``, of what ``writers.record_packs`` leaves."""
    return records_from_json(packs.read(spark, folder, ("json",)).select(F.col("content").cast("string").alias("json")))


def records_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json(F.replace("json", F.lit('"pages":'), F.lit('"page_count":')), RECORD).alias("r")).select("r.*")


def manifest_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("json", MANIFEST).alias("m")).select("m.innovation_id", F.explode("m.evidences").alias("e")).select("innovation_id", "e.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evidence rows of manifest files; see ``relations.last_wins`` for repeated file names. No file: no rows."""
    try:
        return manifest_from_json(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return manifest_from_json(spark.createDataFrame([], "json string"))
        raise


def ground_truth_from_json(lines: DataFrame) -> DataFrame:
    """filename, field, value of label maps (filename to fields); a null value stays a row."""
    kind = f"map<string, struct<{', '.join(f + ': string' for f in rules.FIELDS)}>>"
    files_ = lines.select(F.explode(F.from_json("json", kind)).alias("filename", "v"))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"v.{f}").alias("value")) for f in rules.FIELDS))
    return files_.select("filename", F.explode(cells).alias("c")).select("filename", "c.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth_from_json(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def catalog_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("json", CATALOG).alias("c")).select("c.*")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of a catalog file that nests them under ``indicators``."""
    return spark.read.schema(f"indicators array<struct<{CATALOG}>>").json(path, multiLine=True).select(F.explode("indicators").alias("i")).select("i.*")


def audit_from_lines(lines: DataFrame) -> DataFrame:
    """Audit events of JSON lines (value); a malformed line is skipped."""
    parsed = lines.select(F.from_json("value", AUDIT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e is not null and e._bad is null").select("e.*").drop("_bad")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path, mode="DROPMALFORMED")


def delimiter(header: Column) -> Column:
    """The most frequent of comma, semicolon and tab in a header; comma on ties and without any."""
    count = lambda d: F.length(header) - F.length(F.replace(header, F.lit(d), F.lit("")))
    n = {d: count(d) for d in (",", ";", "\t")}
    return F.when((n[";"] > n[","]) & (n[";"] >= n["\t"]), ";").when((n["\t"] > n[","]) & (n["\t"] > n[";"]), "\t").otherwise(",")


def csv_sheet(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(shape, rows) of a review sheet, one file or a folder of parts: delimiter and shape are read from the first header; a byte order mark is dropped.

    ``rows`` has ``pos``, a row's place that orders: parts by name, rows within one as they stand. Unknown headers
    raise ValueError.
    """
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))  # a file is read by one task
    lines = spark.read.text(path).select("value", place.alias("place"))
    header = lines.agg(F.min_by(F.replace("value", F.lit("\ufeff"), F.lit("")), "place").alias("h")).select("h", delimiter(F.col("h")).alias("d")).first()
    header = header if header and header["h"] is not None else None
    columns = header["h"].strip().split(header["d"]) if header else []
    if "true_value" in columns:
        shape = "long"
    elif any(f"value_{f}" in columns for f in rules.FIELDS):
        shape = "wide"
    else:
        raise ValueError(f"unknown header: {columns}")
    rows = spark.read.csv(path, sep=header["d"], header=True, encoding="UTF-8", multiLine=True)  # such files are not split
    rows = rows.toDF(*(c.replace("﻿", "") for c in rows.columns))
    return shape, rows.withColumn("pos", place)


def relation(spark: SparkSession, name: str, fallback: str | None = None) -> DataFrame:
    """A catalog table, or the Parquet files at ``fallback`` where the catalog has no such table."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if fallback is None:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(fallback)
