"""Sinks. Appends are plain; updates write a new version beside the old one, since the file formats here have no merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.sources import document_files, packs


def _record_files(records: DataFrame) -> DataFrame:
    name = F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".json"))
    return records.select(name.alias("filename"), F.to_json(F.struct("*")).alias("content"))


def record_json(records: DataFrame, path: str, force: bool = False) -> None:
    """One indented JSON file per record, named as its document; files that are there already stay unless forced. All appear, or none."""
    document_files.write(_record_files(records), path, force=force, indent=2)


def record_packs(records: DataFrame, path: str, force: bool = False) -> None:
    """As ``record_json``, with the same names and bytes in packs: for more records than a folder should have files."""
    packs.write(_record_files(records), path, force=force, indent=2)


def append(df: DataFrame, path: str) -> None:
    """Extractions and evaluation runs: every run adds rows."""
    df.write.mode("append").parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def new_version(df: DataFrame, path: str) -> str:
    """Write the result of an upsert as the next version under ``path`` and return its folder; readers keep the old one meanwhile."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path)), default=0) if fs.exists(fs_path) else 0
    out = f"{path}/v{last + 1:06d}"
    df.write.parquet(out)
    return out


#: Rows of one file of a sheet: more than people read, and well within what a spreadsheet holds.
SHEET = 200_000


def csv_sheet(sheet: DataFrame, path: str) -> None:
    """A review sheet for people: one file, with a byte order mark as the first character of its header.

    A sheet of more than ``SHEET`` rows is several such files of about that many, in order of its first column; no
    task writes, or later reads, the whole of it.
    """
    first, *rest = sheet.columns
    parts = -(-sheet.count() // SHEET)
    rows = sheet.coalesce(1) if parts <= 1 else sheet.repartitionByRange(parts, first).sortWithinPartitions(first)
    rows.withColumnRenamed(first, f"\ufeff{first}").select(f"\ufeff{first}", *rest).write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def type_cache(df: DataFrame, path: str) -> None:
    df.select("filename", "doc_type", "region", "relevant_fields").write.mode("overwrite").json(path)


def markdown_row(*cells: str | Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(report: DataFrame) -> str:
    """A small aggregate as a Markdown table; for reports of a few rows, which come to the driver."""
    rows = report.select(markdown_row(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns)).alias("line")).toLocalIterator()
    return "\n".join(["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns), *(r["line"] for r in rows)])


def markdown_file(report: DataFrame, path: str, name: str) -> None:
    """``markdown`` of a small report as one file of a folder."""
    rows = report.sparkSession.createDataFrame([(name, markdown(report) + "\n")], "filename string, content string")
    document_files.write(rows, path, force=True)
