"""Folders of whole files as a Spark data source, ``document_files``: one row per file, read and written.

Reading lists the folder once, keeps the files that pushed conditions on the name leave, and plans partitions of
about equal bytes, so that neither one large file nor many small ones make a task of their own size. Writing gives
each row a file of its own in two steps: tasks write to a hidden staging folder of the job, and only when all of them
have ended are the files moved to their names; a job that fails removes its staging folder. Files are reached
through Arrow's file systems, local or remote, by the folder's address.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

FORMAT = "document_files"
SCHEMA = "filename string, path string, length long, content binary"
#: Bytes of a partition that is planned, and what opening a file counts as.
PARTITION, OPENING = 32 << 20, 16 << 10
#: Bytes read before a batch is handed over.
BATCH = 8 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let conditions on names reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)


def reach(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _hidden(path: str, root: str) -> bool:
    return any(part[:1] in "._" for part in path[len(root) :].strip("/").split("/"))


class DocumentFiles(ds.DataSource):
    """Options: ``path``, the folder; for reading ``recursive`` (true by default) and ``suffixes`` (``png,jpg``, in either case); for writing ``force`` and ``indent``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        suffixes = tuple(f".{x.lower()}" for x in self.options.get("suffixes", "").split(",") if x)
        return FileReader(self.options["path"], self.options.get("recursive", "true").lower() == "true", suffixes)

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        names = {f.name for f in schema.fields}
        if not {"filename", "content"} <= names:
            raise ValueError(f"needs filename and content, has {sorted(names)}")
        indent = self.options.get("indent")
        return FileWriter(self.options["path"], overwrite or self.options.get("force", "false").lower() == "true", int(indent) if indent else None)


@dataclass
class Files(ds.InputPartition):
    found: list[tuple[str, int]]


class FileReader(ds.DataSourceReader):
    def __init__(self, path: str, recursive: bool, suffixes: tuple[str, ...]):
        self.path, self.recursive, self.suffixes, self.tests = path, recursive, suffixes, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Take conditions on the name; the others stay with Spark."""
        known = (ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
        for f in filters:
            inner = f.child if isinstance(f, ds.Not) else f
            if isinstance(f, ds.IsNotNull) and f.attribute == ("filename",):
                continue  # no file is without a name
            if isinstance(inner, known) and inner.attribute == ("filename",):
                self.tests.append(f)
            else:
                yield f

    def passes(self, name: str) -> bool:
        def one(f) -> bool:
            if isinstance(f, ds.Not):
                return not one(f.child)
            if isinstance(f, ds.In):
                return name in f.value
            if isinstance(f, ds.StringStartsWith):
                return name.startswith(f.value)
            if isinstance(f, ds.StringEndsWith):
                return name.endswith(f.value)
            return f.value in name if isinstance(f, ds.StringContains) else name == f.value

        return (not self.suffixes or name.lower().endswith(self.suffixes)) and all(map(one, self.tests))

    def listed(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files left, by path."""
        fs, root = reach(self.path)
        found = fs.get_file_info(arrow_fs.FileSelector(root, recursive=self.recursive, allow_not_found=True))
        return sorted((i.path, i.size) for i in found if i.is_file and not _hidden(i.path, root) and self.passes(i.base_name))

    def partitions(self) -> list[Files]:
        """Files in order of their paths, cut where a partition's bytes are reached."""
        out, size = [Files([])], 0
        for path, length in self.listed():
            if size and size + length + OPENING > PARTITION:
                out.append(Files([]))
                size = 0
            out[-1].found.append((path, length))
            size += length + OPENING
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = reach(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            names, paths, lengths, contents = map(list, zip(*rows, strict=True))
            return pa.record_batch([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())], names=["filename", "path", "length", "content"])

        for path, length in partition.found:
            with fs.open_input_file(path) as file:
                rows.append((path.rsplit("/", 1)[-1], path, length, file.read()))
            size += length
            if size >= BATCH or len(rows) >= 1_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Staged(ds.WriterCommitMessage):
    folder: str
    written: int
    skipped: int


class FileWriter(ds.DataSourceArrowWriter):
    """Rows (filename, content) to files; a name that is there already is skipped unless forced."""

    def __init__(self, path: str, force: bool, indent: int | None):
        self.path, self.force, self.indent = path, force, indent
        self.staging = f".staging-{uuid.uuid4().hex}"  # made on the driver: the job's own

    def _bytes(self, content: str | bytes) -> bytes:
        if self.indent is not None:
            content = json.dumps(json.loads(content), ensure_ascii=False, indent=self.indent)
        return content.encode() if isinstance(content, str) else content

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = reach(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # an attempt's own: a repeated task shares nothing with the first
        fs.create_dir(folder, recursive=True)
        written = skipped = 0
        for batch in batches:
            names, contents = batch.column("filename").to_pylist(), batch.column("content").to_pylist()
            there = [False] * len(names) if self.force else [i.type != arrow_fs.FileType.NotFound for i in fs.get_file_info([f"{root}/{n}" for n in names])]
            for name, content, exists in zip(names, contents, there, strict=True):
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"no name for a file: {name!r}")
                if exists or content is None:
                    skipped += 1
                    continue
                with fs.open_output_stream(f"{folder}/{name}") as file:
                    file.write(self._bytes(content))
                written += 1
        return Staged(folder, written, skipped)

    def commit(self, messages: list[Staged | None]) -> None:
        """Give the files of ended tasks their names; what other attempts left goes with the staging folder."""
        fs, root = reach(self.path)
        for message in messages:
            for info in fs.get_file_info(arrow_fs.FileSelector(message.folder)) if message else ():
                fs.move(info.path, f"{root}/{info.base_name}")
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = reach(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type != arrow_fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


def read(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """filename, path, length, content of a folder's files; suffixes and conditions on ``filename`` decide what is opened."""
    register(spark)
    return spark.read.format(FORMAT).option("suffixes", ",".join(suffixes)).load(folder)


def write(df: DataFrame, folder: str, force: bool = False, indent: int | None = None) -> None:
    """One file per row of ``df`` (filename, content); all of them appear, or none."""
    register(df.sparkSession)
    options = {"force": str(force).lower(), **({"indent": str(indent)} if indent is not None else {})}
    df.select("filename", "content").write.format(FORMAT).mode("append").options(**options).save(folder)
