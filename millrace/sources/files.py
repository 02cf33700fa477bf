"""File systems as tasks and driver reach them, to list, read and write single files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..errors import ConfigError, StoreError


@dataclass(frozen=True)
class Place:
    """A folder or file of a file system, which any task can open."""

    scheme: str
    path: str
    options: dict = field(default_factory=dict)

    def open(self) -> tuple[fs.FileSystem, str]:
        if self.scheme == "file":
            return fs.LocalFileSystem(), self.path
        if self.scheme == "s3a":
            names = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.endpoint": "endpoint_override"}
            return fs.S3FileSystem(**{n: self.options[k] for k, n in names.items() if k in self.options}), self.path
        if self.scheme == "gs":
            return fs.GcsFileSystem(), self.path
        return fs.FileSystem.from_uri(f"{self.scheme}://{self.path}")

    def make(self) -> None:
        system, path = self.open()
        system.create_dir(path, recursive=True)

    def files(self) -> Iterator[fs.FileInfo]:
        """The file itself, or all files below the folder."""
        system, path = self.open()
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            yield info
        elif info.type == fs.FileType.Directory:
            yield from (x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File)


def where(uri: str, options: dict | None = None) -> Place:
    scheme, mark, rest = uri.partition("://")
    if not mark:
        if uri.startswith("file:"):
            return Place("file", "/" + uri[5:].lstrip("/"))
        return Place("file", os.path.abspath(uri))
    if scheme == "file":
        return Place("file", "/" + rest.lstrip("/"))
    if not rest:
        raise ConfigError(f"no bucket in {uri!r}")
    return Place({"s3": "s3a", "r2": "s3a"}.get(scheme, scheme), rest, options or {})


def listing(spark: SparkSession, root: Place, prefix: str = "", depth: int = 2) -> DataFrame:
    """(key, size, modified) of all files under a prefix of the root, hidden and empty ones too.

    The driver lists the upper ``depth`` levels of folders only; the folders below are listed by tasks.
    """
    system, base = root.open()
    top = f"{base.rstrip('/')}/{prefix}".rstrip("/") if prefix else base
    info = system.get_file_info(top)
    found, folders = [], []
    if info.type == fs.FileType.File:
        found.append(info)
    elif info.type == fs.FileType.Directory:
        level = [top]
        for i in range(depth):
            here = [x for f in level for x in system.get_file_info(fs.FileSelector(f))]
            found += [x for x in here if x.type == fs.FileType.File]
            level = [x.path for x in here if x.type == fs.FileType.Directory]
        folders = level
    cut = len(base.rstrip("/")) + 1
    schema = "key string, size long, modified long"

    def row(x: fs.FileInfo) -> tuple:
        return x.path[cut:], x.size, (x.mtime_ns or 0) // 1_000_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = root.open()
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = [row(x) for x in system.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["key", "size", "modified"])

    out = spark.createDataFrame([row(x) for x in found], schema)
    if folders:
        below = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders), "folder").mapInArrow(run, schema)
        out = out.unionByName(below)
    return out.where(~F.col("key").rlike(r"(^|/)\.[^/]*\.crc$"))


def contents(files: DataFrame, root: Place) -> DataFrame:
    """``files(key, ...)`` with ``content``, read by the tasks."""
    columns = files.columns
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = root.open()
        for batch in batches:
            at = batch.schema.get_field_index("key")
            for i, key in enumerate(batch.column(at).to_pylist()):
                with system.open_input_stream(f"{base.rstrip('/')}/{key}") as file:
                    raw = file.read()
                yield pa.record_batch([*(c.slice(i, 1) for c in batch.columns), pa.array([raw], pa.binary())], names=[*columns, "content"])

    return files.mapInArrow(run, schema)


def write_files(corpus: DataFrame, root: Place) -> int:
    """Writes ``corpus(uri, content)``, a file a row, under the root; returns their number. A file is replaced if it is
    there, so that a task that runs again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = root.open()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ".." in key.split("/") or key.startswith("/"):
                    raise StoreError(f"key leaves its root: {key!r}")
                path = f"{base.rstrip('/')}/{key}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(raw or b"")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = corpus.select("uri", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
