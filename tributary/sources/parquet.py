"""Footers, snapshots, hashes and scans of Parquet sources.

Planning needs a footer per file, on the driver. Rows are read by Spark only, with an
explicit schema: columns Spark would reinterpret (all-null, unsigned, timestamps, wide
decimals) are read in the engine's own types.
"""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import stat
from dataclasses import dataclass
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tributary.errors import Conflicted, Incomplete, LimitExceeded, Refusal
from tributary.plans.records import Limits, Source, check_identifier, check_inventory
from tributary.plans.types import ROW, SOURCE, Field, field_from_arrow, readable, to_scan

CHUNK = 1 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class HadoopFile(io.RawIOBase):
    """A file of any store that Spark reads, for a few small random reads on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size, self.place = store.getFileStatus(at).getLen(), 0
        self.stream, self.utils = store.open(at), jvm.org.apache.commons.io.IOUtils

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = 0) -> int:
        self.place = offset + (0, self.place, self.size)[whence]
        return self.place

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.place if n is None or n < 0 else min(n, self.size - self.place)
        if n <= 0:
            return b""
        self.stream.seek(self.place)
        raw = bytes(self.utils.toByteArray(self.stream, n))
        self.place += n
        return raw

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def footer(path) -> tuple[tuple[Field, ...], tuple, int]:
    """(fields, schema metadata, rows) of a file (a local path or an open file), from its footer only."""
    with pq.ParquetFile(path, arrow_extensions_enabled=False, pre_buffer=False) as file:
        schema = file.schema_arrow
        if schema.metadata and any(k.startswith(b"ARROW:extension:") for k in schema.metadata):
            raise Refusal("schema metadata names an extension type", "UNSUPPORTED")
        return tuple(field_from_arrow(f) for f in schema), tuple((schema.metadata or {}).items()), file.metadata.num_rows


def checked_directory(path: Path) -> Path:
    """An absolute directory that no symbolic link leads to."""
    path = Path(os.path.abspath(path))
    for p in (path, *path.parents):
        if p.is_symlink():
            raise Refusal(f"{p} is a symbolic link")
    if not path.exists():
        raise Incomplete(f"{path} doesn't exist")
    if not path.is_dir():
        raise Refusal(f"{path} isn't a directory")
    return path


def _identity(info: os.stat_result) -> tuple:
    return info.st_dev, info.st_ino, info.st_size, info.st_mtime_ns, info.st_ctime_ns


def open_inside(root: Path, identifier: str):
    """A regular file under `root`, opened segment by segment without following links."""
    parts = check_identifier(identifier).split("/")
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for i, name in enumerate(parts):
            last = i == len(parts) - 1
            try:
                down = os.open(name, os.O_RDONLY | os.O_NOFOLLOW | (0 if last else os.O_DIRECTORY), dir_fd=at)
            except FileNotFoundError:
                raise Incomplete(f"source {identifier!r} doesn't exist") from None
            except OSError as error:
                raise Refusal(f"source {identifier!r}: {error.strerror}", "ERROR") from error
            os.close(at)
            at = down
        if not stat.S_ISREG(os.fstat(at).st_mode):
            raise Refusal(f"source {identifier!r} isn't a regular file", "ERROR")
        file, at = os.fdopen(at, "rb"), None
        return file
    finally:
        if at is not None:
            os.close(at)


@dataclass(frozen=True)
class Copy:
    """A private copy of a source: what was hashed is what is read."""

    identifier: str
    path: Path | str
    size: int
    sha256: str


def sha256_file(path: Path) -> tuple[int, str]:
    h, size = hashlib.sha256(), 0
    with open(path, "rb") as file:
        while block := file.read(CHUNK):
            h.update(block)
            size += len(block)
    return size, h.hexdigest()


def snapshot(root: Path, identifiers: list[str], staging: Path, limits: Limits, expected: tuple[Source, ...] = ()) -> list[Copy]:
    """Copies the sources in order, within the byte caps; a source that changes meanwhile, or isn't the expected one, refuses."""
    root = checked_directory(root)
    if len(identifiers) > limits.max_files:
        raise LimitExceeded(f"max_files: {len(identifiers)}, the limit is {limits.max_files}")
    copies, total, seen = [], 0, set()
    for i, identifier in enumerate(identifiers):
        target = staging / f"source-{i:05d}.parquet"
        h, size = hashlib.sha256(), 0
        with open_inside(root, identifier) as file, open(target, "xb") as out:
            before = os.fstat(file.fileno())
            if before.st_ino in seen:
                raise Refusal(f"source {identifier!r} is another source's file", "ERROR")
            seen.add(before.st_ino)
            while block := file.read(CHUNK):
                size += len(block)
                total += len(block)
                if total > min(limits.max_input_bytes, limits.max_staging_bytes):
                    raise LimitExceeded(f"max_input_bytes: the limit is {limits.max_input_bytes}")
                h.update(block)
                out.write(block)
            if _identity(before) != _identity(os.fstat(file.fileno())):
                raise Refusal(f"source {identifier!r} changed while it was read", "ERROR")
        os.chmod(target, 0o400)
        copies.append(Copy(identifier, target, size, h.hexdigest()))
    for copy, source in zip(copies, expected):
        if (copy.identifier, copy.size, copy.sha256) != (source.relative_path, source.size_bytes, source.sha256):
            raise Conflicted(f"source {copy.identifier!r} isn't the one in the plan")
    return copies


def inventory(copies: list[Copy], limits: Limits, spark: SparkSession | None = None) -> tuple[Source, ...]:
    """Footers of all copies, refused as soon as the sums pass a cap; through Spark's own stores if it is given."""
    out: list[Source] = []
    for i, copy in enumerate(copies):
        columns, pairs, rows = footer(str(copy.path) if spark is None else HadoopFile(spark, str(copy.path)))
        out.append(Source(i, copy.identifier, copy.sha256, copy.size, rows, columns, pairs))
        check_inventory(tuple(out), limits)
    return tuple(out)


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, changed, sha256) of files of up to 2 GB in any store, one row of a task per file."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("changed"), F.sha2("content", 256).alias("sha256"))


def in_place(spark: SparkSession, root: str, identifiers: list[str], limits: Limits, expected: tuple[Source, ...] = ()) -> tuple[list[Copy], list[tuple]]:
    """Sources read where they are, in any store: sizes and hashes by tasks, nothing copied.

    Also gives what `unchanged` compares after the last read; the caps on files and bytes hold as
    for private copies.
    """
    if len(identifiers) > limits.max_files:
        raise LimitExceeded(f"max_files: {len(identifiers)}, the limit is {limits.max_files}")
    root = root.rstrip("/")
    paths = [f"{root}/{check_identifier(i)}" for i in identifiers]
    copies, marks = [], []
    found = _states(spark, paths)
    if sum(size for size, _, _ in found) > limits.max_input_bytes:
        raise LimitExceeded(f"max_input_bytes: the limit is {limits.max_input_bytes}")
    by_path = {r["path"]: r["sha256"] for r in hashes(spark, paths).collect()}  # a row per file
    for i, path, (size, changed, full) in zip(identifiers, paths, found):
        if full not in by_path:
            raise Refusal(f"source {i!r} can't be hashed", "ERROR")
        copies.append(Copy(i, path, size, by_path[full]))
        marks.append((size, changed))
    if len({f for *_, f in found}) < len(found):
        raise Refusal("a source is another source's file", "ERROR")
    for copy, source in zip(copies, expected):
        if (copy.identifier, copy.size, copy.sha256) != (source.relative_path, source.size_bytes, source.sha256):
            raise Conflicted(f"source {copy.identifier!r} isn't the one in the plan")
    return copies, marks


def _states(spark: SparkSession, paths: list[str]) -> list[tuple[int, int, str]]:
    """(bytes, time of change, full path) of regular files."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            raise Incomplete(f"{path} doesn't exist")
        state = store.getFileStatus(at)
        if not state.isFile():
            raise Refusal(f"{path} isn't a regular file", "ERROR")
        out.append((state.getLen(), state.getModificationTime(), state.getPath().toString()))
    return out


def unchanged(spark: SparkSession, copies: list[Copy], marks: list[tuple]) -> None:
    for copy, mark, (size, changed, _) in zip(copies, marks, _states(spark, [str(c.path) for c in copies])):
        if (size, changed) != mark:
            raise Refusal(f"source {copy.identifier!r} changed while it was read", "ERROR")


def located(path: Path | str) -> Path | str:
    """A path with a scheme as it is, a local one absolute."""
    return str(path) if "://" in str(path) else Path(path).absolute()


def identity(spark: SparkSession, path: Path | str) -> tuple[int, str]:
    """(bytes, sha256) of a local file, or by a task of one in any store."""
    if not isinstance(path, str):
        return sha256_file(path)
    _states(spark, [path])
    found = hashes(spark, [path]).first()
    return found["length"], found["sha256"]


def scan(spark: SparkSession, path: str, source_id: int, columns: tuple[Field, ...]) -> DataFrame:
    """All readable columns of one file in the engine's types, with __pc_source and __pc_row.

    Splits of the file run in parallel; the row number comes from the reader, so it doesn't
    depend on them. Columns that a query doesn't use aren't read.
    """
    schema = S.StructType([S.StructField(f.name, to_scan(f.type), True) for f in columns if readable(f.type)])
    df = spark.read.schema(schema).parquet(path)
    position = F.col("_metadata.row_index")
    return df.select(*[F.col(quoted(f.name)) for f in schema], F.lit(source_id).alias(SOURCE), position.alias(ROW))


def scan_alike(spark: SparkSession, paths: list[str], source_ids: list[int], columns: tuple[Field, ...]) -> DataFrame:
    """`scan` of several files of one footer as one read: the source comes from the file's name by a join with a row per file."""
    schema = S.StructType([S.StructField(f.name, to_scan(f.type), True) for f in columns if readable(f.type)])
    names = [p.rsplit("/", 1)[-1] for p in paths]
    known = spark.createDataFrame(list(zip(names, source_ids)), f"__pc_name string, {SOURCE} int")
    df = spark.read.schema(schema).parquet(*paths)
    df = df.select(*[F.col(quoted(f.name)) for f in schema], F.col("_metadata.file_name").alias("__pc_name"), F.col("_metadata.row_index").alias(ROW))
    return df.join(F.broadcast(known), "__pc_name").select(*[F.col(quoted(f.name)) for f in schema], SOURCE, ROW)


def child(column: Column, name: str) -> Column:
    return column.getField(name)


def clear(directory: Path) -> None:
    shutil.rmtree(directory, ignore_errors=True)
