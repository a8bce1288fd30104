"""Shared-storage helpers: input tables, cut lineage, sizes that fix parallelism."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_tributary_shared", None)
        if root is None:
            root = spark._tributary_shared = tempfile.mkdtemp(prefix="tributary-shared-")
    return root.rstrip("/")


#: What goes to a Python worker at once, in bytes: rows are counted in thousands, whatever their size.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


@contextmanager
def small_batches(spark: SparkSession):
    name, size = BATCH
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    The lineage ends at replicated storage, so a lost executor costs no more than
    its running tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of written frames that nothing will read again."""
    for df in frames:
        path = None if df is None else df.__dict__.get("_written_to")
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def block_count(total_bytes: int, block_bytes: int = 8 << 20, least: int = 256, small_bytes: int = 128 << 10) -> int:
    """A power of two: blocks of about `block_bytes` of text at any input size.

    Smaller inputs get up to `least` blocks, of `small_bytes` each, to spread evenly.
    """
    wanted = max(-(-total_bytes // block_bytes), min(least, -(-total_bytes // small_bytes)), 1)
    return 1 << (wanted - 1).bit_length()
