"""Exact Parquet parts: what Spark's sink can't write is written from Arrow batches by a task.

One part per source holds its rows in order. Types that Spark lacks (unsigned integers,
nanosecond ticks, decimals above 38 digits), nullability and byte metadata come from the
target schema. Larger outputs that may be split go through Spark's own sink instead:
`write_split`.
"""

from __future__ import annotations

import io
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.errors import LimitExceeded, Refusal
from tributary.plans.records import Limits, Part, Proposal, part_name
from tributary.plans.types import ROW, SOURCE, schema_to_arrow
from tributary.sources.parquet import sha256_file

WRITER = {"version": "2.6", "compression": "NONE", "use_dictionary": False}


def output_schema(proposal: Proposal) -> pa.Schema:
    schema = schema_to_arrow(proposal.fields, proposal.schema_metadata)
    return schema.append(pa.field(SOURCE, pa.uint32(), nullable=False)).append(pa.field(ROW, pa.uint64(), nullable=False))


def as_target(array: pa.Array, target: pa.DataType) -> pa.Array:
    """An engine column in its target type: the same numbers, ticks and nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_null(target):
        return pa.nulls(len(array))
    if pa.types.is_struct(target):
        children = [as_target(array.field(i), target.field(i).type) for i in range(target.num_fields)]
        return pa.StructArray.from_arrays(children, fields=list(target), mask=array.is_null()) if children else pa.array([None if v is None else {} for v in array.to_pylist()], target)
    if pa.types.is_timestamp(target):
        return array.cast(pa.int64()).cast(target)
    if pa.types.is_decimal256(target) and pa.types.is_string(array.type):
        from decimal import Context, Decimal

        exact = Context(prec=100)
        return pa.array([None if v is None else exact.create_decimal(Decimal(v)) for v in array.to_pylist()], target)
    return array.cast(target, safe=True)


class Metered(io.RawIOBase):
    """A new file that refuses, before it writes, what would take it beyond `most` bytes."""

    def __init__(self, path: str, most: int):
        self.file, self.most, self.size = open(path, "xb"), most, 0

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.size

    def write(self, raw) -> int:
        n = memoryview(raw).nbytes
        if self.size + n > self.most:
            raise LimitExceeded(f"max_output_bytes: the limit is {self.most}")
        self.file.write(raw)
        self.size += n
        return n

    def flush(self) -> None:
        if not self.file.closed:
            self.file.flush()

    def close(self) -> None:
        super().close()
        self.file.close()


def _write(path: str, schema: pa.Schema, most: int):
    """Writes rows that come in row order; gives -1 rows, and no file, if they don't."""

    def write(batches):
        draft = f"{path}.{uuid.uuid4().hex}"  # a retried or speculative task never writes another's file
        rows, last = 0, -1
        try:
            with Metered(draft, most) as out:
                writer = pq.ParquetWriter(out, schema, **WRITER)
                for batch in batches:
                    if batch.num_rows:
                        at = np.concatenate([[last], np.asarray(batch.column(batch.num_columns - 1))])
                        if (np.diff(at) <= 0).any():
                            yield pa.RecordBatch.from_pydict({"rows": pa.array([-1], pa.int64()), "bytes": pa.array([0], pa.int64()), "sha256": pa.array([""])})
                            return
                        last = int(at[-1])
                        writer.write_batch(pa.RecordBatch.from_arrays([as_target(batch.column(i), f.type) for i, f in enumerate(schema)], schema=schema))
                        rows += batch.num_rows
                writer.close()
            os.replace(draft, path)
        finally:
            if os.path.exists(draft):
                os.unlink(draft)
        size, sha = sha256_file(Path(path))
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64()), "bytes": pa.array([size], pa.int64()), "sha256": pa.array([sha])})

    return write


def write_part(df: DataFrame, proposal: Proposal, source_id: int, directory: Path, limits: Limits) -> Part:
    """Writes the aligned rows of one source, in row order; an empty source gives an empty part.

    A scan of one file, read by one task split after split, is in row order as it comes, so the task
    holds no more than a batch. Rows that come in another order are sorted first.
    """
    path, schema = str(directory / part_name(source_id)), output_schema(proposal)
    for rows in (whole := df.coalesce(1), whole.sortWithinPartitions(ROW)):
        plain = rows.toDF(*[f"c{i}" for i in range(len(df.columns))])  # Arrow maps take plain names only
        done = plain.mapInArrow(_write(path, schema, limits.max_output_bytes), "rows long, bytes long, sha256 string").collect()
        if not done or done[0]["rows"] >= 0:
            break
    else:
        raise Refusal(f"source={source_id}: a row number comes twice", "ERROR")
    if not done:
        pq.write_table(schema.empty_table(), path, **WRITER)
        size, sha = sha256_file(Path(path))
        return Part(part_name(source_id), source_id, 0, size, sha, proposal.schema_digest)
    return Part(part_name(source_id), source_id, done[0]["rows"], done[0]["bytes"], done[0]["sha256"], proposal.schema_digest)


def write_split(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """The converged rows through Spark's sink, a directory per source, every task writing its own files.

    For sizes at which one file per source isn't possible. Values are in the engine's types;
    rows keep their coordinates, so `compare` with key __pc_row verifies them all the same.
    """
    df.withColumn("source", F.col(SOURCE)).write.partitionBy("source").option("maxRecordsPerFile", rows_per_file).parquet(path)
