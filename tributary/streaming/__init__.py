"""Streams in an approved schema.

The batch lifecycle needs no stream. Files that keep arriving for an approved source can be
brought to the target with the same expressions: `aligned_stream` is a projection, so it has
no state and runs in any output mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tributary.operators.align import align
from tributary.plans.records import Proposal, Source
from tributary.plans.types import ROW, SOURCE, readable, to_scan
from tributary.sources.parquet import quoted


def aligned_stream(spark: SparkSession, directory: str, source: Source, proposal: Proposal) -> DataFrame:
    """New files of one source's schema, aligned; `file` is the file that __pc_row counts in."""
    schema = S.StructType([S.StructField(f.name, to_scan(f.type), True) for f in source.fields if readable(f.type)])
    rows = spark.readStream.schema(schema).parquet(directory)
    named = rows.select(*[F.col(quoted(f.name)) for f in schema], F.lit(source.source_id).alias(SOURCE), F.col("_metadata.row_index").alias(ROW), F.col("_metadata.file_path").alias("__pc_file"))
    out = align(named.withColumn(ROW, F.struct(ROW, "__pc_file")), source.fields, proposal.fields)
    return out.withColumn("file", F.col(ROW)["__pc_file"]).withColumn(ROW, F.col(ROW)[ROW])
