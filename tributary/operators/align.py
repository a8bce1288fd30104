"""Operations as column expressions, and the strict union by name.

A source becomes a projection of its scan to the target's fields in code-point order; the
union of identical schemas coerces nothing. Catalyst drops identity casts, folds inserted
nulls and prunes the branches of sources that a query doesn't ask for.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.exact import decimal_text, factor
from tributary.plans.records import Proposal, Source
from tributary.plans.types import ROW, SOURCE, Field, Type, readable, to_spark, wide
from tributary.sources.parquet import child, quoted, scan, scan_alike


def nulls(want: Type) -> Column:
    return F.lit(None).cast(to_spark(want))


def aligned(column: Column | None, have: Type | None, want: Type) -> Column:
    """A value of type `have` as `want`; overflow is an error, null stays null at its level."""
    if column is None or have is None or have.kind == "null":
        return nulls(want)
    if have.kind == "struct":
        if not readable(have):
            return nulls(want)
        own = {f.name: f.type for f in have.fields}
        parts = [aligned(child(column, f.name) if f.name in own and readable(own[f.name]) else None, own.get(f.name), f.type).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*parts)).otherwise(nulls(want))
    if have.kind == "timestamp" and have.unit != want.unit:
        return column * F.lit(factor(have, want)).cast("long")
    if wide(want):
        return decimal_text(column, have, want.scale)
    return column.cast(to_spark(want)) if to_spark(have) != to_spark(want) else column


def align(df: DataFrame, have: tuple[Field, ...], want: tuple[Field, ...]) -> DataFrame:
    """A scan with its provenance columns, projected to the target's fields."""
    own = {f.name: f.type for f in have}
    columns = [aligned(F.col(quoted(f.name)) if f.name in own and readable(own[f.name]) else None, own.get(f.name), f.type).alias(f.name) for f in want]
    return df.select(*columns, SOURCE, ROW)


#: From so many sources of one footer on, they are one read: a plan of thousands of branches would stop the driver.
ALIKE = 16


def converge(spark: SparkSession, sources: tuple[Source, ...], paths: list[str], proposal: Proposal) -> DataFrame:
    """All sources as one DataFrame in the target schema, with __pc_source and __pc_row.

    Sources whose columns are the same are read together where there are many of them; the others
    are branches of their own, which Catalyst drops where a query doesn't ask for their source.
    """
    groups: dict[tuple, list[tuple[Source, str]]] = {}
    for s, path in zip(sources, paths):
        groups.setdefault(tuple((f.name, f.type) for f in s.fields), []).append((s, path))
    frames = []
    for members in groups.values():
        have, names = members[0][0].fields, {p.rsplit("/", 1)[-1] for _, p in members}
        if len(members) >= ALIKE and len(names) == len(members) and all(re.fullmatch(r"[\w.-]+", n, re.ASCII) for n in names):
            frames.append(align(scan_alike(spark, [p for _, p in members], [s.source_id for s, _ in members], have), have, proposal.fields))
        else:
            frames += [align(scan(spark, p, s.source_id, s.fields), s.fields, proposal.fields) for s, p in members]
    return reduce(DataFrame.unionByName, frames)
