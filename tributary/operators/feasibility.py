"""Planning: snapshot, footers, lattice, and a feasibility scan of every row."""

from __future__ import annotations

import tempfile
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tributary.errors import Incompatible, LimitExceeded, Refusal, status_of
from tributary.functions.exact import factor, tick_bounds
from tributary.operators.align import converge
from tributary.plans.documents import canonical
from tributary.plans.lattice import propose
from tributary.plans.records import Limits, Plan, Proposal, Source, check_identifier, diagnostic
from tributary.plans.types import ROW, SOURCE, Field, readable, schema_to_arrow
from tributary.session import exact
from tributary.sources.parquet import child, in_place, inventory, quoted, scan, snapshot, unchanged

VIOLATION = "__pc_source int, __pc_row long, path string, tick long, factor long"


def tick_checks(have: tuple[Field, ...], want: tuple[Field, ...], path=(), at: Column | None = None) -> list[tuple[tuple[str, ...], Column, int]]:
    """(path, tick column, factor) of every timestamp that a source has to rescale.

    Reading a child of a null struct gives null, so hidden children are not observations.
    """
    own = {f.name: f.type for f in have}
    out = []
    for f in want:
        t = own.get(f.name)
        if t is None or not readable(t):
            continue
        column = F.col(quoted(f.name)) if at is None else child(at, f.name)
        if t.kind == "struct":
            out += tick_checks(t.fields, f.type.fields, (*path, f.name), column)
        elif t.kind == "timestamp" and t.unit != f.type.unit:
            out.append(((*path, f.name), column, factor(t, f.type)))
    return out


def violations(spark: SparkSession, sources: tuple[Source, ...], paths: list[str], proposal: Proposal) -> DataFrame:
    """Every tick that the target's unit can't hold: __pc_source, __pc_row, path, tick, factor.

    One pass over the timestamp columns that are rescaled; sources without any aren't read.
    """
    frames = []
    for s, p in zip(sources, paths):
        checks = tick_checks(s.fields, proposal.fields)
        if not checks:
            continue
        found = [
            F.when(~column.between(*[F.lit(b).cast("long") for b in tick_bounds(times)]), F.struct(F.lit(canonical(list(path)).decode()).alias("path"), column.alias("tick"), F.lit(times).cast("long").alias("factor")))
            for path, column, times in checks
        ]
        bad = scan(spark, p, s.source_id, s.fields).select(SOURCE, ROW, F.explode(F.array_compact(F.array(*found))).alias("v"))
        frames.append(bad.select(SOURCE, ROW, "v.path", "v.tick", "v.factor"))
    return reduce(DataFrame.union, frames) if frames else spark.createDataFrame([], VIOLATION)


def row_counts(spark: SparkSession, sources: tuple[Source, ...], paths: list[str]) -> DataFrame:
    """(__pc_source, n, declared): rows that a scan finds against those that footers declare."""
    found = reduce(DataFrame.union, [scan(spark, p, s.source_id, s.fields).select(SOURCE) for s, p in zip(sources, paths)])
    declared = spark.createDataFrame([(s.source_id, s.num_rows) for s in sources], f"{SOURCE} int, declared long")
    return declared.join(found.groupBy(SOURCE).agg(F.count("*").alias("n")), SOURCE, "left").select(SOURCE, F.coalesce("n", F.lit(0)).alias("n"), "declared")


def check_writable(proposal: Proposal) -> None:
    """The target as an empty Parquet file: types that the format can't store are refused here."""
    import pyarrow.parquet as pq

    schema = schema_to_arrow(proposal.fields, proposal.schema_metadata)
    try:
        pq.write_table(schema.empty_table(), pa.BufferOutputStream())
    except (pa.ArrowNotImplementedError, NotImplementedError) as error:
        raise Refusal(f"Parquet can't store the target: {error}", "UNSUPPORTED") from error


def feasible(spark: SparkSession, sources: tuple[Source, ...], paths: list[str], proposal: Proposal, limits: Limits) -> int:
    """Runs every cast over every row and gives the number of rows; a value that doesn't fit refuses.

    One pass over the columns that are rescaled, one over all: the rows of each source are counted
    by the job that runs the casts.
    """
    first = violations(spark, sources, paths, proposal).orderBy(SOURCE, ROW, "path").limit(1).collect()
    if first:
        v = first[0]
        raise Incompatible(f"timestamp multiplication overflow at {v['path']}: source={v[SOURCE]} row={v[ROW]} ticks {v['tick']}, factor {v['factor']}")
    check_writable(proposal)
    rows = converge(spark, sources, paths, proposal)
    # a hash of all columns, so that none of the casts can be dropped
    values = [F.xxhash64(*[F.col(quoted(f.name)) for f in proposal.fields])] if proposal.fields else [F.lit(0)]
    counted = rows.groupBy(SOURCE).agg(F.count("*").alias("n"), F.bit_xor(values[0]).alias("h"))
    found = {r[SOURCE]: r["n"] for r in counted.collect()}  # a row per source
    for s in sources:
        if found.get(s.source_id, 0) != s.num_rows:
            raise Refusal(f"source={s.source_id} has {found.get(s.source_id, 0)} rows, its footer declares {s.num_rows}", "ERROR")
    total = sum(found.values())
    if total > limits.max_rows:
        raise LimitExceeded(f"max_rows: {total}, the limit is {limits.max_rows}")
    return total


def plan(spark: SparkSession, root: Path | str, identifiers: list[str], limits: Limits | None = None, where_they_are: bool = False) -> Plan:
    """A reviewable plan, or one whose status says why not. Nothing is written outside a private folder.

    Sources are copied to a private folder first, as the contract wants it of files that others may
    change. `where_they_are` reads them in place instead, from any store that Spark reads: hashes and
    rows by tasks, footers by a few small reads, and a source that changed meanwhile refuses.
    """
    limits = limits or Limits()
    exact(spark)
    sources: tuple[Source, ...] = ()
    proposal, counters = None, (0, 0, 0)
    try:
        for i in identifiers:
            check_identifier(i)
        if len(set(identifiers)) < len(identifiers):
            raise Refusal("a source is named twice")
        with tempfile.TemporaryDirectory(prefix="tributary-plan-") as staging:
            copies, marks = in_place(spark, str(root), identifiers, limits) if where_they_are else (snapshot(Path(root), identifiers, Path(staging), limits), None)
            size = sum(c.size for c in copies)
            counters = (len(copies), 0, size)
            sources = inventory(copies, limits, spark if where_they_are else None)
            proposal = propose(sources)
            Plan("INCOMPLETE", sources, proposal, limits=limits)  # the target's caps, before any row is read
            rows = feasible(spark, sources, [str(c.path) for c in copies], proposal, limits)
            if marks is not None:
                unchanged(spark, copies, marks)
            counters = (len(copies), rows, size)
            return Plan("NEEDS_DECISIONS" if proposal.conflicts else "READY_FOR_REVIEW", sources, proposal, True, limits, counters=counters)
    except (Exception, KeyboardInterrupt) as error:
        status = status_of(error)
        if isinstance(error, pa.ArrowInvalid) and not proposal:
            status = "ERROR"
        if status not in ("UNSUPPORTED", "LIMIT_EXCEEDED", "DATA_INCOMPATIBLE", "INCOMPLETE", "CANCELLED"):
            status = "ERROR"
        notes = (diagnostic(error),)
        try:
            return Plan(status, sources, proposal, limits=limits, diagnostics=notes, counters=counters)
        except Refusal:
            return Plan(status, limits=limits, diagnostics=notes)


def proposal_frame(spark: SparkSession, proposal: Proposal) -> DataFrame:
    """The target as rows: path (a JSON array), type, nullable."""
    from tributary.plans.decisions import walk

    rows = [(canonical(list(p)).decode(), f.type.label, f.nullable) for p, f in walk(proposal.fields)]
    return spark.createDataFrame(rows, "path string, type string, nullable boolean")


def operations_frame(spark: SparkSession, proposal: Proposal) -> DataFrame:
    return spark.createDataFrame([(o.source_id, canonical(list(o.path)).decode(), o.kind) for o in proposal.operations], "source_id int, path string, kind string")


def conflicts_frame(spark: SparkSession, proposal: Proposal) -> DataFrame:
    """A row per conflict and holder: path, k, source_id, v (null where the key is absent)."""
    rows = [(canonical(list(c.path)).decode(), c.key.decode(errors="replace"), s, None if v is None else v.decode(errors="replace")) for c in proposal.conflicts for s, v in c.values]
    return spark.createDataFrame(rows, S.StructType([S.StructField("path", S.StringType()), S.StructField("k", S.StringType()), S.StructField("source_id", S.IntegerType()), S.StructField("v", S.StringType())]))


