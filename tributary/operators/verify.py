"""Verification: output rows against source rows, observation by observation.

Shares no code with the planner or the alignment: the schema is derived again, and expected
values are compared as observations (text of exact numbers, ticks, bits of meaning for
floats) and not by casting the source to the target. The join is on the coordinates
(__pc_source, __pc_row), which are first shown to be dense and unique, one shuffle for
both sides; every observation of a row is one generated expression.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tributary.errors import Conflicted, Incomplete, LimitExceeded, Refusal, Unsupported, status_of
from tributary.functions.exact import decimal_text, same_float
from tributary.operators.derive import derive
from tributary.plans.documents import canonical, check_int, digest
from tributary.plans.records import Approved, Limits, Part, Proposal, Report, Source, diagnostic, runtime
from tributary.plans.types import ROW, SOURCE, Field, Type, field_from_arrow, to_scan
from tributary.session import exact
from tributary.sources.parquet import HadoopFile, footer, identity, located, quoted, scan, sha256_file

CONTROL = ("_decision.json", "_manifest.json", "_verification.json")
SECONDS = {"s": 0, "ms": 3, "us": 6, "ns": 9}
#: The reasons that reports give for an observation.
NO_NULL, NULL_WANTED, DIFFERS, PROVENANCE, OVERFLOW = "unexpected null observation", "expected null observation", "logical value differs", "provenance value differs", "expected timestamp ticks overflow int64"
PROVENANCE_FIELDS = (pa.field(SOURCE, pa.uint32(), nullable=False), pa.field(ROW, pa.uint64(), nullable=False))


@dataclass(frozen=True)
class Leaf:
    """One observation of a target field in a row: why it is wrong (null if it isn't), and whether it is there."""

    path: tuple[str, ...]
    wrong: Column
    present: Column


def stored(t: Type) -> bool:
    """Whether a scan has the column: something below it must not be all null."""
    return t.kind != "null" if t.kind != "struct" else any(stored(f.type) for f in t.fields)


def leaves(have: Type | None, want: Type, source: Column | None, output: Column | None, path: tuple[str, ...], present: Column | None = None) -> list[Leaf]:
    """The observations at and below a field, in target order; children count under a valid parent only."""
    there = F.lit(True) if present is None else present
    if have is None or have.kind == "null" or source is None:
        wrong = F.lit(None).cast("string") if output is None else F.when(there & output.isNotNull(), F.lit(NULL_WANTED))
        return [Leaf(path, wrong, there)]
    if output is None:
        return [Leaf(path, F.when(there & source.isNotNull(), F.lit(NO_NULL)), there)]
    both = there & source.isNotNull() & output.isNotNull()
    nulls = F.when(there & source.isNull() & output.isNotNull(), F.lit(NULL_WANTED)).when(there & source.isNotNull() & output.isNull(), F.lit(NO_NULL))
    if want.kind == "struct":
        own = {f.name: f.type for f in have.fields}
        out = [Leaf(path, nulls, there)]
        for f in want.fields:
            t = own.get(f.name)
            s = source.getField(f.name) if t is not None and stored(t) else None
            o = output.getField(f.name) if stored(f.type) else None
            out += leaves(t, f.type, s, o, (*path, f.name), there & source.isNotNull())
        return out
    if want.kind == "timestamp":
        times = 10 ** (SECONDS[want.unit] - SECONDS[have.unit])
        expected = F.try_multiply(source, F.lit(times).cast("long"))
        wrong = nulls.when(both & expected.isNull(), F.lit(OVERFLOW)).when(both & (expected != output), F.lit(DIFFERS))
        return [Leaf(path, wrong, there)]
    if want.kind.startswith("decimal"):
        same = decimal_text(source, have, want.scale) == decimal_text(output, want, want.scale)
    elif want.kind == "float":
        same = same_float(source.cast("double"), output.cast("double"))
    elif want.kind in ("int", "uint"):
        same = source.cast("decimal(20,0)") == output.cast("decimal(20,0)")
    else:
        same = source == output
    return [Leaf(path, nulls.when(both & ~same, F.lit(DIFFERS)), there)]


def output_scan(spark: SparkSession, path: str, fields: tuple[Field, ...]) -> DataFrame:
    """An output part as written, with the reader's own row number as __pc_at."""
    columns = [f for f in fields if stored(f.type)]
    schema = S.StructType([S.StructField(f.name, to_scan(f.type), True) for f in columns] + [S.StructField(SOURCE, S.LongType()), S.StructField(ROW, S.DecimalType(20, 0))])
    df = spark.read.schema(schema).parquet(path)
    return df.select(*[F.col(quoted(f.name)).alias(f"o{i}") for i, f in enumerate(columns)], F.col(SOURCE), F.col(ROW).cast("long").alias(ROW), F.col("_metadata.row_index").alias("__pc_at"))


def provenance_faults(output: DataFrame, source_id: int) -> DataFrame:
    """Rows of one part whose coordinates aren't (its source, their position)."""
    good = F.col(SOURCE).eqNullSafe(F.lit(source_id)) & F.col(ROW).eqNullSafe(F.col("__pc_at"))
    name = F.when(F.col(SOURCE).eqNullSafe(F.lit(source_id)), F.lit(canonical([ROW]).decode())).otherwise(F.lit(canonical([SOURCE]).decode()))
    return output.where(~good).select(F.lit(source_id).alias(SOURCE), F.col("__pc_at").alias(ROW), F.lit(-1).alias("place"), name.alias("path"), F.lit(PROVENANCE).alias("reason"))


def _paired(source: DataFrame, have: tuple[Field, ...], output: DataFrame, want: tuple[Field, ...], key: str) -> tuple[DataFrame, list[Leaf]]:
    own = {f.name: f.type for f in have}
    kept = [f for f in have if stored(f.type)]
    left = source.select(*[F.col(quoted(f.name)).alias(f"s{i}") for i, f in enumerate(kept)], F.col(ROW).alias("s_row"))
    right = output.withColumn("o_row", F.col(key))
    places = {f.name: f"s{i}" for i, f in enumerate(kept)}
    written = {f.name: f"o{i}" for i, f in enumerate(x for x in want if stored(x.type))}
    out: list[Leaf] = []
    for f in want:
        out += leaves(own.get(f.name), f.type, F.col(places[f.name]) if f.name in places else None, F.col(written[f.name]) if f.name in written else None, (f.name,))
    return left.join(right, left.s_row == right.o_row, "full_outer"), out


def compare(source: DataFrame, have: tuple[Field, ...], output: DataFrame, want: tuple[Field, ...], source_id: int, key: str = "__pc_at") -> DataFrame:
    """Faults of one part: __pc_source, __pc_row, place, path (a JSON array), reason.

    `place` is the position of the observation in target order; rows that one side lacks have -1.
    """
    joined, found = _paired(source, have, output, want, key)
    alone = F.when(F.col("s_row").isNull() | F.col("o_row").isNull(), F.struct(F.lit(-1).alias("place"), F.lit("[]").alias("path"), F.lit("one side has no such row").alias("reason")))
    faults = [F.when(F.col("s_row").isNotNull() & F.col("o_row").isNotNull() & leaf.wrong.isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(canonical(list(leaf.path)).decode()).alias("path"), leaf.wrong.alias("reason"))) for i, leaf in enumerate(found)]
    rows = joined.select(F.lit(source_id).alias(SOURCE), F.coalesce("s_row", "o_row").alias(ROW), F.explode(F.array_compact(F.array(alone, *faults))).alias("f"))
    return rows.select(SOURCE, ROW, "f.place", "f.path", "f.reason")


def observations(source: DataFrame, have: tuple[Field, ...], want: tuple[Field, ...]) -> Column:
    """Observations in a source row: one a field, and one a child under a valid parent."""

    def count(t: Type | None, target: Type, column: Column | None) -> Column:
        if target.kind != "struct" or t is None or t.kind != "struct" or column is None:
            return F.lit(1).cast("long")
        own = {f.name: f.type for f in t.fields}
        below = [count(own.get(f.name), f.type, column.getField(f.name) if f.name in own and stored(own[f.name]) else None) for f in target.fields]
        return F.lit(1).cast("long") + F.when(column.isNotNull(), reduce(Column.__add__, below, F.lit(0).cast("long"))).otherwise(0)

    own = {f.name: f.type for f in have}
    counts = [count(own.get(f.name), f.type, F.col(quoted(f.name)) if f.name in own and stored(own[f.name]) else None) for f in want]
    return reduce(Column.__add__, counts, F.lit(0).cast("long"))


def first_fault(faults: DataFrame) -> str | None:
    """The fault of the least (source, row, place), as a message."""
    rows = faults.orderBy(SOURCE, ROW, "place").limit(1).collect()
    return f"source={rows[0][SOURCE]} row={rows[0][ROW]} path={rows[0]['path']}: {rows[0]['reason']}" if rows else None


def check_part_schema(path: Path, proposal: Proposal, source_id: int) -> int:
    """A part's footer against the target: order, names, types, nullability, metadata. Gives its rows."""

    def fail(where: list[str], what: str):
        raise Conflicted(f"source={source_id} row=schema path={canonical(where).decode()}: {what}")

    with pq.ParquetFile(path, arrow_extensions_enabled=False, pre_buffer=False) as file:
        schema, rows = file.schema_arrow, file.metadata.num_rows
    if schema.names != [f.name for f in proposal.fields] + [SOURCE, ROW]:
        fail([], "columns differ in name or order")
    for f in PROVENANCE_FIELDS:
        if not schema.field(f.name).equals(f, check_metadata=False) or schema.field(f.name).metadata:
            fail([f.name], "a coordinate column has another type, nullability or metadata")
    if tuple(sorted((schema.metadata or {}).items())) != proposal.schema_metadata:
        fail([], "the part's schema carries other metadata than the target")

    def check(have: tuple[Field, ...], want: tuple[Field, ...], at: list[str]) -> None:
        if [f.name for f in have] != [f.name for f in want]:
            fail(at, "fields of a struct differ in name or order")
        for h, w in zip(have, want):
            if (h.nullable, h.metadata) != (w.nullable, w.metadata):
                fail([*at, w.name], "nullability or metadata isn't the target's")
            if h.type.kind == w.type.kind == "struct":
                check(h.type.fields, w.type.fields, [*at, w.name])
            elif h.type != w.type:
                fail([*at, w.name], "the type isn't the target's")

    check(tuple(field_from_arrow(schema.field(i)) for i in range(len(proposal.fields))), proposal.fields, [])
    return rows


def check_files(dataset: Path, parts: list[Part], limits: Limits, control: bool) -> None:
    """The directory has exactly the parts (and control files), all regular, within the byte cap."""
    want = {p.filename for p in parts} | (set(CONTROL) if control else set())
    have, total = set(), 0
    for entry in dataset.iterdir():
        if not entry.is_file() or entry.is_symlink() or entry.name not in want | set(CONTROL):
            raise Conflicted(f"the dataset has an entry that isn't recorded: {entry.name}")
        have.add(entry.name)
        total += entry.stat().st_size
        if total > limits.max_output_bytes:
            raise LimitExceeded(f"max_output_bytes: the limit is {limits.max_output_bytes}")
    if want - have or (have - want) - set(CONTROL):
        raise Conflicted(f"the dataset lacks {sorted(want - have)}")


def check_bytes(dataset: Path, parts: list[Part]) -> None:
    for p in parts:
        if sha256_file(dataset / p.filename) != (p.bytes, p.sha256):
            raise Conflicted(f"source={p.source_id} the part's bytes aren't those recorded")


def source_digest(sources: tuple[Source, ...]) -> str:
    return digest([s.to_json() for s in sources])


def output_digest(parts: list[Part]) -> str:
    return digest([p.to_json() for p in parts])


def refusal(status: str, error, approved: Approved | None) -> Report:
    status = status if status in ("CONFLICT", "UNSUPPORTED", "LIMIT_EXCEEDED", "INCOMPLETE", "ERROR", "CANCELLED") else "CONFLICT" if status in ("DATA_INCOMPATIBLE", "INVALID_INPUT") else "ERROR"
    return Report(status, approved.plan.digest if approved else "", approved.digest if approved else "", diagnostics=(diagnostic(error),))


@contextmanager
def reading(spark: SparkSession, batch_rows: int | None):
    """Scans within take batches of so many rows; what they give doesn't depend on it."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    if batch_rows is not None:
        spark.conf.set(name, batch_rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def verify(spark: SparkSession, approved: Approved, source_paths: list[Path | str], dataset: Path, parts: list[Part], control: bool = False, batch_rows: int | None = None) -> Report:
    """Everything afresh: sources, derived schema, parts' bytes and footers, coordinates, every observation.

    Source paths with a scheme are read where they are, in any store. `batch_rows` makes reads
    smaller, never larger than the plan's limit.
    """
    if batch_rows is not None:
        try:
            check_int(batch_rows, "batch_rows", 1, approved.plan.limits.batch_rows)
        except Refusal as error:
            return refusal(status_of(error), error, approved)
        with reading(spark, batch_rows):
            return verify(spark, approved, source_paths, dataset, parts, control)
    exact(spark)
    try:
        plan, dataset = approved.plan, Path(dataset).absolute()
        source_paths = [located(p) for p in source_paths]
        if plan.runtime != runtime():
            raise Unsupported(f"the plan was made with {plan.runtime}, this is {runtime()}")
        if not source_paths:
            raise Incomplete("there are no sources to verify against")
        actual = []
        for s, path in zip(plan.sources, source_paths, strict=True):
            if isinstance(path, Path) and not path.exists():
                raise Incomplete(f"source {s.relative_path!r} doesn't exist")
            if identity(spark, path) != (s.size_bytes, s.sha256):
                raise Conflicted(f"source={s.source_id} the file isn't the one that was planned")
            columns, pairs, rows = footer(str(path) if isinstance(path, Path) else HadoopFile(spark, path))
            actual.append(Source(s.source_id, s.relative_path, s.sha256, s.size_bytes, rows, columns, pairs))
        if tuple(actual) != plan.sources or derive(tuple(actual)) != plan.proposal:
            raise Conflicted("the sources as they are lead to another target than the approved one")
        expected = plan.proposal
        if [p.source_id for p in parts] != [s.source_id for s in plan.sources]:
            raise Conflicted("there isn't one part for each source, in their order")
        check_files(dataset, parts, plan.limits, control)
        check_bytes(dataset, parts)
        values, faults = 0, []
        for s, path, part in zip(plan.sources, source_paths, parts):
            at = dataset / part.filename
            rows = check_part_schema(at, expected, s.source_id)
            if part.target_schema_digest != expected.schema_digest or not rows == part.rows == s.num_rows:
                raise Conflicted(f"source={s.source_id} the part has other rows or another target than recorded")
            if not s.num_rows:
                continue
            source = scan(spark, str(path), s.source_id, s.fields)
            output = output_scan(spark, str(at), expected.fields)
            faults += [provenance_faults(output, s.source_id), compare(source, s.fields, output, expected.fields, s.source_id)]
            values += source.agg(F.sum(observations(source, s.fields, expected.fields))).first()[0] or 0
        if faults and (message := first_fault(reduce(DataFrame.union, faults))):
            raise Conflicted(message)
        check_bytes(dataset, parts)  # what was read is what was hashed
        counters = {"files": len(parts), "rows": sum(s.num_rows for s in plan.sources), "input_bytes": sum(s.size_bytes for s in plan.sources), "part_bytes": sum(p.bytes for p in parts), "values": values}
        now = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
        return Report("VERIFIED", plan.digest, approved.digest, source_digest(plan.sources), output_digest(parts), tuple(counters.items()), checked_at_utc=now)
    except (Exception, KeyboardInterrupt) as error:
        return refusal(status_of(error), error, approved)

