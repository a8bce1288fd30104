"""Row origins: the original file, types, metadata and decisions behind an output row."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.errors import Conflicted, Refusal, status_of
from tributary.operators.publish import read_dataset
from tributary.operators.verify import check_part_schema, first_fault, output_scan, provenance_faults, refusal, verify
from tributary.plans.decisions import NOTICE, preview, walk
from tributary.plans.documents import canonical, check_int
from tributary.plans.records import Approved, Origin, Part, Report, Source
from tributary.plans.types import ROW, SOURCE
from tributary.session import exact
from tributary.sources.parquet import checked_directory, located


def verify_dataset(spark: SparkSession, dataset: Path, root: Path | str, approved: Approved | None = None) -> Report:
    """The dataset against itself, then against its sources."""
    try:
        dataset = checked_directory(dataset)
        stored, parts, _, _ = read_dataset(dataset)
        if approved is not None and approved != stored:
            raise Conflicted("the dataset was made by another approval")
        there = located(root)
        if isinstance(there, str):
            paths = [f"{there.rstrip('/')}/{s.relative_path}" for s in stored.plan.sources]
        else:
            paths = [checked_directory(root) / s.relative_path for s in stored.plan.sources]
        return verify(spark, stored, paths, dataset, parts, control=True)
    except (Exception, KeyboardInterrupt) as error:
        return refusal(status_of(error), error, approved)


def coordinate(approved: Approved, source_id: int, row: int) -> Source:
    sources = approved.plan.sources
    check_int(source_id, "source id", 0, len(sources) - 1)
    check_int(row, "row", 0, sources[source_id].num_rows - 1)
    return sources[source_id]


def check_provenance(spark: SparkSession, approved: Approved, dataset: Path, parts: list[Part]) -> None:
    """Schema and coordinates of every output row; reads the two provenance columns only."""
    faults = []
    for part in parts:
        if check_part_schema(dataset / part.filename, approved.plan.proposal, part.source_id) != part.rows:
            raise Conflicted(f"source={part.source_id} part row count differs")
        if part.rows:
            faults.append(provenance_faults(output_scan(spark, str(dataset / part.filename), approved.plan.proposal.fields).select(SOURCE, ROW, "__pc_at"), part.source_id))
    if faults and (message := first_fault(reduce(DataFrame.union, faults))):
        raise Conflicted(message)


def lookup_origin(spark: SparkSession, dataset: Path, source_id: int, row: int, root: Path | str | None = None) -> Origin:
    """The origin of a row. Without sources the output is checked alone; with them, everything is."""
    exact(spark)
    dataset = checked_directory(dataset)
    approved, parts, _, _ = read_dataset(dataset)
    source = coordinate(approved, source_id, row)
    if root is None:
        check_provenance(spark, approved, dataset, parts)
        return Origin("OUTPUT_HASHES_MATCH", source, row, approved.resolutions, "HISTORICAL")
    report = verify_dataset(spark, dataset, root, approved)
    if not report.verified:
        raise Refusal("; ".join(report.diagnostics) or report.status, report.status)
    return Origin("VERIFIED", source, row, approved.resolutions, "FRESH_SOURCE_BOUND")


def origin_row(converged: DataFrame, source_id: int, row: int) -> DataFrame:
    """The row itself: other sources' branches are pruned and the row number reaches the scan."""
    return converged.where((F.col(SOURCE) == source_id) & (F.col(ROW) == row))


def render(origin: Origin) -> str:
    out = [f"Origin integrity: {origin.integrity_level}", NOTICE, f"Source {origin.source.source_id} {origin.source.relative_path} sha256 {origin.source.sha256}, row {origin.row}"]
    fresh = origin.verification_label == "FRESH_SOURCE_BOUND"
    out.append("FRESH_SOURCE_BOUND: sources and output were checked in full." if fresh else "OUTPUT_ONLY_CHECKED: source values were not checked; the stored report is historical.")
    out += [f"Schema metadata {preview(k)} = {preview(v)}" for k, v in origin.source.schema_metadata]
    for path, f in walk(origin.source.fields):
        out.append(f"{canonical(list(path)).decode()} {f.type.label}{'' if f.nullable else ' not null'}")
        out += [f"  {preview(k)} = {preview(v)}" for k, v in f.metadata]
    out.append("Record " + canonical(origin.to_json()).decode())
    return "\n".join(out) + "\n"
