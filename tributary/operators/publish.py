"""Apply: stage, write, verify, manifest, re-read, publish; and reading a published dataset."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.errors import Conflicted, LimitExceeded, Refusal, Unsupported, status_of
from tributary.operators.align import align
from tributary.operators.verify import CONTROL, check_bytes, check_files, output_digest, refusal, source_digest, verify
from tributary.plans.documents import canonical, digest, parse
from tributary.plans.records import FORMAT, Approved, Limits, Part, Report, runtime
from tributary.plans.types import schema_size
from tributary.session import exact
from tributary.sources.parquet import checked_directory, clear, in_place, located, scan, snapshot, unchanged
from tributary.sources.parts import write_part
from tributary.sources.publication import free_name, probe_noreplace, publish_directory


def rewrite(spark: SparkSession, approved: Approved, source_paths: list[Path | str], directory: Path) -> list[Part]:
    """One part per source in an empty directory. Not verified, not published."""
    if approved.plan.runtime != runtime():
        raise Unsupported(f"the plan was made with {approved.plan.runtime}, this is {runtime()}")
    if any(directory.iterdir()):
        raise Refusal("parts are written to an empty directory")
    exact(spark)
    proposal, parts, directory = approved.plan.proposal, [], Path(directory).absolute()
    for s, path in zip(approved.plan.sources, source_paths, strict=True):
        part = write_part(align(scan(spark, str(located(path)), s.source_id, s.fields), s.fields, proposal.fields), proposal, s.source_id, directory, approved.plan.limits)
        if part.rows != s.num_rows:
            raise Refusal(f"source={s.source_id}: {part.rows} rows were written of {s.num_rows}", "ERROR")
        parts.append(part)
    if sum(p.bytes for p in parts) > approved.plan.limits.max_output_bytes:
        raise LimitExceeded(f"max_output_bytes: the limit is {approved.plan.limits.max_output_bytes}")
    return parts


def check_report(approved: Approved, parts: list[Part], report: Report) -> None:
    """The report is about these sources, this plan and these parts, and its counts are possible."""
    plan = approved.plan
    bound = (plan.digest, approved.digest, source_digest(plan.sources), output_digest(parts))
    if not report.verified or (report.plan_digest, report.approval_digest, report.source_digest, report.output_digest) != bound:
        raise Conflicted("the report is not about this dataset")
    if [(p.source_id, p.rows) for p in parts] != [(s.source_id, s.num_rows) for s in plan.sources] or any(p.target_schema_digest != plan.proposal.schema_digest for p in parts):
        raise Conflicted("the parts differ from the plan's sources")
    counts, rows = dict(report.counters), sum(p.rows for p in parts)
    known = {"files": len(parts), "rows": rows, "input_bytes": sum(s.size_bytes for s in plan.sources), "part_bytes": sum(p.bytes for p in parts)}
    if counts.keys() != known.keys() | {"values"} or any(counts[k] != v for k, v in known.items()):
        raise Conflicted("the report's counters differ")
    if not rows * len(plan.proposal.fields) <= counts["values"] <= rows * schema_size(plan.proposal.fields)[0]:
        raise Conflicted("the report's values counter is impossible")


def manifest(approved: Approved, parts: list[Part], report: Report, decision: bytes, verification: bytes) -> dict:
    """Names, hashes and sizes of everything in the dataset, its own size included.

    The size is a number in the text whose size it is, so it is found by repetition.
    """
    check_report(approved, parts, report)
    info = lambda raw: {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
    base = {
        "format_version": FORMAT, "status": "COMPLETE", "plan_digest": report.plan_digest, "approval_digest": report.approval_digest,
        "source_digest": report.source_digest, "output_digest": report.output_digest, "target_schema_digest": approved.plan.proposal.schema_digest,
        "parts": [p.to_json() for p in parts], "metadata": {"_decision.json": info(decision), "_verification.json": info(verification)}, "verification_label": "HISTORICAL",
    }
    others = sum(p.bytes for p in parts) + len(decision) + len(verification)
    own = 0
    for _ in range(16):
        sizes = {"part_bytes": sum(p.bytes for p in parts), "decision_bytes": len(decision), "verification_bytes": len(verification), "manifest_bytes": own, "bundle_bytes": others + own if own else 0}
        body = base | {"accounting": sizes}
        out = body | {"manifest_digest": digest(body)}
        if len(canonical(out)) == own:
            return out
        own = len(canonical(out))
    raise Refusal("the manifest's size doesn't settle", "ERROR")


def read_dataset(dataset: Path) -> tuple[Approved, list[Part], Report, dict]:
    """A published dataset, checked against itself. Its stored report is historical."""
    dataset = checked_directory(dataset)
    raw = {}
    for name in CONTROL:
        try:
            with open(dataset / name, "rb") as file:
                raw[name] = file.read(Limits().max_plan_bytes + 1)
        except OSError as error:
            raise Conflicted(f"{name}: {error.strerror}", "INCOMPLETE" if isinstance(error, FileNotFoundError) else None) from error
    documents = {name: parse(r) for name, r in raw.items()}
    for name, d in documents.items():
        if canonical(d) != raw[name]:
            raise Conflicted(f"{name} isn't canonical")
    approved = Approved.from_json(documents["_decision.json"])
    if approved.plan.runtime != runtime():
        raise Unsupported(f"the dataset was made with {approved.plan.runtime}, this is {runtime()}")
    report, listed = Report.from_json(documents["_verification.json"]), documents["_manifest.json"]
    if type(listed) is not dict or type(listed.get("parts")) is not list or len(listed["parts"]) != len(approved.plan.sources):
        raise Conflicted("the manifest doesn't list the parts")
    parts = [Part.from_json(p) for p in listed["parts"]]
    if listed != manifest(approved, parts, report, raw["_decision.json"], raw["_verification.json"]):
        raise Conflicted("the manifest differs from the dataset")
    check_files(dataset, parts, approved.plan.limits, control=True)
    if sum(e.stat().st_size for e in dataset.iterdir()) != listed["accounting"]["bundle_bytes"]:
        raise Conflicted("the dataset's size differs")
    check_bytes(dataset, parts)
    return approved, parts, report, listed


def apply(spark: SparkSession, approved: Approved, root: Path | str, destination: Path) -> Report:
    """Publishes a verified dataset under a free name, or leaves nothing there and says why.

    Sources under a root with a scheme are read where they are, in any store that Spark reads;
    others are copied to the staging folder first.
    """
    staging = None
    try:
        there = isinstance(located(root), str)
        protected = [] if there else [Path(root)]
        target = free_name(destination, protected)
        probe_noreplace(target.parent)
        staging = Path(tempfile.mkdtemp(prefix=f".{target.name}.INCOMPLETE-", dir=target.parent))
        inputs, dataset = staging / "sources", staging / "dataset"
        inputs.mkdir(), dataset.mkdir()
        try:
            names, limits = [s.relative_path for s in approved.plan.sources], approved.plan.limits
            copies, marks = in_place(spark, str(root), names, limits, approved.plan.sources) if there else (snapshot(Path(root), names, inputs, limits, approved.plan.sources), None)
        except Refusal as error:
            raise Conflicted(str(error)) if error.status == "ERROR" else error
        parts = rewrite(spark, approved, [c.path for c in copies], dataset)
        report = verify(spark, approved, [c.path for c in copies], dataset, parts)
        if not report.verified:
            return report
        if marks is not None:
            unchanged(spark, copies, marks)
        decision, verification = canonical(approved.to_json()), canonical(report.to_json())
        (dataset / "_decision.json").write_bytes(decision)
        (dataset / "_verification.json").write_bytes(verification)
        (dataset / "_manifest.json").write_bytes(canonical(manifest(approved, parts, report, decision, verification)))
        if sum(e.stat().st_size for e in dataset.iterdir()) > approved.plan.limits.max_output_bytes:
            raise LimitExceeded(f"max_output_bytes: the limit is {approved.plan.limits.max_output_bytes}")
        if read_dataset(dataset)[2] != report:
            raise Conflicted("the staged dataset reads differently")
        for entry in dataset.iterdir():
            with open(entry, "rb") as file:
                os.fsync(file.fileno())
        publish_directory(dataset, target, protected)
        return report
    except (Exception, KeyboardInterrupt) as error:
        return refusal(status_of(error), error, approved)
    finally:
        if staging is not None:
            for entry in (staging / "sources").glob("*"):
                os.chmod(entry, 0o600)
            clear(staging)
