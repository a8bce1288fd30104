"""Six commands: plan, inspect, decide, apply, verify, origin."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading
from pathlib import Path

from tributary.errors import EXITS, Refusal, status_of
from tributary.plans import decisions
from tributary.plans.documents import read
from tributary.plans.records import Approved, Limits, Plan, check_identifier, diagnostic


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tributary", description="Combine Parquet sources with drifting schemas without changing a value.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: tuple) -> None:
        p = commands.add_parser(name, help=text)
        for flag, options in arguments:
            p.add_argument(flag, **options)

    path, needed = {"type": Path}, {"type": Path, "required": True}
    command("plan", "scan the sources and write a reviewable plan", ("--sources", needed), ("--input", {"action": "append", "required": True}), ("--out", needed), ("--limits", path))
    command("inspect", "show a plan, an approval or a dataset", ("plan", path))
    command("decide", "approve a plan with a decision for every conflict", ("plan", path), ("--decisions", needed), ("--out", needed), ("--sources", path))
    command("apply", "write, verify and publish a dataset", ("approved", path), ("--sources", needed), ("--out", needed))
    command("verify", "check a dataset against its sources afresh", ("approved", path), ("--sources", needed), ("--dataset", needed), ("--report", path))
    command("origin", "the original interpretation of a row", ("dataset", path), ("--source-id", {"type": int, "required": True}), ("--row", {"type": int, "required": True}), ("--sources", path))
    return out


def _spark():
    from tributary.session import session

    spark = session("tributary", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded(spark, limits: Limits, work):
    """Runs `work` under a job tag that a timer interrupts when the wall-clock limit is over."""
    tag, over = f"tributary-{os.getpid()}-{threading.get_ident()}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(min(limits.wall_seconds, threading.TIMEOUT_MAX), stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as error:
        raise Refusal(f"more than {limits.wall_seconds} seconds", "LIMIT_EXCEEDED") if over.is_set() else error
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if over.is_set() and getattr(out, "status", "") in ("ERROR", "CANCELLED"):
        raise Refusal(f"more than {limits.wall_seconds} seconds", "LIMIT_EXCEEDED")
    return out


def _approved(path: Path) -> Approved:
    return Approved.from_json(read(path), Limits())


def _plan(a) -> tuple[str, str]:
    from tributary.operators.feasibility import plan
    from tributary.sources.publication import publish_document

    names = [check_identifier(i) for i in a.input]
    if len(set(names)) < len(names):
        raise Refusal("a source is named twice")
    limits = Limits.from_json(read(a.limits)) if a.limits else Limits()
    spark = _spark()
    out = bounded(spark, limits, lambda: plan(spark, a.sources, names, limits))
    publish_document(out.to_json(), a.out, [a.sources / n for n in names] + ([a.limits] if a.limits else []), limits)
    _say(*["Diagnostic: " + d for d in out.diagnostics])
    return out.status, f"plan {out.digest} in {a.out}"


def _inspect(a) -> tuple[str, str]:
    if a.plan.is_dir():
        from tributary.operators.publish import read_dataset

        approved, _, report, _ = read_dataset(a.plan)
        _say(f"Stored report: {report.status} at {report.checked_at_utc}, HISTORICAL", "OUTPUT_HASHES_MATCH: source values were not checked", json.dumps(report.to_json(), sort_keys=True), decisions.render(approved.plan))
        return "INSPECTED", "the dataset's files match its manifest"
    document = read(a.plan)
    if type(document) is dict and "approval_digest" in document:
        approved = Approved.from_json(document, Limits())
        _say(f"Approval {approved.digest} (not a verification)", decisions.render(approved.plan), *[f"{r.conflict_digest} {r.action}" for r in approved.resolutions])
    else:
        _say(decisions.render(Plan.from_json(document, Limits())))
    return "INSPECTED", str(a.plan)


def _decide(a) -> tuple[str, str]:
    from tributary.sources.publication import publish_document

    plan = Plan.from_json(read(a.plan), Limits())
    if not plan.preflight_complete:
        return plan.status, "the plan can't be approved"
    approved = decisions.approve(plan, decisions.load_resolutions(a.decisions, plan))
    publish_document(approved.to_json(), a.out, [a.plan, a.decisions] + ([a.sources / s.relative_path for s in plan.sources] if a.sources else []), plan.limits)
    return "APPROVED", f"approval {approved.digest} in {a.out}"


def _apply(a) -> tuple[str, str]:
    from tributary.operators.publish import apply
    from tributary.sources.publication import free_name

    approved = _approved(a.approved)
    free_name(a.out, [a.approved, a.sources])
    spark = _spark()
    report = bounded(spark, approved.plan.limits, lambda: apply(spark, approved, a.sources, a.out))
    _say(*["Diagnostic: " + d for d in report.diagnostics])
    return report.status, f"dataset {a.out}" if report.verified else "nothing was published"


def _verify(a) -> tuple[str, str]:
    from tributary.operators.origin import verify_dataset
    from tributary.sources.publication import free_name, publish_document

    approved = _approved(a.approved)
    protected = [a.approved, a.sources, a.dataset]
    if a.report:
        free_name(a.report, protected)
    spark = _spark()
    report = bounded(spark, approved.plan.limits, lambda: verify_dataset(spark, a.dataset, a.sources, approved))
    if a.report:
        publish_document(report.to_json(), a.report, protected, approved.plan.limits)
    _say(*["Diagnostic: " + d for d in report.diagnostics])
    return report.status, "sources and dataset were checked in full" if report.verified else "the check failed"


def _origin(a) -> tuple[str, str]:
    from tributary.operators.origin import lookup_origin, render

    spark = _spark()
    found = bounded(spark, Limits(), lambda: lookup_origin(spark, a.dataset, a.source_id, a.row, a.sources))
    _say(render(found))
    return found.integrity_level, found.verification_label


class _Output(Exception):
    """Standard output can't be written."""


def _say(*lines: str) -> None:
    try:
        for line in lines:
            print(line.rstrip("\n"), flush=True)
    except OSError as error:
        raise _Output(error) from error


def main(argv: list[str] | None = None) -> int:
    def cancel(*_):
        raise KeyboardInterrupt

    main_thread = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGTERM, cancel) if main_thread else None
    a = parser().parse_args(argv)
    work = {"plan": _plan, "inspect": _inspect, "decide": _decide, "apply": _apply, "verify": _verify, "origin": _origin}[a.command]
    try:
        try:
            status, text = work(a)
        except _Output:
            raise
        except (Exception, KeyboardInterrupt) as error:
            status, text = status_of(error), diagnostic(error)
        _say(f"{status}: {text}")
        return EXITS.get(status, 4)
    except _Output as error:
        # an artifact may be published already; say so where it can still be read, and let shutdown flush nowhere
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        status = status_of(error.__cause__)
        print(f"{status}: output failed: {error}; check whether the result exists before trying again", file=sys.stderr)
        return EXITS.get(status, 4)
    finally:
        if main_thread:
            signal.signal(signal.SIGTERM, before)


if __name__ == "__main__":
    raise SystemExit(main())
