"""The documents of the lifecycle: sources, proposals, plans, approvals, parts, reports, origins.

Every record checks itself when made, has one JSON form, and binds what it was made from by
SHA-256 over canonical JSON.
"""

from __future__ import annotations

import platform
import re
import sys
from dataclasses import dataclass, field, fields
from datetime import datetime
from pathlib import PurePosixPath
from typing import Any

import pyarrow
import pyspark

from tributary.errors import LimitExceeded, Refusal
from tributary.plans.documents import canonical, check_digest, check_int, check_keys, check_list, check_text, digest, from_base64, to_base64
from tributary.plans.types import RESERVED, Field, Pairs, Type, distinct_names, pairs_from_json, pairs_to_json, schema_size, sorted_pairs

VERSION = "0.1.0"
FORMAT = 1
REVIEWABLE = ("READY_FOR_REVIEW", "NEEDS_DECISIONS")
PLAN_STATUSES = (*REVIEWABLE, "UNSUPPORTED", "LIMIT_EXCEEDED", "DATA_INCOMPATIBLE", "INCOMPLETE", "ERROR", "CANCELLED")
REPORT_STATUSES = ("VERIFIED", "CONFLICT", "UNSUPPORTED", "LIMIT_EXCEEDED", "INCOMPLETE", "ERROR", "CANCELLED")
MAX_CONFLICTS = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Caps of a local run: the defaults are also the largest values that a document may name.

    `Limits.cluster()` lifts those that count files, rows and bytes, for runs over a cluster.
    """

    max_files: int = 128
    max_input_bytes: int = 512 << 20
    max_rows: int = 1_000_000
    max_fields: int = 512
    max_depth: int = 8
    max_metadata_bytes: int = 1 << 20
    max_plan_bytes: int = 8 << 20
    batch_rows: int = 8192
    max_output_bytes: int = 1 << 30
    max_staging_bytes: int = 2 << 30
    wall_seconds: int = 300
    cpu_seconds: int = 120
    address_space_bytes: int = 4 << 30

    lifted = ("max_files", "max_input_bytes", "max_rows", "max_output_bytes", "max_staging_bytes", "wall_seconds", "cpu_seconds", "address_space_bytes")

    def __post_init__(self):
        for f in fields(self):
            most = 1 << 62 if f.name in self.lifted and self.max_files > 128 else f.default
            if check_int(getattr(self, f.name), f.name, 1) > most:
                raise LimitExceeded(f"{f.name} is above {most}")

    @classmethod
    def cluster(cls) -> Limits:
        return cls(**{name: 1 << 62 for name in cls.lifted})

    def to_json(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def from_json(cls, value: Any) -> Limits:
        return cls(**check_keys(value, [f.name for f in fields(cls)], "limits"))

    def lower(self, other: Limits) -> Limits:
        return Limits(**{f.name: min(getattr(self, f.name), getattr(other, f.name)) for f in fields(self)})


def runtime() -> dict:
    """What a plan was made with; approval and apply refuse another."""
    return {"python": platform.python_version(), "pyarrow": pyarrow.__version__, "pyspark": pyspark.__version__, "platform": sys.platform, "package_version": VERSION}


def check_path(path: tuple[str, ...]) -> tuple[str, ...]:
    if len(path) > 9:
        raise LimitExceeded("a path has more than 9 segments")
    for segment in path:
        if check_text(segment, "path segment").startswith(RESERVED):
            raise Refusal(f"the name {segment!r} is reserved")
    return path


def check_identifier(text: Any) -> str:
    """A normalised relative POSIX path."""
    check_text(text, "source path")
    if not text or "\\" in text or text.startswith("/") or any(p in ("", ".", "..") for p in text.split("/")) or str(PurePosixPath(text)) != text:
        raise Refusal(f"not a normalised relative path: {text!r}")
    return text


def check_schema(columns: tuple[Field, ...], pairs: Pairs, limits: Limits, what: str) -> None:
    count, depth, size = schema_size(columns, pairs)
    for have, most, name in ((count, limits.max_fields, "fields"), (depth, limits.max_depth, "struct levels"), (size, limits.max_metadata_bytes, "metadata bytes")):
        if have > most:
            raise LimitExceeded(f"{what}: {have} {name}, the limit is {most}")


@dataclass(frozen=True)
class Source:
    source_id: int
    relative_path: str
    sha256: str
    size_bytes: int
    num_rows: int
    fields: tuple[Field, ...]
    schema_metadata: Pairs = ()

    def __post_init__(self):
        check_int(self.source_id, "source_id")
        check_identifier(self.relative_path)
        check_digest(self.sha256, "sha256")
        check_int(self.size_bytes, "size_bytes")
        check_int(self.num_rows, "num_rows")
        distinct_names(self.fields)
        object.__setattr__(self, "schema_metadata", sorted_pairs(self.schema_metadata))
        check_schema(self.fields, self.schema_metadata, Limits(), f"source {self.source_id}")

    def to_json(self) -> dict:
        plain = {n: getattr(self, n) for n in ("source_id", "relative_path", "sha256", "size_bytes", "num_rows")}
        return plain | {"fields": [f.to_json() for f in self.fields], "schema_metadata": pairs_to_json(self.schema_metadata)}

    @staticmethod
    def from_json(value: Any) -> Source:
        d = dict(check_keys(value, [f.name for f in fields(Source)], "a source"))
        return Source(**d | {"fields": tuple(Field.from_json(f) for f in check_list(d["fields"], "fields")), "schema_metadata": pairs_from_json(d["schema_metadata"])})


def check_inventory(sources: tuple[Source, ...], limits: Limits = None) -> None:
    """Ids are 0, 1, ... in the given order; paths are distinct; sums stay within the limits."""
    limits = limits or Limits.cluster()
    if not sources:
        raise Refusal("there are no sources")
    if [s.source_id for s in sources] != list(range(len(sources))):
        raise Refusal("source ids must count the sources in order")
    if len({s.relative_path for s in sources}) < len(sources):
        raise Refusal("a source is named twice")
    sizes = [schema_size(s.fields, s.schema_metadata) for s in sources]
    sums = {
        "max_files": len(sources), "max_input_bytes": sum(s.size_bytes for s in sources), "max_rows": sum(s.num_rows for s in sources),
        "max_fields": sum(x[0] for x in sizes), "max_depth": max(x[1] for x in sizes), "max_metadata_bytes": sum(x[2] for x in sizes),
    }
    for name, have in sums.items():
        if have > getattr(limits, name):
            raise LimitExceeded(f"{name}: {have}, the limit is {getattr(limits, name)}")


@dataclass(frozen=True)
class Operation:
    """How a source reaches the target at a path."""

    source_id: int
    path: tuple[str, ...]
    source_type: Type | None
    target_type: Type
    kind: str

    def __post_init__(self):
        check_path(self.path)
        have = None if self.source_type is None else self.source_type.kind
        fits = {
            "identity": self.source_type == self.target_type,
            "null_insert": have in (None, "null"),
            "struct_union": have == self.target_type.kind == "struct",
            "widen": have not in (None, "null", "struct") and self.target_type.kind not in ("null", "struct") and self.source_type != self.target_type,
        }
        if not self.path or not fits.get(self.kind):
            raise Refusal(f"no operation {self.kind!r} from {have} to {self.target_type.kind} at {list(self.path)}")

    def to_json(self) -> dict:
        return {"source_id": self.source_id, "path": list(self.path), "source_type": self.source_type and self.source_type.to_json(), "target_type": self.target_type.to_json(), "kind": self.kind}

    @staticmethod
    def from_json(value: Any) -> Operation:
        d = check_keys(value, [f.name for f in fields(Operation)], "an operation")
        have = None if d["source_type"] is None else Type.from_json(d["source_type"])
        return Operation(check_int(d["source_id"], "source_id"), tuple(check_list(d["path"], "path")), have, Type.from_json(d["target_type"]), d["kind"])


@dataclass(frozen=True)
class Conflict:
    """A metadata key at a path with each holder's value, None where the key is absent."""

    path: tuple[str, ...]
    key: bytes
    values: tuple[tuple[int, bytes | None], ...]

    def __post_init__(self):
        check_path(self.path)
        object.__setattr__(self, "values", tuple(sorted(self.values, key=lambda v: v[0])))
        if len({s for s, _ in self.values}) < len(self.values) or len({v for _, v in self.values}) < 2:
            raise Refusal(f"no conflict at {list(self.path)}")

    def body(self) -> dict:
        return {"path": list(self.path), "key": to_base64(self.key), "values": [[s, None if v is None else to_base64(v)] for s, v in self.values]}

    @property
    def digest(self) -> str:
        return digest(self.body())

    def to_json(self) -> dict:
        return self.body() | {"conflict_digest": self.digest}

    @staticmethod
    def from_json(value: Any) -> Conflict:
        d = check_keys(value, ("path", "key", "values", "conflict_digest"), "a conflict")
        values = []
        for pair in check_list(d["values"], "values"):
            if type(pair) is not list or len(pair) != 2:
                raise Refusal("conflict values must be pairs")
            values.append((check_int(pair[0], "source_id"), None if pair[1] is None else from_base64(pair[1])))
        out = Conflict(tuple(check_list(d["path"], "path")), from_base64(d["key"]), tuple(values))
        if check_digest(d["conflict_digest"], "conflict_digest") != out.digest:
            raise Refusal("a conflict's digest doesn't match it")
        return out


def _ordered(items, key, what: str) -> None:
    keys = [key(i) for i in items]
    if any(a >= b for a, b in zip(keys, keys[1:])):
        raise Refusal(f"{what} must be distinct and in order")


def _check_canonical(columns: tuple[Field, ...]) -> None:
    _ordered(columns, lambda f: f.name, "target fields")
    for f in columns:
        if f.type.kind == "struct":
            _check_canonical(f.type.fields)


@dataclass(frozen=True)
class Proposal:
    fields: tuple[Field, ...]
    schema_metadata: Pairs = ()
    operations: tuple[Operation, ...] = ()
    conflicts: tuple[Conflict, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "schema_metadata", sorted_pairs(self.schema_metadata))
        check_schema(self.fields, self.schema_metadata, Limits(), "target")
        _check_canonical(self.fields)
        _ordered(self.operations, lambda o: (o.source_id, o.path), "operations")
        _ordered(self.conflicts, lambda c: (c.path, c.key), "conflicts")
        if len(self.conflicts) > MAX_CONFLICTS:
            raise LimitExceeded("too many conflicts")

    def to_json(self) -> dict:
        return {"fields": [f.to_json() for f in self.fields], "schema_metadata": pairs_to_json(self.schema_metadata), "operations": [o.to_json() for o in self.operations], "conflicts": [c.to_json() for c in self.conflicts]}

    @staticmethod
    def from_json(value: Any) -> Proposal:
        d = check_keys(value, [f.name for f in fields(Proposal)], "a proposal")
        lists = {n: check_list(d[n], n) for n in ("fields", "operations", "conflicts")}
        return Proposal(tuple(map(Field.from_json, lists["fields"])), pairs_from_json(d["schema_metadata"]), tuple(map(Operation.from_json, lists["operations"])), tuple(map(Conflict.from_json, lists["conflicts"])))

    @property
    def schema_digest(self) -> str:
        return digest({"fields": [f.to_json() for f in self.fields], "schema_metadata": pairs_to_json(self.schema_metadata)})


def check_diagnostics(value) -> tuple[str, ...]:
    value = tuple(value)
    if len(value) > 32 or any(len(check_text(v, "diagnostic").encode()) > 4096 for v in value):
        raise LimitExceeded("diagnostics are at most 32 texts of 4096 bytes")
    return value


def diagnostic(error: Any) -> str:
    """One line of at most 4096 bytes."""
    text = " ".join(str(error).replace("\0", " ").encode(errors="replace").decode().split())
    return text.encode()[:4000].decode(errors="ignore") or type(error).__name__


@dataclass(frozen=True)
class Plan:
    status: str
    sources: tuple[Source, ...] = ()
    proposal: Proposal | None = None
    preflight_complete: bool = False
    limits: Limits = field(default_factory=Limits)
    runtime: dict = field(default_factory=runtime)
    diagnostics: tuple[str, ...] = ()
    counters: tuple[int, int, int] = (0, 0, 0)  # files, rows, input bytes

    def __post_init__(self):
        check_diagnostics(self.diagnostics)
        if self.status not in PLAN_STATUSES:
            raise Refusal(f"no plan status {self.status!r}")
        if self.sources:
            check_inventory(self.sources, self.limits)
        if self.proposal:
            check_schema(self.proposal.fields, self.proposal.schema_metadata, self.limits, "target")
        if (self.status in REVIEWABLE) != self.preflight_complete:
            raise Refusal("only a complete feasibility scan gives a reviewable plan")
        if self.preflight_complete:
            done = (len(self.sources), sum(s.num_rows for s in self.sources), sum(s.size_bytes for s in self.sources))
            if self.proposal is None or self.counters != done:
                raise Refusal("the plan's counters don't match its sources")
            if (self.status == "NEEDS_DECISIONS") != bool(self.proposal.conflicts):
                raise Refusal("the plan's status doesn't match its conflicts")
        if len(canonical(self.to_json())) > self.limits.max_plan_bytes:
            raise LimitExceeded("the plan's document is too large")

    def body(self) -> dict:
        return {
            "format_version": FORMAT, "status": self.status, "preflight_complete": self.preflight_complete,
            "sources": [s.to_json() for s in self.sources], "proposal": self.proposal and self.proposal.to_json(),
            "limits": self.limits.to_json(), "runtime": dict(self.runtime), "diagnostics": list(self.diagnostics),
            "preflight_counters": dict(zip(("files", "rows", "input_bytes"), self.counters)),
        }

    @property
    def digest(self) -> str:
        return digest(self.body())

    def to_json(self) -> dict:
        return self.body() | {"plan_digest": self.digest}

    @staticmethod
    def from_json(value: Any, limits: Limits | None = None) -> Plan:
        names = ("format_version", "status", "preflight_complete", "sources", "proposal", "limits", "runtime", "diagnostics", "preflight_counters", "plan_digest")
        d = check_keys(value, names, "a plan")
        check_int(d["format_version"], "format_version", FORMAT, FORMAT)
        own = Limits.from_json(d["limits"])
        raw_caps(d, own if limits is None else own.lower(limits))
        counts = check_keys(d["preflight_counters"], ("files", "rows", "input_bytes"), "counters")
        out = Plan(
            d["status"], tuple(map(Source.from_json, check_list(d["sources"], "sources"))), None if d["proposal"] is None else Proposal.from_json(d["proposal"]),
            d["preflight_complete"], own, dict(check_keys(d["runtime"], runtime(), "runtime")), tuple(check_list(d["diagnostics"], "diagnostics")),
            tuple(check_int(counts[n], n) for n in ("files", "rows", "input_bytes")),
        )
        if check_digest(d["plan_digest"], "plan_digest") != out.digest:
            raise Refusal("the plan's digest doesn't match it")
        return out


def _at_most(name: str, have: Any, most: int) -> int:
    if type(have) is int and have > most:
        raise LimitExceeded(f"{name}: {have}, the limit is {most}")
    return have if type(have) is int else 0


class _Tally:
    """Fields and metadata bytes of raw JSON schemas, counted without recursion and stopped at a cap."""

    def __init__(self, limits: Limits):
        self.limits, self.fields, self.metadata = limits, 0, 0

    def pairs(self, value: Any) -> None:
        for pair in check_list(value, "metadata"):
            # base64 has four characters for three bytes, less one for each sign at its end
            self.metadata += sum(3 * len(x) // 4 - x[-2:].count("=") for x in (pair if type(pair) is list else ()) if type(x) is str)
            _at_most("max_metadata_bytes", self.metadata, self.limits.max_metadata_bytes)

    def schema(self, columns: Any, level: int = 0) -> None:
        levels = [(level, check_list(columns, "fields"))]
        while levels:
            level, members = levels.pop()
            self.fields += len(members)
            _at_most("max_fields", self.fields, self.limits.max_fields)
            for f in members:
                if type(f) is dict:
                    self.pairs(f.get("metadata", []))
                    self.type(f.get("type"), level, levels)

    def type(self, value: Any, level: int, levels: list) -> None:
        if type(value) is dict and value.get("kind") == "struct":
            _at_most("max_depth", level + 1, self.limits.max_depth)
            levels.append((level + 1, check_list(value.get("fields"), "fields")))


def raw_caps(plan: dict, limits: Limits) -> None:
    """Everything that a plan's raw JSON can make large, against the limits, before any record is made."""
    counters = plan["preflight_counters"] if type(plan["preflight_counters"]) is dict else {}
    sources = [s for s in check_list(plan["sources"], "sources") if type(s) is dict]
    for name, own, each in (("max_files", "files", None), ("max_rows", "rows", "num_rows"), ("max_input_bytes", "input_bytes", "size_bytes")):
        _at_most(name, counters.get(own), getattr(limits, name))
        sizes = [1 if each is None else s.get(each) for s in sources]
        _at_most(name, sum(x for x in sizes if type(x) is int), getattr(limits, name))
    every = _Tally(limits)
    for s in sources:
        every.schema(s.get("fields"))
        every.pairs(s.get("schema_metadata"))
    target = plan["proposal"]
    if type(target) is not dict:
        return
    own = _Tally(limits)
    own.schema(target.get("fields"))
    own.pairs(target.get("schema_metadata"))
    steps, conflicts = (check_list(target.get(n), n) for n in ("operations", "conflicts"))
    _at_most("operations", len(steps), limits.max_files * limits.max_fields)
    _at_most("conflicts", len(conflicts), MAX_CONFLICTS)
    for item in (x for x in (*steps, *conflicts) if type(x) is dict):
        _at_most("path segments", len(check_list(item.get("path"), "path")), limits.max_depth + 1)
        _at_most("values of a conflict", len(check_list(item.get("values", []), "values")), limits.max_files)
        for name in ("source_type", "target_type"):
            below: list = []
            alone = _Tally(limits)
            alone.type(item.get(name), 0, below)
            for level, members in below:
                alone.schema(members, level)


@dataclass(frozen=True)
class Resolution:
    conflict_digest: str
    action: str

    def __post_init__(self):
        check_digest(self.conflict_digest, "conflict_digest")
        if self.action not in ("archive_only", "abort"):
            raise Refusal(f"no action {self.action!r}: it is archive_only or abort")

    def to_json(self) -> dict:
        return {"conflict_digest": self.conflict_digest, "action": self.action}

    @staticmethod
    def from_json(value: Any) -> Resolution:
        return Resolution(**check_keys(value, ("conflict_digest", "action"), "a resolution"))


@dataclass(frozen=True)
class Approved:
    plan: Plan
    resolutions: tuple[Resolution, ...]

    def __post_init__(self):
        if not self.plan.preflight_complete:
            raise Refusal("only a reviewable plan can be approved")
        _ordered(self.resolutions, lambda r: r.conflict_digest, "resolutions")
        if {r.conflict_digest for r in self.resolutions} != {c.digest for c in self.plan.proposal.conflicts} or any(r.action == "abort" for r in self.resolutions):
            raise Refusal("an approval resolves every conflict by archive_only")

    def body(self) -> dict:
        return {"plan": self.plan.to_json(), "resolutions": [r.to_json() for r in self.resolutions], "status": "APPROVED", "format_version": FORMAT}

    @property
    def digest(self) -> str:
        return digest(self.body())

    def to_json(self) -> dict:
        return self.body() | {"approval_digest": self.digest}

    @staticmethod
    def from_json(value: Any, limits: Limits | None = None) -> Approved:
        d = check_keys(value, ("plan", "resolutions", "status", "format_version", "approval_digest"), "an approval")
        check_int(d["format_version"], "format_version", FORMAT, FORMAT)
        if d["status"] != "APPROVED":
            raise Refusal("an approval's status is APPROVED")
        out = Approved(Plan.from_json(d["plan"], limits), tuple(map(Resolution.from_json, check_list(d["resolutions"], "resolutions"))))
        if check_digest(d["approval_digest"], "approval_digest") != out.digest:
            raise Refusal("the approval's digest doesn't match it")
        return out


def part_name(source_id: int) -> str:
    return f"part-{source_id:05d}.parquet"


@dataclass(frozen=True)
class Part:
    filename: str
    source_id: int
    rows: int
    bytes: int
    sha256: str
    target_schema_digest: str

    def __post_init__(self):
        for n in ("source_id", "rows", "bytes"):
            check_int(getattr(self, n), n)
        for n in ("sha256", "target_schema_digest"):
            check_digest(getattr(self, n), n)
        if self.filename != part_name(self.source_id):
            raise Refusal("a part is named by its source")

    def to_json(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @staticmethod
    def from_json(value: Any) -> Part:
        return Part(**check_keys(value, [f.name for f in fields(Part)], "a part"))


def check_utc(text: Any) -> str:
    if type(text) is not str or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z", text):
        raise Refusal("a check time is UTC in ISO form")
    try:
        datetime.fromisoformat(text[:-1])
    except ValueError:
        raise Refusal(f"no such time: {text}") from None
    return text


@dataclass(frozen=True)
class Report:
    """What a verification found. VERIFIED has counters and no diagnostics; others have diagnostics."""

    status: str
    plan_digest: str = ""
    approval_digest: str = ""
    source_digest: str = ""
    output_digest: str = ""
    counters: tuple[tuple[str, int], ...] = ()
    diagnostics: tuple[str, ...] = ()
    checked_at_utc: str = ""

    def __post_init__(self):
        if self.status not in REPORT_STATUSES:
            raise Refusal(f"no report status {self.status!r}")
        object.__setattr__(self, "counters", tuple(sorted(self.counters)))
        for name, n in self.counters:
            check_int(n, name, 0, (1 << 63) - 1)
        check_diagnostics(self.diagnostics)
        for n in ("plan_digest", "approval_digest", "source_digest", "output_digest"):
            if self.verified or getattr(self, n):
                check_digest(getattr(self, n), n)
        if self.verified or self.checked_at_utc:
            check_utc(self.checked_at_utc)
        if self.verified and (not self.counters or self.diagnostics):
            raise Refusal("a verified report has counters and no diagnostics")

    @property
    def verified(self) -> bool:
        return self.status == "VERIFIED"

    def to_json(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"counters": [list(c) for c in self.counters], "diagnostics": list(self.diagnostics), "format_version": FORMAT}

    @staticmethod
    def from_json(value: Any) -> Report:
        d = dict(check_keys(value, [f.name for f in fields(Report)] + ["format_version"], "a report"))
        check_int(d.pop("format_version"), "format_version", FORMAT, FORMAT)
        counters = []
        for pair in check_list(d["counters"], "counters"):
            if type(pair) is not list or len(pair) != 2:
                raise Refusal("counters must be pairs")
            counters.append((check_text(pair[0], "counter"), pair[1]))
        return Report(**d | {"counters": tuple(counters), "diagnostics": tuple(check_list(d["diagnostics"], "diagnostics"))})


@dataclass(frozen=True)
class Origin:
    """The original interpretation of one output row."""

    integrity_level: str
    source: Source
    row: int
    decisions: tuple[Resolution, ...]
    verification_label: str

    def __post_init__(self):
        if (self.integrity_level, self.verification_label) not in (("OUTPUT_HASHES_MATCH", "HISTORICAL"), ("VERIFIED", "FRESH_SOURCE_BOUND")):
            raise Refusal("only a fresh check against the sources is VERIFIED")
        check_int(self.row, "row", 0, self.source.num_rows - 1)

    def to_json(self) -> dict:
        source = self.source.to_json()
        return {
            "integrity_level": self.integrity_level, "source": source, "row": self.row, "original_fields": source["fields"], "original_schema_metadata": source["schema_metadata"],
            "decisions": [r.to_json() for r in self.decisions], "verification_label": self.verification_label, "format_version": FORMAT,
        }


