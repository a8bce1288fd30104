"""The lifecycle as queries: plans, decisions, rewriting, publication, verification and origins.

Each runs the engine's own commands over sources made from the tables and gives what a caller sees
of them as rows. Data comes back through Spark; what the driver collects is a row per file or per case.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.errors import EXITS, Refusal, status_of
from tributary.operators.align import converge
from tributary.operators.feasibility import plan
from tributary.operators.origin import lookup_origin, origin_row, verify_dataset
from tributary.operators.publish import apply, read_dataset, rewrite
from tributary.operators.verify import compare, verify
from tributary.plans.decisions import approve, check_dropped, load_resolutions, template
from tributary.plans.documents import canonical, digest, from_base64, parse, to_base64
from tributary.plans.lattice import propose
from tributary.plans.records import Approved, Limits, Part, Plan, Proposal, Resolution, Source
from tributary.plans.types import ROW, SOURCE, Field, Type, decimal, float_, int_, struct, timestamp, uint
from tributary.queries import QUERIES, SQL, _halves, _space, query
from tributary.sources.parquet import Copy, hashes, open_inside, scan, sha256_file, snapshot
from tributary.sources.parts import write_split
from tributary.sources.publication import free_name, publish_directory, publish_document
from tributary.streaming import aligned_stream

__all__ = ["QUERIES", "SQL"]


def outcome(work: Callable[[], object]) -> str:
    """The status that work ends with: its own, its refusal's, or OK."""
    try:
        result = work()
    except (Refusal, OSError) as error:
        return status_of(error)
    return getattr(result, "status", "OK")


def told(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _orders(spark: SparkSession, sf_dir: str, n: int = 2) -> tuple[Path, list[str]]:
    """A folder `sources` with orders by key % n: odd sources have a priority, even ones the total as float32."""

    def make(i, t):
        out = {"o_orderkey": t["o_orderkey"], "o_custkey": t["o_custkey"].cast(pa.int32()) if i % 2 == 0 else t["o_custkey"]}
        return pa.table(out | ({"o_orderpriority": t["o_orderpriority"]} if i % 2 else {}))

    root = _space(spark) / "sources"
    root.mkdir()
    sources, _ = _halves(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"], "o_orderkey", n, make, root)
    return root, [s.relative_path for s in sources]


def _published(spark: SparkSession, sf_dir: str) -> tuple[Path, Path, Approved]:
    root, names = _orders(spark, sf_dir)
    approved = approve(plan(spark, root, names, Limits.cluster()), [])
    target = root.parent / "result"
    report = apply(spark, approved, root, target)
    if not report.verified:
        raise Refusal("; ".join(report.diagnostics) or report.status, report.status)
    return root, target, approved


def _stored(spark: SparkSession, dataset: Path) -> DataFrame:
    """The parts of a published dataset as one table."""
    _, parts, _, _ = read_dataset(dataset)
    df = spark.read.parquet(*[str(dataset / p.filename) for p in parts])
    return df.withColumn(SOURCE, F.col(SOURCE).cast("int")).withColumn(ROW, F.col(ROW).cast("long"))


@query(
    "SELECT CAST(o_orderkey % 2 AS INT) AS __pc_source, CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS __pc_row, o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders"
)
def published_dataset(spark, sf_dir):
    """Plan, approve, apply: the parts as another reader sees them."""
    _, target, _ = _published(spark, sf_dir)
    return _stored(spark, target).select(SOURCE, ROW, "o_orderkey", "o_custkey", "o_orderpriority")


@query(
    "SELECT 'VERIFIED' AS status, 'files' AS counter, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'VERIFIED', 'rows', COUNT(*) FROM orders UNION ALL SELECT 'VERIFIED', 'values', 3 * COUNT(*) FROM orders"
)
def dataset_report(spark, sf_dir):
    """A published dataset verified again with its sources."""
    root, target, approved = _published(spark, sf_dir)
    report = verify_dataset(spark, target, root, approved)
    return told(spark, [(report.status, k, v) for k, v in report.counters if k in ("files", "rows", "values")], "status string, counter string, n long")


@query(
    "SELECT source AS __pc_source, r AS __pc_row, level, label, path, n_rows, o_custkey FROM (VALUES (0, CAST(0 AS BIGINT)), (0, 7), (1, 3)) AS c(source, r)"
    " CROSS JOIN (VALUES ('OUTPUT_HASHES_MATCH', 'HISTORICAL'), ('VERIFIED', 'FRESH_SOURCE_BOUND')) AS k(level, label)"
    " JOIN (SELECT CAST(o_orderkey % 2 AS INT) AS source, 'orders-' || CAST(o_orderkey % 2 AS VARCHAR) || '.parquet' AS path, COUNT(*) AS n_rows FROM orders GROUP BY 1, 2) USING (source)"
    " JOIN orders ON o_orderkey = 2 * r + source"
)
def origin_lookup(spark, sf_dir):
    """Origins of output rows without and with sources, and the rows that they are about."""
    root, target, _ = _published(spark, sf_dir)
    stored = _stored(spark, target)
    frames = []
    for source, row in ((0, 0), (0, 7), (1, 3)):
        for sources in (None, root):
            found = lookup_origin(spark, target, source, row, sources)
            frames.append((source, row, found.integrity_level, found.verification_label, found.source.relative_path, found.source.num_rows))
    facts = told(spark, frames, f"{SOURCE} int, {ROW} long, level string, label string, path string, n_rows long")
    rows = origin_row(stored, 0, 0).union(origin_row(stored, 0, 7)).union(origin_row(stored, 1, 3))
    return facts.join(rows, [SOURCE, ROW]).select(*facts.columns, "o_custkey")


@query("SELECT * FROM (VALUES ('no such source', 'INVALID_INPUT'), ('row after the last', 'INVALID_INPUT'), ('negative row', 'INVALID_INPUT'), ('boolean row', 'INVALID_INPUT'), ('no dataset', 'INCOMPLETE')) AS t(\"case\", status)")
def origin_refusals(spark, sf_dir):
    root, target, approved = _published(spark, sf_dir)
    n = approved.plan.sources[0].num_rows
    cases = {"no such source": (target, 2, 0), "row after the last": (target, 0, n), "negative row": (target, 0, -1), "boolean row": (target, 0, True), "no dataset": (target.parent / "nowhere", 0, 0)}
    return told(spark, [(name, outcome(lambda a=a: lookup_origin(spark, *a))) for name, a in cases.items()], "case string, status string")


def _small(root: Path) -> list[str]:
    """Two sources of four rows with a struct, an absent child, a null-typed column and conflicting metadata."""
    inner = lambda *fields: pa.struct(list(fields))
    a = pa.schema([pa.field("k", pa.int16(), False), pa.field("s", inner(pa.field("x", pa.int8(), metadata={"unit": "m"}))), pa.field("n", pa.null())], {"maker": "a"})
    b = pa.schema([pa.field("k", pa.int32(), False), pa.field("s", inner(pa.field("x", pa.int16(), metadata={"unit": "cm"}), pa.field("y", pa.string()))), pa.field("n", pa.float64())], {"maker": "b"})
    root.mkdir(parents=True)
    pq.write_table(pa.Table.from_pylist([{"k": 1, "s": {"x": 2}}, {"k": 3, "s": None}, {"k": 4, "s": {"x": None}}], a), root / "a.parquet", version="2.6")
    pq.write_table(pa.Table.from_pylist([{"k": 70000, "s": {"x": 8, "y": "z"}, "n": 0.5}], b), root / "b.parquet", version="2.6")
    return ["a.parquet", "b.parquet"]


def _archived(p: Plan) -> Approved:
    return approve(p, [Resolution(c.digest, "archive_only") for c in p.proposal.conflicts])


def _rewritten(spark: SparkSession) -> tuple[Path, list[Path], Approved, Path, list[Part]]:
    root = _space(spark)
    approved = _archived(plan(spark, root / "sources", _small(root / "sources")))
    paths, out = [root / "sources" / s.relative_path for s in approved.plan.sources], root / "parts"
    out.mkdir()
    return root, paths, approved, out, rewrite(spark, approved, paths, out)


def _changed(out: Path, part: Part, change: Callable[[pa.Table], pa.Table]) -> Part:
    """The part with its file changed and its record brought up to date."""
    path = out / part.filename
    pq.write_table(change(pq.read_table(path)), path, version="2.6", compression="NONE", use_dictionary=False)
    return Part(part.filename, part.source_id, part.rows, *sha256_file(path), part.target_schema_digest)


def _edited(row: int, **values) -> Callable[[pa.Table], pa.Table]:
    def change(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        rows[row].update(values)
        return pa.Table.from_pylist(rows, t.schema)

    return change


@query(
    "SELECT * FROM (VALUES ('none','VERIFIED',''), ('value','CONFLICT','source=0 row=0 path=[\"k\"]: logical value differs'), ('child','CONFLICT','source=0 row=0 path=[\"s\",\"y\"]: expected null observation'),"
    " ('null parent','CONFLICT','source=0 row=1 path=[\"s\"]: expected null observation'), ('lost struct','CONFLICT','source=0 row=2 path=[\"s\"]: unexpected null observation'),"
    " ('null-typed column','CONFLICT','source=0 row=1 path=[\"n\"]: expected null observation'), ('source number','CONFLICT','source=0 row=1 path=[\"__pc_source\"]: provenance value differs'),"
    " ('row number','CONFLICT','source=0 row=2 path=[\"__pc_row\"]: provenance value differs'), ('second source','CONFLICT','source=1 row=0 path=[\"n\"]: logical value differs')) AS t(mutation, status, fault)"
)
def verify_mutations(spark, sf_dir):
    """Parts with one observation changed, verified in full: the first fault by source, row and path."""
    root, paths, approved, out, parts = _rewritten(spark)
    cases = {
        "none": (0, None), "value": (0, _edited(0, k=2)), "child": (0, _edited(0, s={"x": 2, "y": "q"})), "null parent": (0, _edited(1, s={"x": None, "y": None})), "lost struct": (0, _edited(2, s=None)),
        "null-typed column": (0, _edited(1, n=1.0)), "source number": (0, _edited(1, __pc_source=1)), "row number": (0, _edited(2, __pc_row=9)), "second source": (1, _edited(0, n=-0.5)),
    }
    found = []
    for name, (which, change) in cases.items():
        at = root / f"changed-{len(found)}"
        shutil.copytree(out, at)
        now = list(parts)
        if change:
            now[which] = _changed(at, parts[which], change)
        report = verify(spark, approved, paths, at, now)
        found.append((name, report.status, "; ".join(report.diagnostics)))
    return told(spark, found, "mutation string, status string, fault string")


@query(
    "SELECT * FROM (VALUES ('field order','CONFLICT'), ('type','CONFLICT'), ('nullability','CONFLICT'), ('schema metadata','CONFLICT'), ('field metadata','CONFLICT'), ('provenance type','CONFLICT'), ('fewer rows','CONFLICT'),"
    " ('another file','CONFLICT'), ('missing part','CONFLICT'), ('other bytes','CONFLICT'), ('no sources','INCOMPLETE'), ('changed source','CONFLICT'), ('parts in another order','CONFLICT')) AS t(mutation, status)"
)
def schema_and_inventory_mutations(spark, sf_dir):
    root, paths, approved, out, parts = _rewritten(spark)
    schema = pq.read_schema(out / parts[0].filename)
    at_k = schema.get_field_index("k")
    tables = {
        "field order": lambda t: t.select([1, 0, *range(2, t.num_columns)]),
        "type": lambda t: t.set_column(at_k, pa.field("k", pa.int64(), False), t["k"].cast(pa.int64())),
        "nullability": lambda t: t.set_column(at_k, pa.field("k", pa.int32(), True), t["k"]),
        "schema metadata": lambda t: t.replace_schema_metadata({"maker": "a"}),
        "field metadata": lambda t: t.set_column(at_k, pa.field("k", pa.int32(), False, {"a": "b"}), t["k"]),
        "provenance type": lambda t: t.set_column(t.num_columns - 1, pa.field(ROW, pa.int64(), False), t[ROW].cast(pa.int64())),
        "fewer rows": lambda t: t.slice(0, 2),
    }
    found = []

    def folder() -> Path:
        at = root / f"mutated-{len(found)}"
        shutil.copytree(out, at)
        return at

    for name, change in tables.items():
        at = folder()
        found.append((name, verify(spark, approved, paths, at, [_changed(at, parts[0], change), parts[1]]).status))
    at = folder()
    (at / "more").touch()
    found.append(("another file", verify(spark, approved, paths, at, parts).status))
    at = folder()
    (at / parts[1].filename).unlink()
    found.append(("missing part", verify(spark, approved, paths, at, parts).status))
    at = folder()
    with open(at / parts[0].filename, "ab") as file:
        file.write(b"x")
    found.append(("other bytes", verify(spark, approved, paths, at, parts).status))
    found.append(("no sources", verify(spark, approved, [], out, parts).status))
    other = root / "other"
    shutil.copytree(root / "sources", other)
    with open(other / "a.parquet", "ab") as file:
        file.write(b"x")
    found.append(("changed source", verify(spark, approved, [other / p.name for p in paths], out, parts).status))
    found.append(("parts in another order", verify(spark, approved, paths, out, parts[::-1]).status))
    return told(spark, found, "mutation string, status string")


@query("SELECT * FROM (VALUES ('whole','OK'), ('part','CONFLICT'), ('decision','CONFLICT'), ('report','CONFLICT'), ('manifest','CONFLICT'), ('no manifest','INCOMPLETE'), ('another file','CONFLICT')) AS t(\"change\", status)")
def bundle_integrity(spark, sf_dir):
    """A published dataset against itself: every file is bound to the manifest."""
    root = _space(spark)
    approved = _archived(plan(spark, root / "sources", _small(root / "sources")))
    apply(spark, approved, root / "sources", root / "result")

    def edited(name: str, old: str, new: str) -> Callable[[Path], None]:
        return lambda at: (at / name).write_text((at / name).read_text().replace(old, new, 1))

    def more(at: Path) -> None:
        with open(at / "part-00000.parquet", "ab") as file:
            file.write(b"x")

    cases = {
        "whole": lambda at: None, "part": more, "decision": edited("_decision.json", "archive_only", "archive_onlx"), "report": edited("_verification.json", '"VERIFIED"', '"CONFLICT"'),
        "manifest": edited("_manifest.json", '"COMPLETE"', '"COMPLETF"'), "no manifest": lambda at: (at / "_manifest.json").unlink(), "another file": lambda at: (at / "more").touch(),
    }
    found = []
    for i, (name, change) in enumerate(cases.items()):
        at = root / f"copy-{i}"
        shutil.copytree(root / "result", at)
        change(at)
        status = outcome(lambda at=at: read_dataset(at))
        found.append((name, "CONFLICT" if status == "INVALID_INPUT" else status))
    return told(spark, found, "change string, status string")


@query("SELECT i AS source_id, 'part-0000' || CAST(i AS VARCHAR) || '.parquet' AS filename, CASE WHEN i = 2 THEN 0 ELSE (SELECT COUNT(*) FROM region WHERE r_regionkey % 2 = i) END AS n, TRUE AS exact FROM range(0, 3) AS t(i)")
def rewritten_parts(spark, sf_dir):
    """A part for each source in row order, an empty one for an empty source: Parquet 2.6, unsigned provenance."""
    root = _space(spark) / "sources"
    root.mkdir()
    sources, _ = _halves(spark, sf_dir, "region", ["r_regionkey", "r_name"], "r_regionkey", 2, lambda i, t: t, root)
    pq.write_table(pa.table({"r_regionkey": pa.array([], pa.int64())}), root / "region-2.parquet")
    approved = approve(plan(spark, root, [s.relative_path for s in sources] + ["region-2.parquet"], Limits.cluster()), [])
    out = root.parent / "parts"
    out.mkdir()
    found = []
    for p in rewrite(spark, approved, [root / s.relative_path for s in approved.plan.sources], out):
        t = pq.read_table(out / p.filename)
        exact = t.schema.field(SOURCE).type == pa.uint32() and t.schema.field(ROW).type == pa.uint64() and t[ROW].to_pylist() == list(range(p.rows)) and pq.read_metadata(out / p.filename).format_version == "2.6"
        found.append((p.source_id, p.filename, p.rows, exact))
    return told(spark, found, "source_id long, filename string, n long, exact boolean")


@query("SELECT CAST(o_orderkey % 2 AS INT) AS __pc_source, COUNT(*) AS n, CAST(0 AS BIGINT) AS faults FROM orders GROUP BY 1")
def split_parts(spark, sf_dir):
    """The converged rows through Spark's own sink, read back and compared by their coordinates."""
    root, names = _orders(spark, sf_dir)
    p = plan(spark, root, names, Limits.cluster())
    paths, fields = [str(root / n) for n in names], p.proposal.fields
    out = str(root.parent / "split")
    write_split(converge(spark, p.sources, paths, p.proposal), out, rows_per_file=500)
    stored = spark.read.parquet(out)
    wrong = None
    for s, path in zip(p.sources, paths):
        part = stored.where(F.col(SOURCE) == s.source_id).select(*[F.col(f.name).alias(f"o{i}") for i, f in enumerate(fields)], SOURCE, ROW)
        found = compare(scan(spark, path, s.source_id, s.fields), s.fields, part, fields, s.source_id, key=ROW)
        wrong = found if wrong is None else wrong.union(found)
    counts = stored.groupBy(SOURCE).agg(F.count("*").alias("n"))
    return counts.join(wrong.groupBy(SOURCE).agg(F.count("*").alias("faults")), SOURCE, "left").select(SOURCE, "n", F.coalesce("faults", F.lit(0)).alias("faults"))


@query("SELECT CAST(o_orderkey % 40 AS INT) AS __pc_source, CAST((o_orderkey - o_orderkey % 40) / 40 AS BIGINT) AS __pc_row, o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders")
def many_sources(spark, sf_dir):
    """Forty sources of two schemas; those of one schema are read together."""
    root, names = _orders(spark, sf_dir, 40)
    p = plan(spark, root, names, Limits.cluster())
    df = converge(spark, p.sources, [str(root / n) for n in names], p.proposal)
    return df.select(SOURCE, ROW, "o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT 'READY_FOR_REVIEW' AS status, CAST(2 AS BIGINT) AS files, COUNT(*) AS n_rows, TRUE AS same, 'VERIFIED' AS applied, 'VERIFIED' AS verified, 'VERIFIED' AS origin FROM orders")
def sources_where_they_are(spark, sf_dir):
    """The lifecycle over sources read as Spark reads them: the same sources and proposal as over private copies."""
    root, names = _orders(spark, sf_dir)
    p = plan(spark, f"file://{root}", names, Limits.cluster(), where_they_are=True)
    copied = plan(spark, root, names, Limits.cluster())
    target, store = root.parent / "result", f"file://{root}"
    applied = apply(spark, approve(p, []), store, target)
    verified, origin = verify_dataset(spark, target, store), lookup_origin(spark, target, 1, 3, store)
    same = (p.sources, p.proposal) == (copied.sources, copied.proposal)
    return told(spark, [(p.status, p.counters[0], p.counters[1], same, applied.status, verified.status, origin.integrity_level)], "status string, files long, n_rows long, same boolean, applied string, verified string, origin string")


@query("SELECT CAST(o_orderkey % 2 AS INT) AS source_id, TRUE AS same, COUNT(*) AS n FROM orders GROUP BY 1")
def source_hashes(spark, sf_dir):
    """Hashes of sources by tasks, against those that plans record."""
    root, names = _orders(spark, sf_dir)
    p = plan(spark, root, names, Limits.cluster())
    by_task = hashes(spark, [f"{root}/{n}" for n in names]).select(F.regexp_extract("path", r"orders-(\d+)\.parquet$", 1).cast("int").alias("source_id"), "sha256", "length")
    known = told(spark, [(s.source_id, s.sha256, s.size_bytes, s.num_rows) for s in p.sources], "source_id int, sha string, size long, n long")
    return by_task.join(known, "source_id").select("source_id", ((F.col("sha256") == F.col("sha")) & (F.col("length") == F.col("size"))).alias("same"), "n")


@query(
    "SELECT * FROM (VALUES ('plain','OK'), ('missing','INCOMPLETE'), ('outside','INVALID_INPUT'), ('absolute','INVALID_INPUT'), ('link','ERROR'), ('folder','ERROR'), ('same file twice','ERROR'),"
    " ('too large','LIMIT_EXCEEDED'), ('too many','LIMIT_EXCEEDED'), ('as planned','OK'), ('not as planned','CONFLICT'), ('linked folder','INVALID_INPUT')) AS t(\"case\", status)"
)
def snapshot_refusals(spark, sf_dir):
    root = _space(spark) / "sources"
    names = _small(root)
    sources = plan(spark, root, names).sources
    os.symlink("a.parquet", root / "link.parquet")
    os.link(root / "a.parquet", root / "hard.parquet")
    (root / "folder").mkdir()
    os.symlink("sources", root.parent / "linked")
    other = tuple(Source(s.source_id, s.relative_path, "0" * 64, s.size_bytes, s.num_rows, s.fields, s.schema_metadata) for s in sources)
    n = 0

    def take(identifiers: list[str], limits: Limits = Limits(), expected=(), at: Path = root) -> list[Copy]:
        nonlocal n
        n += 1
        staging = root.parent / f"staging-{n}"
        staging.mkdir()
        return snapshot(at, identifiers, staging, limits, expected)

    cases = {
        "plain": lambda: take(names), "missing": lambda: take(["no.parquet"]), "outside": lambda: open_inside(root, "../a.parquet"), "absolute": lambda: open_inside(root, "/a.parquet"), "link": lambda: take(["link.parquet"]),
        "folder": lambda: take(["folder"]), "same file twice": lambda: take(["a.parquet", "hard.parquet"]), "too large": lambda: take(names, Limits(max_input_bytes=10)), "too many": lambda: take(names, Limits(max_files=1)),
        "as planned": lambda: take(names, expected=sources), "not as planned": lambda: take(names, expected=other), "linked folder": lambda: take(names, at=root.parent / "linked"),
    }
    return told(spark, [(name, outcome(work)) for name, work in cases.items()], "case string, status string")


@query(
    "SELECT * FROM (VALUES ('document','OK'), ('document again','CONFLICT'), ('over a link','CONFLICT'), ('directory','OK'), ('directory again','CONFLICT'), ('inside the sources','CONFLICT'), ('around the sources','CONFLICT'),"
    " ('no folder','INCOMPLETE'), ('too large','LIMIT_EXCEEDED'), ('what is there','old')) AS t(\"case\", status)"
)
def publication_refusals(spark, sf_dir):
    root = _space(spark)
    sources = root / "sources"
    sources.mkdir()
    (root / "taken").write_text("old")
    os.symlink("nowhere", root / "link")
    for name in ("one", "two"):
        (root / name).mkdir()
    cases = {
        "document": lambda: publish_document({"a": 1}, root / "new", [sources]), "document again": lambda: publish_document({"a": 2}, root / "taken", [sources]), "over a link": lambda: publish_document({}, root / "link", []),
        "directory": lambda: publish_directory(root / "one", root / "result", [sources]), "directory again": lambda: publish_directory(root / "two", root / "result", [sources]),
        "inside the sources": lambda: free_name(sources / "x", [sources]), "around the sources": lambda: free_name(root, [sources]), "no folder": lambda: free_name(root / "no" / "x", []),
        "too large": lambda: publish_document({"a": "x" * 99}, root / "large", [], Limits(max_plan_bytes=50)),
    }
    found = [(name, outcome(work)) for name, work in cases.items()]
    return told(spark, [*found, ("what is there", (root / "taken").read_text())], "case string, status string")


@query(
    "SELECT * FROM (VALUES ('all','APPROVED'), ('none','CONFLICT'), ('one missing','CONFLICT'), ('one twice','CONFLICT'), ('unknown','CONFLICT'), ('abort','CONFLICT'), ('refused plan','CONFLICT'), ('template','INVALID_INPUT'),"
    " ('document','APPROVED'), ('another plan','CONFLICT'), ('another key','INVALID_INPUT'), ('key still in the target','INVALID_INPUT')) AS t(\"case\", status)"
)
def decisions(spark, sf_dir):
    """What approval takes: one resolution for each conflict, for this plan, none of them abort."""
    root = _space(spark)
    names = _small(root / "sources")
    p = plan(spark, root / "sources", names)
    every = [Resolution(c.digest, "archive_only") for c in p.proposal.conflicts]
    refused = plan(spark, root / "sources", ["no.parquet"])
    document = {"format_version": 1, "plan_digest": p.digest, "resolutions": [r.to_json() for r in every]}

    def read(value: dict):
        path = root / "decisions.json"
        path.write_bytes(canonical(value))
        return approve(p, load_resolutions(path, p))

    kept = tuple(Field(f.name, f.type, f.nullable, f.metadata) for f in p.proposal.fields)
    shown = Proposal(kept, ((b"maker", b"a"),), p.proposal.operations, p.proposal.conflicts)
    cases = {
        "all": lambda: approve(p, every), "none": lambda: approve(p, []), "one missing": lambda: approve(p, every[1:]), "one twice": lambda: approve(p, [*every, every[0]]),
        "unknown": lambda: approve(p, [*every[1:], Resolution("0" * 64, "archive_only")]), "abort": lambda: approve(p, [*every[1:], Resolution(every[0].conflict_digest, "abort")]), "refused plan": lambda: approve(refused, []),
        "template": lambda: read(template(p)), "document": lambda: read(document), "another plan": lambda: read(document | {"plan_digest": "0" * 64}), "another key": lambda: read(document | {"more": 1}),
        "key still in the target": lambda: check_dropped(_with_proposal(p, shown)),
    }
    found = [(name, outcome(work)) for name, work in cases.items()]
    return told(spark, [(name, "APPROVED" if status == "OK" else status) for name, status in found], "case string, status string")


def _with_proposal(p: Plan, proposal: Proposal) -> Plan:
    """A plan whose target is another one, as no planner makes it."""
    out = object.__new__(Plan)
    for name in p.__dataclass_fields__:
        object.__setattr__(out, name, getattr(p, name))
    object.__setattr__(out, "proposal", proposal)
    return out


@query(
    "SELECT path, k, sha256('{\"key\":\"' || to_base64(encode(k)) || '\",\"path\":' || path || ',\"values\":[[0,\"' || to_base64(encode(a)) || '\"],[1,\"' || to_base64(encode(b)) || '\"]]}') AS digest"
    " FROM (VALUES ('[]','maker','a','b'), ('[\"s\",\"x\"]','unit','m','cm')) AS t(path, k, a, b)"
)
def conflict_digests(spark, sf_dir):
    """The identity of a conflict: the hash of its canonical document."""
    root = _space(spark)
    p = plan(spark, root / "sources", _small(root / "sources"))
    return told(spark, [(canonical(list(c.path)).decode(), c.key.decode(), c.digest) for c in p.proposal.conflicts], "path string, k string, digest string")


@query("SELECT n_nationkey, sha256('{\"key\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"' || n_name || '\"}') AS digest, to_base64(encode(n_name)) AS b64, TRUE AS reads_back FROM nation")
def canonical_documents(spark, sf_dir):
    """Canonical JSON, its digest and canonical base64 of each row, read back strictly."""

    def documents(batches):
        for batch in batches:
            rows = [({"name": r["n_name"], "key": r["n_nationkey"]}, r["n_name"].encode(), r["n_nationkey"]) for r in batch.to_pylist()]
            back = [parse(canonical(d)) == d and from_base64(to_base64(raw)) == raw for d, raw, _ in rows]
            yield pa.RecordBatch.from_pydict({"n_nationkey": pa.array([k for *_, k in rows], pa.int32()), "digest": [digest(d) for d, *_ in rows], "b64": [to_base64(raw) for _, raw, _ in rows], "reads_back": back})

    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").mapInArrow(documents, "n_nationkey int, digest string, b64 string, reads_back boolean")


@query(
    "SELECT * FROM (VALUES ('repeated key','INVALID_INPUT'), ('float','INVALID_INPUT'), ('NaN','INVALID_INPUT'), ('lone surrogate','INVALID_INPUT'), ('not JSON','INVALID_INPUT'), ('too long','LIMIT_EXCEEDED'), ('plain','OK'), ('base64 with spare bits','INVALID_INPUT')) AS t(\"case\", status)"
)
def document_refusals(spark, sf_dir):
    raw = {"repeated key": b'{"a":1,"a":2}', "float": b"[1.5]", "NaN": b"[NaN]", "lone surrogate": b'["\\ud800"]', "not JSON": b"{", "plain": b'{"a":[1,null,"x"]}'}
    found = [(name, outcome(lambda r=r: parse(r))) for name, r in raw.items()]
    found += [("too long", outcome(lambda: parse(b"[1,2,3]", 3))), ("base64 with spare bits", outcome(lambda: from_base64("YR==")))]
    return told(spark, found, "case string, status string")


LATTICE = [
    ("null+null", [Type("null")] * 2, "null"),
    ("null+int32", [Type("null"), int_(32)], "int32"),
    ("int8+uint8", [int_(8), uint(8)], "int16"),
    ("uint8+uint32", [uint(8), uint(32)], "uint32"),
    ("int64+uint64", [int_(64), uint(64)], "decimal128(20,0)"),
    ("int32+decimal(10,2)", [int_(32), decimal(10, 2)], "decimal128(12,2)"),
    ("decimal(10,8)+decimal(10,2)", [decimal(10, 8), decimal(10, 2)], "decimal128(16,8)"),
    ("uint64+decimal(38,20)", [uint(64), decimal(38, 20)], "decimal256(40,20)"),
    ("decimal(38,0)+decimal(38,38)", [decimal(38, 0), decimal(38, 38)], "decimal256(76,38)"),
    ("decimal(76,0)+decimal(38,1)", [decimal(76, 0, True), decimal(38, 1)], "UNSUPPORTED"),
    ("float32+float64", [float_(32), float_(64)], "float64"),
    ("ms+ns", [timestamp("ms"), timestamp("ns")], "timestamp(ns)"),
    ("us UTC+ns UTC", [timestamp("us", "UTC"), timestamp("ns", "UTC")], "timestamp(ns,UTC)"),
    ("us UTC+us", [timestamp("us", "UTC"), timestamp("us")], "UNSUPPORTED"),
    ("us UTC+us +00:00", [timestamp("us", "UTC"), timestamp("us", "+00:00")], "UNSUPPORTED"),
    ("string+string", [Type("string")] * 2, "string"),
    ("bool+bool", [Type("bool")] * 2, "bool"),
    ("bool+int8", [Type("bool"), int_(8)], "UNSUPPORTED"),
    ("string+binary", [Type("string"), Type("binary")], "UNSUPPORTED"),
    ("int64+float64", [int_(64), float_(64)], "UNSUPPORTED"),
    ("decimal+float32", [decimal(5, 1), float_(32)], "UNSUPPORTED"),
    ("struct+int8", [struct(Field("a", int_(8), True)), int_(8)], "UNSUPPORTED"),
    ("struct+struct", [struct(Field("a", int_(8), True)), struct(Field("a", int_(16), True), Field("b", Type("bool"), True))], "struct"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}','{want}')" for name, _, want in LATTICE) + ") AS t(types, joined)")
def lattice_edges(spark, sf_dir):
    """The least common type of two declared types, or the refusal."""

    def joined(types: list[Type]) -> str:
        sources = tuple(Source(i, f"s{i}.parquet", "0" * 64, 1, 1, (Field("x", t, True),)) for i, t in enumerate(types))
        try:
            return propose(sources).fields[0].type.label
        except Refusal as error:
            return error.status

    return told(spark, [(name, joined(types)) for name, types, _ in LATTICE], "types string, joined string")


@query("SELECT * FROM (VALUES (0,'A',TRUE), (1,'a',FALSE), (2,'z',TRUE), (3,chr(233),TRUE)) AS t(place, name, nullable)")
def code_point_order(spark, sf_dir):
    """Fields by code point; nullable where absent or nullable anywhere."""
    own = lambda name, null=True: Field(name, int_(8), null)
    sources = (Source(0, "a.parquet", "0" * 64, 1, 1, (own("z", False), own("a", False), own("é"))), Source(1, "b.parquet", "1" * 64, 1, 1, (own("A", False), own("a", False), own("é", False))))
    return told(spark, [(i, f.name, f.nullable) for i, f in enumerate(propose(sources).fields)], "place int, name string, nullable boolean")


@query(
    "SELECT * FROM (VALUES ('rows','LIMIT_EXCEEDED',3), ('bytes','LIMIT_EXCEEDED',3), ('files','LIMIT_EXCEEDED',3), ('output','LIMIT_EXCEEDED',3), ('fields','LIMIT_EXCEEDED',3), ('depth','LIMIT_EXCEEDED',3), ('missing','INCOMPLETE',3), ('float','UNSUPPORTED',2), ('none','NEEDS_DECISIONS',1)) AS t(cap, status, code)"
)
def limits(spark, sf_dir):
    """Caps and their statuses, with the exit code of each."""
    root = _space(spark) / "sources"
    names = _small(root)
    deep = pa.array([1])
    for _ in range(9):
        deep = pa.StructArray.from_arrays([deep], ["x"])
    pq.write_table(pa.table({"x": deep}), root / "deep.parquet")
    pq.write_table(pa.table({f"c{i}": [i] for i in range(513)}), root / "wide.parquet")
    pq.write_table(pa.table({"k": [0.5]}), root / "float.parquet")
    cases = {
        "rows": (names, Limits(max_rows=3)), "bytes": (names, Limits(max_input_bytes=100)), "files": (names, Limits(max_files=1)), "fields": (["wide.parquet"], Limits()), "depth": (["deep.parquet"], Limits()),
        "missing": (["no.parquet"], Limits()), "float": ([*names, "float.parquet"], Limits()), "none": (names, Limits()),
    }
    found = [(cap, plan(spark, root, files, most).status) for cap, (files, most) in cases.items()]
    small = _archived(plan(spark, root, names, Limits(max_output_bytes=100)))
    found.append(("output", apply(spark, small, root, root.parent / "never").status))
    return told(spark, [(cap, status, EXITS[status]) for cap, status in found], "cap string, status string, code int")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) || '.' || repeat('0', 20) ELSE '-0.' || lpad(CAST(c_custkey AS VARCHAR), 20, '0') END AS x FROM customer WHERE c_custkey > 0")
def wide_decimals(spark, sf_dir):
    """decimal(38,1) and decimal(38,20) meet in 57 digits, which no Spark type holds: values as exact text."""

    def make(i, t):
        from decimal import Context, Decimal

        exact = Context(prec=60)
        keys = t["c_custkey"].to_pylist()
        values = [Decimal(k) if i == 0 else exact.scaleb(Decimal(-k), -20) for k in keys]
        return pa.table({"c_custkey": t["c_custkey"], "x": pa.array([exact.quantize(v, Decimal(1).scaleb(-(1, 20)[i])) for v in values], pa.decimal128(38, (1, 20)[i]))})

    sources, paths = _halves(spark, sf_dir, "customer", ["c_custkey"], "c_custkey", 2, make, _space(spark))
    return converge(spark, sources, paths, propose(sources)).where("c_custkey > 0").select("c_custkey", "x")


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS STRING) AS o_orderpriority, CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS __pc_row FROM orders WHERE o_orderkey % 2 = 0")
def stream_of_files(spark, sf_dir):
    """Files that arrive for an approved source, aligned as they come: a stream run until it has read all."""
    root, names = _orders(spark, sf_dir)
    p = plan(spark, root, names, Limits.cluster())
    inbox, out = root.parent / "inbox", root.parent / "aligned"
    inbox.mkdir()
    shutil.copyfile(root / names[0], inbox / names[0])
    stream = aligned_stream(spark, str(inbox), p.sources[0], p.proposal).drop("file")
    run = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(root.parent / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(out)).select("o_orderkey", "o_custkey", "o_orderpriority", ROW)
