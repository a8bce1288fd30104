"""Plan, decide, apply, verify and origin over real files, and what must be refused."""

import json
import math
import shutil
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tributary.errors import Conflicted, Refusal
from tributary.examples import create
from tributary.operators.align import converge
from tributary.operators.feasibility import plan
from tributary.operators.origin import lookup_origin, render, verify_dataset
from tributary.operators.publish import apply, read_dataset, rewrite
from tributary.operators.verify import verify
from tributary.plans.decisions import approve, load_resolutions, template
from tributary.plans.decisions import render as render_plan
from tributary.plans.documents import canonical
from tributary.plans.records import Limits, Part, Resolution
from tributary.sources.parquet import in_place, sha256_file, unchanged


def put(root, *tables):
    root.mkdir(exist_ok=True)
    names = [f"s{i}.parquet" for i in range(len(tables))]
    for name, t in zip(names, tables):
        pq.write_table(t, root / name, version="2.6", row_group_size=2)
    return names


def archive(p):
    return approve(p, [Resolution(c.digest, "archive_only") for c in p.proposal.conflicts])


def run(spark, root, *tables):
    """An approved plan over the tables, with parts in a new directory."""
    approved = archive(plan(spark, root, put(root, *tables)))
    out = root.parent / "parts"
    out.mkdir()
    paths = [root / s.relative_path for s in approved.plan.sources]
    return approved, paths, out, rewrite(spark, approved, paths, out)


def union_case():
    rec = lambda *fields: pa.struct(list(fields))
    a = pa.schema([pa.field("z", pa.int16(), False), pa.field("rec", rec(pa.field("x", pa.int8(), metadata={"unit": "m"}))), pa.field("n", pa.null())], {"producer": "old"})
    b = pa.schema([pa.field("added", pa.int32(), False), pa.field("n", pa.int32()), pa.field("rec", rec(pa.field("x", pa.int16(), metadata={"unit": "cm"}), pa.field("y", pa.int32(), False))), pa.field("z", pa.int16(), False)], {"producer": "new"})
    rows = [[{"z": 1, "rec": {"x": 2}}, {"z": 3, "rec": None}, {"z": 4, "rec": {"x": None}}], [{"added": 6, "n": 7, "rec": {"x": 8, "y": 9}, "z": 10}]]
    return pa.Table.from_pylist(rows[0], a), pa.Table.from_pylist(rows[1], b)


def test_union_case(spark, tmp_path):
    approved, paths, out, parts = run(spark, tmp_path / "in", *union_case())
    report = verify(spark, approved, paths, out, parts)
    assert report.verified, report
    assert dict(report.counters)["values"] == (4 + 2) + 4 + (4 + 2) + (4 + 2)
    rows = [pq.read_table(out / p.filename).to_pylist() for p in parts]
    for size in (1, 3, 7):
        small = verify(spark, approved, paths, out, parts, batch_rows=size)
        assert small.verified and small.counters == report.counters
    assert not verify(spark, approved, paths, out, parts, batch_rows=0).verified
    assert [tuple(r.values()) for r in rows[0]] == [(None, None, {"x": 2, "y": None}, 1, 0, 0), (None, None, None, 3, 0, 1), (None, None, {"x": None, "y": None}, 4, 0, 2)]
    assert [tuple(r.values()) for r in rows[1]] == [(6, 7, {"x": 8, "y": 9}, 10, 1, 0)]
    schema = pq.read_schema(out / parts[0].filename)
    assert schema.field("z").nullable is False and schema.field("__pc_row").type == pa.uint64() and not schema.metadata


def rewritten(out, part, change):
    """The parts with one file changed and its record brought up to date."""
    path = out / part.filename
    table = change(pq.read_table(path))
    pq.write_table(table, path, version="2.6", compression="NONE", use_dictionary=False)
    size, sha = sha256_file(path)
    return Part(part.filename, part.source_id, part.rows, size, sha, part.target_schema_digest)


def edit(row, change):
    def apply_(table):
        rows = table.to_pylist()
        change(rows[row])
        return pa.Table.from_pylist(rows, table.schema)

    return apply_


MUTATIONS = {
    "wrong_value": (0, 0, lambda r: r.update(z=2), "row=0 path=[\"z\"]: logical value differs"),
    "absent_top": (0, 2, lambda r: r.update(added=5), "row=2 path=[\"added\"]: expected null observation"),
    "absent_child": (0, 0, lambda r: r["rec"].update(y=999), "row=0 path=[\"rec\",\"y\"]: expected null observation"),
    "typed_null": (0, 1, lambda r: r.update(n=1), "row=1 path=[\"n\"]: expected null observation"),
    "null_parent_filled": (0, 1, lambda r: r.update(rec={"x": None, "y": None}), "row=1 path=[\"rec\"]: expected null observation"),
    "valid_all_null_collapsed": (0, 2, lambda r: r.update(rec=None), "row=2 path=[\"rec\"]: unexpected null observation"),
    "source_id": (0, 1, lambda r: r.update(__pc_source=1), "row=1 path=[\"__pc_source\"]: provenance value differs"),
    "row_index": (0, 2, lambda r: r.update(__pc_row=7), "row=2 path=[\"__pc_row\"]: provenance value differs"),
    "second_source": (1, 0, lambda r: r["rec"].update(x=9), "source=1 row=0 path=[\"rec\",\"x\"]: logical value differs"),
}


def test_row_mutations(spark, tmp_path):
    approved, paths, out, parts = run(spark, tmp_path / "in", *union_case())
    for name, (which, row, change, message) in MUTATIONS.items():
        at = tmp_path / name
        shutil.copytree(out, at)
        changed = list(parts)
        changed[which] = rewritten(at, parts[which], edit(row, change))
        report = verify(spark, approved, paths, at, changed)
        assert report.status == "CONFLICT" and message in report.diagnostics[0], (name, report)


def test_schema_and_inventory_mutations(spark, tmp_path):
    approved, paths, out, parts = run(spark, tmp_path / "in", *union_case())
    swaps = {
        "order": lambda t: t.select([1, 0, *range(2, t.num_columns)]),
        "type": lambda t: t.set_column(3, pa.field("z", pa.int32(), False), t["z"].cast(pa.int32())),
        "nullable": lambda t: t.set_column(3, pa.field("z", pa.int16(), True), t["z"]),
        "metadata": lambda t: t.replace_schema_metadata({"producer": "old"}),
        "field_metadata": lambda t: t.set_column(3, pa.field("z", pa.int16(), False, {"a": "b"}), t["z"]),
        "provenance": lambda t: t.set_column(5, pa.field("__pc_row", pa.int64(), False), t["__pc_row"].cast(pa.int64())),
        "short": lambda t: t.slice(0, 2),
    }
    for name, change in swaps.items():
        at = tmp_path / name
        shutil.copytree(out, at)
        report = verify(spark, approved, paths, at, [rewritten(at, parts[0], change), parts[1]])
        assert report.status == "CONFLICT", (name, report)
    at = tmp_path / "extra"
    shutil.copytree(out, at)
    (at / "more").touch()
    assert verify(spark, approved, paths, at, parts).status == "CONFLICT"
    (at / "more").unlink()
    (at / parts[1].filename).unlink()
    assert verify(spark, approved, paths, at, parts).status == "CONFLICT"
    assert verify(spark, approved, [], out, parts).status == "INCOMPLETE"


EXACT = [
    ("int", pa.array([-(1 << 63), (1 << 63) - 1, None], pa.int64()), pa.array([(1 << 64) - 1], pa.uint64()), pa.decimal128(20, 0)),
    ("small", pa.array([-128, 127, None], pa.int8()), pa.array([65535], pa.uint16()), pa.int32()),
    ("uint", pa.array([0, 255, None], pa.uint8()), pa.array([(1 << 64) - 1], pa.uint64()), pa.uint64()),
    ("decimal", pa.array([Decimal("1.25"), Decimal("-99999999.99"), None], pa.decimal128(10, 2)), pa.array([Decimal("0.00001")], pa.decimal128(10, 5)), pa.decimal128(13, 5)),
    ("to_wide", pa.array([Decimal("1.5"), Decimal("-0.5"), None], pa.decimal128(38, 1)), pa.array([Decimal("0." + "0" * 19 + "1")], pa.decimal128(38, 20)), pa.decimal256(57, 20)),
    ("wide", pa.array([Decimal("1.23"), Decimal("-" + "9" * 48 + ".99"), None], pa.decimal256(50, 2)), pa.array([Decimal("0.0001")], pa.decimal256(52, 4)), pa.decimal256(52, 4)),
    ("float", pa.array([0.1, math.nan, math.inf, -0.0, None], pa.float32()), pa.array([-0.0, math.nan], pa.float64()), pa.float64()),
    ("ticks", pa.array([-(1 << 40), 1, None], pa.timestamp("us", "UTC")), pa.array([(1 << 63) - 1], pa.int64()).cast(pa.timestamp("ns", "UTC")), pa.timestamp("ns", "UTC")),
    ("text", pa.array(["é", "é", "", None]), pa.array(["x"]), pa.string()),
    ("bytes", pa.array([b"\x00\xff", b"", None]), pa.array([b"x"]), pa.binary()),
    ("bool", pa.array([True, False, None]), pa.array([True]), pa.bool_()),
    ("null", pa.array([None, None], pa.null()), pa.array([None], pa.null()), pa.null()),
]


def test_exact_values(spark, tmp_path):
    """All families in one pair of sources, through Spark and back, value by value."""
    n = 5
    tables = []
    for side in (1, 2):
        columns = {}
        for row in EXACT:
            x = row[side]
            columns[row[0]] = pa.concat_arrays([x, pa.nulls(n - len(x), x.type)])
        tables.append(pa.table(columns))
    approved, paths, out, parts = run(spark, tmp_path / "in", *tables)
    report = verify(spark, approved, paths, out, parts)
    assert report.verified, report
    for side, part in enumerate(parts):
        got = pq.read_table(out / part.filename)
        for name, a, b, want in EXACT:
            x = (a, b)[side]
            assert got.schema.field(name).type == want
            for have, expect in zip(got[name].to_pylist() if not pa.types.is_timestamp(want) else got[name].cast(pa.int64()).to_pylist(), x.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(want) else x.to_pylist()):
                if pa.types.is_timestamp(want) and expect is not None:
                    expect *= 1000 if x.type.unit == "us" else 1
                if isinstance(expect, float):
                    assert repr(have) == repr(expect)
                else:
                    assert have == expect, name
    bad = {"int": Decimal(1), "to_wide": Decimal("1.6"), "float": math.nan, "ticks": 1, "text": "e", "bytes": b"\x00", "bool": False, "uint": 7}
    for name, value in bad.items():
        at = tmp_path / f"bad-{name}"
        shutil.copytree(out, at)
        changed = rewritten(at, parts[0], edit(0, lambda r, name=name, value=value: r.update({name: value})))
        report = verify(spark, approved, paths, at, [changed, parts[1]])
        assert report.status == "CONFLICT" and f'source=0 row=0 path=["{name}"]: logical value differs' in report.diagnostics[0], report
    at = tmp_path / "bad-zero"
    shutil.copytree(out, at)
    changed = rewritten(at, parts[0], edit(3, lambda r: r.update({"float": 0.0})))
    assert verify(spark, approved, paths, at, [changed, parts[1]]).status == "CONFLICT"


def test_hidden_children_are_not_observations(spark, tmp_path):
    """A tick that overflows under a null parent neither blocks planning nor reaches the output."""
    ticks = pa.array([(1 << 63) - 1, 5], pa.int64()).cast(pa.timestamp("us"))
    masked = pa.StructArray.from_arrays([ticks], ["t"], mask=pa.array([True, False]))
    approved, paths, out, parts = run(spark, tmp_path / "in", pa.table({"s": masked}), pa.table({"s": pa.array([{"t": 1}], pa.struct([("t", pa.timestamp("ns"))]))}))
    assert verify(spark, approved, paths, out, parts).verified
    assert pq.read_table(out / parts[0].filename)["s"].is_null().to_pylist() == [True, False]


def test_tick_edges(spark, tmp_path):
    edge = ((1 << 63) - 1) // 1000
    for i, (tick, status) in enumerate([(edge, "READY_FOR_REVIEW"), (edge + 1, "DATA_INCOMPATIBLE"), (-edge, "READY_FOR_REVIEW"), (-edge - 1, "DATA_INCOMPATIBLE"), (None, "READY_FOR_REVIEW")]):
        us = pa.table({"t": pa.array([1, 2, 3, tick], pa.int64()).cast(pa.timestamp("us"))})
        ns = pa.table({"t": pa.array([1], pa.int64()).cast(pa.timestamp("ns"))})
        p = plan(spark, tmp_path / str(i), put(tmp_path / str(i), us, ns))
        assert p.status == status, p.diagnostics
        if status == "DATA_INCOMPATIBLE":
            assert "row=3" in p.diagnostics[0]


def test_empty_sources_and_strange_names(spark, tmp_path):
    a = pa.table({"a.b": pa.array([1], pa.int8()), "`q`": ["x"], "": [True], "a": pa.array([{"b": 1, "": 2}])})
    b = pa.table({"a.b": pa.array([], pa.int16()), "extra": pa.array([], pa.string())})
    approved, paths, out, parts = run(spark, tmp_path / "in", a, b)
    assert verify(spark, approved, paths, out, parts).verified
    assert [p.rows for p in parts] == [1, 0]
    assert pq.read_table(out / parts[0].filename).to_pylist() == [{"": True, "`q`": "x", "a": {"": 2, "b": 1}, "a.b": 1, "extra": None, "__pc_source": 0, "__pc_row": 0}]


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_results_do_not_depend_on_splits(spark, tmp_path, split):
    import numpy as np

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        n = 3000
        x = pa.table({"x": pa.array(np.arange(n), pa.int32()), "s": pa.array([None if i % 11 == 0 else {"k": i} for i in range(n)])})
        approved, paths, out, parts = run(spark, tmp_path / "in", x, pa.table({"x": pa.array([1], pa.int64())}))
        assert verify(spark, approved, paths, out, parts).verified
        assert pq.read_table(out / parts[0].filename)["__pc_row"].to_pylist() == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_journey(spark, tmp_path):
    root = tmp_path / "sources"
    create(root)
    p = plan(spark, root, ["legacy.parquet", "new.parquet"])
    assert p.status == "NEEDS_DECISIONS" and len(p.proposal.conflicts) == 2
    shown = render_plan(p)
    assert all(c.digest in shown for c in p.proposal.conflicts) and '"payload","distance"' in shown
    decisions = tmp_path / "decisions.json"
    decisions.write_text(json.dumps(template(p)))
    with pytest.raises(Refusal):
        load_resolutions(decisions, p)  # the template's actions are not valid
    with pytest.raises(Conflicted):
        approve(p, [Resolution(p.proposal.conflicts[0].digest, "archive_only")])
    with pytest.raises(Conflicted):
        approve(p, [Resolution(c.digest, "abort") for c in p.proposal.conflicts])
    decisions.write_bytes(canonical(template(p) | {"resolutions": [{"conflict_digest": c.digest, "action": "archive_only"} for c in p.proposal.conflicts]}))
    approved = approve(p, load_resolutions(decisions, p))
    target = tmp_path / "result"
    report = apply(spark, approved, root, target)
    assert report.verified, report
    assert sorted(e.name for e in target.iterdir()) == ["_decision.json", "_manifest.json", "_verification.json", "part-00000.parquet", "part-00001.parquet"]
    assert pq.read_table(target).num_rows == 3
    again = apply(spark, approved, root, target)
    assert again.status == "CONFLICT" and pq.read_table(target).num_rows == 3
    assert [e.name for e in tmp_path.iterdir() if "INCOMPLETE" in e.name] == []
    seen = lookup_origin(spark, target, 1, 0)
    assert (seen.integrity_level, seen.verification_label) == ("OUTPUT_HASHES_MATCH", "HISTORICAL")
    assert '"cm"' in render(seen) and seen.source.relative_path == "new.parquet"
    assert lookup_origin(spark, target, 1, 0, root).integrity_level == "VERIFIED"
    for bad in ((2, 0), (0, 2), (0, True), (-1, 0)):
        with pytest.raises(Refusal):
            lookup_origin(spark, target, *bad)
    assert verify_dataset(spark, target, root, approved).verified
    assert verify_dataset(spark, target, tmp_path / "nowhere", approved).status == "INCOMPLETE"
    changed = tmp_path / "changed"
    shutil.copytree(root, changed)
    with open(changed / "legacy.parquet", "ab") as f:
        f.write(b"more")
    assert verify_dataset(spark, target, changed, approved).status == "CONFLICT"
    assert apply(spark, approved, changed, tmp_path / "never").status == "CONFLICT" and not (tmp_path / "never").exists()
    with open(target / "part-00000.parquet", "ab") as f:
        f.write(b"x")
    with pytest.raises(Refusal):
        read_dataset(target)


def test_refused_plans(spark, tmp_path):
    root = tmp_path / "in"
    names = put(root, pa.table({"x": [1, 2, 3]}), pa.table({"x": [0.5]}), pa.table({"x": [[1]]}))
    assert plan(spark, root, names[:2]).status == "UNSUPPORTED"
    assert plan(spark, root, names[2:]).status == "UNSUPPORTED"
    assert plan(spark, root, ["no.parquet"]).status == "INCOMPLETE"
    assert plan(spark, root, names[:1], Limits(max_rows=2)).status == "LIMIT_EXCEEDED"
    assert plan(spark, root, names[:1], Limits(max_input_bytes=10)).status == "LIMIT_EXCEEDED"
    assert plan(spark, root, ["../in/s0.parquet"]).status == "ERROR"
    (root / "link.parquet").symlink_to(root / names[0])
    assert plan(spark, root, ["link.parquet"]).status == "ERROR"
    (root / "text.parquet").write_text("no")
    assert plan(spark, root, ["text.parquet"]).status == "ERROR"


def test_fields_and_files_caps(spark, tmp_path):
    root = tmp_path / "in"
    wide = put(root, pa.table({f"c{i}": [i] for i in range(513)}))
    assert plan(spark, root, wide).status == "LIMIT_EXCEEDED"
    assert plan(spark, root, [f"f{i}.parquet" for i in range(129)]).status == "LIMIT_EXCEEDED"


def test_sources_where_they_are(spark, tmp_path):
    """The same plan without private copies; caps, missing and equal files refuse as there."""
    root = tmp_path / "in"
    names = put(root, *union_case())
    p = plan(spark, f"file://{root}", names, where_they_are=True)
    copied = plan(spark, root, names)
    assert (p.status, p.sources, p.proposal, p.counters) == (copied.status, copied.sources, copied.proposal, copied.counters)
    assert plan(spark, f"file://{root}", ["no.parquet"], where_they_are=True).status == "INCOMPLETE"
    assert plan(spark, f"file://{root}", names, Limits(max_input_bytes=10), where_they_are=True).status == "LIMIT_EXCEEDED"
    assert plan(spark, f"file://{root}", names, Limits(max_files=1), where_they_are=True).status == "LIMIT_EXCEEDED"
    copies, marks = in_place(spark, str(root), names, Limits())
    unchanged(spark, copies, marks)
    with open(root / names[0], "ab") as file:
        file.write(b"x")
    with pytest.raises(Refusal):
        unchanged(spark, copies, marks)
    with pytest.raises(Conflicted):
        in_place(spark, str(root), names, Limits(), p.sources)


def test_many_alike_sources(spark, tmp_path):
    """Sources of one schema read together give the rows that branches give, with their own coordinates."""
    tables = [pa.table({"x": pa.array(range(i, i + 5), pa.int32()), "s": [{"a": j} for j in range(5)]}) for i in range(0, 100, 5)] + [pa.table({"x": pa.array([7], pa.int64())})]
    root = tmp_path / "in"
    p = plan(spark, root, put(root, *tables))
    assert p.status == "READY_FOR_REVIEW" and p.counters[1] == 101
    df = converge(spark, p.sources, [str(root / s.relative_path) for s in p.sources], p.proposal)
    got = sorted((r["__pc_source"], r["__pc_row"], r["x"], r["s"] and r["s"]["a"]) for r in df.collect())
    assert got == [(i, j, 5 * i + j, j) for i in range(20) for j in range(5)] + [(20, 0, 7, None)]
    assert str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("FileScan") == 2
