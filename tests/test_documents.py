import pytest

from tributary.errors import LimitExceeded, Refusal, status_of
from tributary.plans import documents as d
from tributary.plans.records import Limits, Plan, check_identifier
from tributary.plans.types import BINARY, BOOL, NULL, STRING, Field, Type, decimal, float_, from_arrow, int_, struct, timestamp, to_arrow, uint


@pytest.mark.parametrize("raw", [b'{"a":1,"a":2}', b"1.5", b"NaN", b"[1e3]", b"\xff", b"{", b'"\\ud800"', b'"a\\u0000"'])
def test_strict_reading(raw):
    with pytest.raises(Refusal):
        d.parse(raw)


def test_canonical_form_and_cap():
    assert d.canonical({"b": [1, None, True], "a": "é"}) == '{"a":"é","b":[1,null,true]}'.encode()
    with pytest.raises(Refusal):
        d.canonical([0.5])
    with pytest.raises(LimitExceeded):
        d.parse(b"[" + b"1," * 100 + b"1]", most=50)
    with pytest.raises(Refusal):
        d.from_base64("YQ")


def test_booleans_are_not_integers():
    with pytest.raises(Refusal):
        d.check_int(True, "n")


@pytest.mark.parametrize("bad", ["", "/a", "a/../b", "./a", "a//b", "a\\b", "a/"])
def test_identifiers(bad):
    with pytest.raises(Refusal):
        check_identifier(bad)


def test_limits_only_fall():
    assert Limits(max_rows=5).max_rows == 5
    for bad in (Limits.__dataclass_fields__["max_rows"].default + 1, 0):
        with pytest.raises(Refusal):
            Limits(max_rows=bad)
    assert Limits.cluster().max_rows > 10**12


@pytest.mark.parametrize("t", [NULL, BOOL, STRING, BINARY, *[int_(b) for b in (8, 16, 32, 64)], *[uint(b) for b in (8, 16, 32, 64)], float_(32), float_(64), decimal(38, 2), decimal(76, 3), timestamp("s"), timestamp("ns", "Europe/Paris"), struct(), struct(Field("a", struct(Field("", NULL))))])
def test_type_round_trips(t):
    assert from_arrow(to_arrow(t)) == t
    assert Type.from_json(t.to_json()) == t


def test_excluded_types():
    import pyarrow as pa

    from tributary.errors import Unsupported

    for t in (pa.list_(pa.int8()), pa.map_(pa.string(), pa.int8()), pa.date32(), pa.duration("s"), pa.binary(4), pa.large_string(), pa.float16(), pa.dictionary(pa.int8(), pa.string()), pa.decimal128(5, -1), pa.time64("ns")):
        with pytest.raises(Unsupported):
            from_arrow(t)


def test_a_changed_document_is_refused():
    plan = Plan("ERROR", diagnostics=("x",))
    assert Plan.from_json(plan.to_json()) == plan
    for change in ({"status": "UNSUPPORTED"}, {"more": 1}, {"plan_digest": "0" * 64}):
        with pytest.raises(Refusal):
            Plan.from_json(plan.to_json() | change)


def test_statuses_of_errors():
    assert status_of(FileNotFoundError()) == "INCOMPLETE"
    assert status_of(MemoryError()) == "LIMIT_EXCEEDED"
    assert status_of(OSError(28, "full")) == "LIMIT_EXCEEDED"
    assert status_of(ValueError("[CAST_OVERFLOW] no")) == "DATA_INCOMPATIBLE"
    assert status_of(ValueError("?")) == "ERROR"
    assert status_of(KeyboardInterrupt()) == "CANCELLED"


def test_raw_caps():
    """A hostile plan is refused by its raw counts, before records are made of it."""
    from tributary.errors import LimitExceeded
    from tributary.plans.records import Limits, raw_caps

    def nested(levels):
        kind = {"kind": "int", "bits": 8}
        for _ in range(levels):
            kind = {"kind": "struct", "fields": [{"name": "x", "type": kind, "nullable": True, "metadata": []}]}
        return kind

    field = lambda kind={"kind": "int"}, metadata=(): {"name": "x", "type": kind, "nullable": True, "metadata": list(metadata)}
    source = lambda **more: {"fields": [], "schema_metadata": [], "num_rows": 1, "size_bytes": 1} | more
    target = lambda **more: {"fields": [], "schema_metadata": [], "operations": [], "conflicts": []} | more
    plan = lambda sources=(), proposal=None, **counters: {"sources": list(sources), "proposal": proposal, "preflight_counters": counters}
    limits = Limits(max_files=2, max_rows=10, max_input_bytes=10, max_fields=3, max_depth=2, max_metadata_bytes=12)
    big = [["AAAAAAAA", "AAAAAAAA"], ["AAAAAAAA", "AAAAAAAA"]]
    for bad in (
        plan([source()] * 3), plan([source(num_rows=6)] * 2), plan([source(size_bytes=6)] * 2), plan(rows=11), plan(files=3), plan(input_bytes=11),
        plan([source(fields=[field()] * 2)] * 2), plan([source(fields=[field(nested(3))])]), plan([source(schema_metadata=big)]), plan([source(fields=[field(metadata=big)])]),
        plan(proposal=target(fields=[field()] * 4)), plan(proposal=target(fields=[field(nested(4000))])), plan(proposal=target(schema_metadata=big)),
        plan(proposal=target(operations=[{"path": ["x"], "source_type": None, "target_type": None}] * 7)),
        plan(proposal=target(operations=[{"path": ["x"] * 4, "source_type": None, "target_type": None}])),
        plan(proposal=target(operations=[{"path": ["x"], "source_type": nested(4000), "target_type": None}])),
        plan(proposal=target(conflicts=[{"path": [], "values": [[0, None]] * 3}])),
    ):
        try:
            raw_caps(bad, limits)
        except LimitExceeded:
            continue
        raise AssertionError(bad)
    raw_caps(plan([source(fields=[field(nested(2))])], target(operations=[{"path": ["x"], "source_type": nested(2), "target_type": {"kind": "int"}}]), rows=1), limits)


def test_metered_file(tmp_path):
    import pytest

    from tributary.errors import LimitExceeded
    from tributary.sources.parts import Metered

    with Metered(str(tmp_path / "x"), 5) as out:
        out.write(b"abc")
        with pytest.raises(LimitExceeded):
            out.write(b"def")
        out.write(b"de")
    assert (tmp_path / "x").read_bytes() == b"abcde"
