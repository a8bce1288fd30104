"""The lattice by hand-written results, and the planner against the second derivation."""

from itertools import product

import pytest

from tributary.errors import Refusal, Unsupported
from tributary.operators.derive import derive
from tributary.plans.lattice import propose
from tributary.plans.records import Source
from tributary.plans.types import BINARY, BOOL, NULL, STRING, Field, decimal, float_, int_, struct, timestamp, uint


def source(i, *fields, meta=()):
    return Source(i, f"s{i}.parquet", "0" * 64, 1, 1, tuple(fields), tuple(meta))


def both(*sources):
    a = propose(tuple(sources))
    assert derive(tuple(sources)) == a
    return a


def joined(*types):
    return both(*[source(i, Field("x", t)) for i, t in enumerate(types)]).fields[0].type


@pytest.mark.parametrize(
    "types, want",
    [
        ((int_(8), int_(32)), int_(32)),
        ((uint(8), uint(16)), uint(16)),
        ((int_(8), uint(8)), int_(16)),
        ((int_(32), uint(32)), int_(64)),
        ((int_(8), uint(64)), decimal(20, 0)),
        ((uint(64), uint(8)), uint(64)),
        ((decimal(10, 8), decimal(10, 2)), decimal(16, 8)),
        ((decimal(10, 2), int_(64)), decimal(21, 2)),
        ((decimal(38, 20), uint(64)), decimal(40, 20)),
        ((decimal(38, 0), decimal(38, 20)), decimal(58, 20)),
        ((decimal(5, 1, wide=True), decimal(6, 2)), decimal(6, 2, wide=True)),
        ((float_(32), float_(64)), float_(64)),
        ((timestamp("ms", "UTC"), timestamp("us", "UTC")), timestamp("us", "UTC")),
        ((NULL, STRING), STRING),
        ((NULL, NULL), NULL),
        ((BOOL, BOOL), BOOL),
        ((int_(8), int_(16), uint(16)), int_(32)),
    ],
)
def test_join(types, want):
    assert joined(*types) == want
    assert joined(*reversed(types)) == want


@pytest.mark.parametrize(
    "types",
    [
        (int_(64), float_(64)),
        (decimal(4, 2), float_(32)),
        (timestamp("us", "UTC"), timestamp("us", "+00:00")),
        (timestamp("us"), timestamp("us", "UTC")),
        (BOOL, int_(8)),
        (STRING, BINARY),
        (struct(Field("a", int_(8))), int_(8)),
        (decimal(76, 0), decimal(38, 1)),
    ],
)
def test_no_join(types):
    for run in (propose, derive):
        with pytest.raises(Unsupported):
            run(tuple(source(i, Field("x", t)) for i, t in enumerate(types)))


INTS = [make(bits) for make in (int_, uint) for bits in (8, 16, 32, 64)]


def test_all_integer_unions_up_to_three():
    space = {t: (range(0, 1 << t.bits) if t.kind == "uint" else range(-(1 << t.bits - 1), 1 << t.bits - 1)) for t in INTS}
    for n in (1, 2, 3):
        for types in product(INTS, repeat=n):
            low, high = min(space[t].start for t in types), max(space[t].stop for t in types)
            fits = [t for t in INTS if space[t].start <= low and high <= space[t].stop and (t.kind == "uint") == (low == 0)]
            want = min(fits, key=lambda t: t.bits) if fits else decimal(20, 0)
            assert joined(*types) == want


def test_all_decimal_pairs():
    sizes = [(p, s) for p in (1, 2, 5, 10, 20, 37, 38, 39, 60, 76) for s in sorted({0, 1, p // 2, p})if s <= p]
    for (p, s), (q, r) in product(sizes, repeat=2):
        digits, scale = max(p - s, q - r), max(s, r)
        if digits + scale > 76:
            with pytest.raises(Unsupported):
                joined(decimal(p, s), decimal(q, r))
            continue
        got = joined(decimal(p, s), decimal(q, r))
        assert (got.precision, got.scale) == (max(1, digits + scale), scale)
        assert (got.kind == "decimal256") == (digits + scale > 38 or p > 38 or q > 38)


def test_all_timestamp_pairs():
    kinds = [timestamp(u, z) for u in ("s", "ms", "us", "ns") for z in (None, "UTC", "+00:00")]
    for a, b in product(kinds, repeat=2):
        if a.zone != b.zone:
            with pytest.raises(Unsupported):
                joined(a, b)
        else:
            assert joined(a, b) == max(a, b, key=lambda t: ("s", "ms", "us", "ns").index(t.unit))


def test_union_case():
    unit = lambda v: ((b"unit", v),)
    a = source(0, Field("z", int_(16), False), Field("rec", struct(Field("x", int_(8), True, unit(b"m")))), Field("n", NULL), meta=((b"producer", b"old"),))
    b = source(1, Field("added", int_(32), False), Field("n", int_(32)), Field("rec", struct(Field("x", int_(16), True, unit(b"cm")), Field("y", int_(32), False))), Field("z", int_(16), False), meta=((b"producer", b"new"),))
    got = both(a, b)
    assert [(f.name, f.type.kind, f.nullable) for f in got.fields] == [("added", "int", True), ("n", "int", True), ("rec", "struct", True), ("z", "int", False)]
    assert [(c.name, c.type, c.nullable, c.metadata) for c in got.fields[2].type.fields] == [("x", int_(16), True, ()), ("y", int_(32), True, ())]
    assert [(o.source_id, o.path, o.kind) for o in got.operations] == [
        (0, ("added",), "null_insert"), (0, ("n",), "null_insert"), (0, ("rec",), "struct_union"), (0, ("rec", "x"), "widen"), (0, ("rec", "y"), "null_insert"), (0, ("z",), "identity"),
        (1, ("added",), "identity"), (1, ("n",), "identity"), (1, ("rec",), "struct_union"), (1, ("rec", "x"), "identity"), (1, ("rec", "y"), "identity"), (1, ("z",), "identity"),
    ]
    assert [(c.path, c.key, c.values) for c in got.conflicts] == [((), b"producer", ((0, b"old"), (1, b"new"))), (("rec", "x"), b"unit", ((0, b"m"), (1, b"cm")))]


def test_absent_key_is_a_variant_and_absent_field_is_not():
    got = both(source(0, Field("a", int_(8), True, ((b"u", b"1"),))), source(1, Field("a", int_(8))), source(2, Field("b", int_(8))))
    assert [(c.path, c.values) for c in got.conflicts] == [(("a",), ((0, b"1"), (1, None)))]
    assert all(f.nullable for f in got.fields)


def test_three_source_absence():
    got = both(
        source(0, Field("a", struct(Field("", int_(16), False, ((b"optional", b""),))), False), Field("a.", int_(32))),
        source(1, Field("a", NULL)),
        source(2, Field("a", struct(Field("", int_(16), False))), Field("a.", int_(32))),
    )
    assert [(f.name, f.nullable) for f in got.fields] == [("a", True), ("a.", True)]
    assert got.fields[0].type.fields[0].nullable is False
    assert [(c.path, c.values) for c in got.conflicts] == [(("a", ""), ((0, b""), (2, None)))]


def test_codepoint_order_and_literal_dots():
    got = both(source(0, Field("z", int_(8)), Field("é", int_(8)), Field("A", int_(8)), Field("a", struct(Field("b", int_(8)))), Field("a.b", int_(8))))
    assert [f.name for f in got.fields] == ["A", "a", "a.b", "z", "é"]


def test_nothing_and_no_fields():
    assert both(source(0), source(1)).fields == ()
    assert [o.kind for o in both(source(0, Field("x", NULL)), source(1, Field("x", NULL))).operations] == ["identity", "identity"]
    with pytest.raises(Refusal):
        propose(())


def test_reserved_and_repeated_names():
    for bad in (lambda: Field("__pc_row", int_(8)), lambda: source(0, Field("x", int_(8)), Field("x", int_(8))), lambda: struct(Field("__pc_nested", int_(8))), lambda: Field("a\0", int_(8))):
        with pytest.raises(Refusal):
            bad()
