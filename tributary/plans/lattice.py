"""The lattice: one target schema for all sources, by declared types only.

Types widen inside a family and nowhere else. What each source must do to reach the target
is an operation per source and path; metadata that sources disagree on is a conflict.
"""

from __future__ import annotations

from collections import defaultdict

from tributary.errors import Unsupported
from tributary.plans.records import Conflict, Operation, Proposal, Source, check_inventory
from tributary.plans.types import NULL, UNITS, Field, Pairs, Type, decimal, float_, int_, struct, timestamp, uint

FAMILIES = {"int": "number", "uint": "number", "decimal128": "number", "decimal256": "number"}


class _Planner:
    def __init__(self, sources):
        self.sources = sources
        self.conflicts: list[Conflict] = []

    def agreed(self, path: tuple[str, ...], holders: dict[int, Pairs]) -> Pairs:
        """The metadata all holders share; every other key is a conflict at `path`."""
        seen: dict[bytes, dict[int, bytes]] = defaultdict(dict)
        for source, pairs in holders.items():
            for key, value in pairs:
                seen[key][source] = value
        shared = []
        for key, by_source in seen.items():
            values = {by_source.get(source) for source in holders}
            if len(values) == 1:
                shared.append((key, values.pop()))
            else:
                self.conflicts.append(Conflict(path, key, tuple((source, by_source.get(source)) for source in holders)))
        return tuple(shared)

    def fields(self, path: tuple[str, ...], holders: dict[int, tuple[Field, ...]]) -> tuple[Field, ...]:
        """The union by exact name, in code-point order."""
        columns: dict[str, dict[int, Field]] = defaultdict(dict)
        for source, fields in holders.items():
            for f in fields:
                columns[f.name][source] = f
        out = []
        for name in sorted(columns):
            own, at = columns[name], (*path, name)
            joined = self.join(at, {s: f.type for s, f in own.items()})
            pairs = self.agreed(at, {s: f.metadata for s, f in own.items()})
            loose = len(own) < len(holders) or any(f.nullable or f.type == NULL for f in own.values())
            out.append(Field(name, joined, loose, pairs))
        return tuple(out)

    def join(self, path: tuple[str, ...], types: dict[int, Type]) -> Type:
        """The least type that holds every value of all."""
        typed = {s: t for s, t in types.items() if t != NULL}
        if not typed:
            return NULL
        families = {FAMILIES.get(t.kind, t.kind) for t in typed.values()}
        if len(families) > 1:
            raise Unsupported(f"no common type at {list(path)} for {sorted({t.kind for t in typed.values()})}")
        kinds, family = list(typed.values()), families.pop()
        if family == "struct":
            return struct(*self.fields(path, {s: t.fields for s, t in typed.items()}))
        if family == "number":
            return join_numbers(kinds)
        if family == "float":
            return float_(max(t.bits for t in kinds))
        if family == "timestamp":
            zones = {t.zone for t in kinds}
            if len(zones) > 1:
                raise Unsupported(f"timezone labels differ at {list(path)}: {sorted(map(str, zones))}")
            return timestamp(max((t.unit for t in kinds), key=UNITS.index), zones.pop())
        return kinds[0]


def domain(t: Type) -> tuple[int, int]:
    """Least and greatest value of an integer type."""
    return (0, (1 << t.bits) - 1) if t.kind == "uint" else (-(1 << t.bits - 1), (1 << t.bits - 1) - 1)


def join_numbers(types: list[Type]) -> Type:
    """Integers join to the narrowest integer over all domains, else to a decimal of enough digits."""
    whole = [domain(t) for t in types if t.kind in ("int", "uint")]
    if len(whole) == len(types):
        low, high = min(a for a, _ in whole), max(b for _, b in whole)
        for t in [make(bits) for make in ((uint,) if low == 0 else (int_,)) for bits in (8, 16, 32, 64)]:
            if domain(t)[0] <= low and high <= domain(t)[1]:
                return t
        return decimal(20, 0)
    exact = [t for t in types if t.kind.startswith("decimal")]
    digits = max([len(str(max(-a, b))) for a, b in whole] + [t.precision - t.scale for t in exact])
    scale = max(t.scale for t in exact)
    if digits + scale > 76:
        raise Unsupported(f"{digits} integer digits and {scale} decimals are more than 76 digits")
    return decimal(max(digits + scale, 1), scale, wide=any(t.kind == "decimal256" for t in exact))


def kind_of(have: Type | None, want: Type) -> str:
    if have == want:
        return "identity"
    if have is None or have == NULL:
        return "null_insert"
    return "struct_union" if have.kind == "struct" else "widen"


def operations(source: int, have: tuple[Field, ...], want: tuple[Field, ...], path: tuple[str, ...] = ()) -> list[Operation]:
    """One per target field; the subtree of a parent that is missing or null-typed is its one operation."""
    by_name = {f.name: f.type for f in have}
    out = []
    for f in want:
        own = by_name.get(f.name)
        out.append(Operation(source, (*path, f.name), own, f.type, kind_of(own, f.type)))
        if own is not None and own.kind == "struct":
            out += operations(source, own.fields, f.type.fields, (*path, f.name))
    return out


def propose(sources: tuple[Source, ...]) -> Proposal:
    """Target, operations and conflicts for sources in their given order."""
    check_inventory(sources)
    planner = _Planner(sources)
    fields = planner.fields((), {s.source_id: s.fields for s in sources})
    pairs = planner.agreed((), {s.source_id: s.schema_metadata for s in sources})
    steps = [o for s in sources for o in operations(s.source_id, s.fields, fields)]
    return Proposal(fields, pairs, tuple(sorted(steps, key=lambda o: (o.source_id, o.path))), tuple(sorted(planner.conflicts, key=lambda c: (c.path, c.key))))
