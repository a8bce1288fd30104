"""The schema a second time: derived for verification without the planner.

Shares no code with the lattice, the alignment or the feasibility scan. It works on a flat
table of (path, source) entries, level by level, where the planner recurses over fields.
"""

from __future__ import annotations

from tributary.errors import Unsupported
from tributary.plans.records import Conflict, Operation, Proposal, Source
from tributary.plans.types import Field, Type

ORDER = {"s": 0, "ms": 1, "us": 2, "ns": 3}


def _entries(sources: tuple[Source, ...]) -> dict[tuple[str, ...], dict[int, Field]]:
    """Every declared field by path, breadth first; nothing below fields that aren't structs."""
    table: dict[tuple[str, ...], dict[int, Field]] = {}
    level = [((f.name,), s.source_id, f) for s in sources for f in s.fields]
    while level:
        below = []
        for path, source, f in level:
            table.setdefault(path, {})[source] = f
            if f.type.kind == "struct":
                below += [((*path, c.name), source, c) for c in f.type.fields]
        level = below
    return table


def _integers(t: Type) -> range:
    """The values of an integer type."""
    half = 2 ** (t.args[0] - 1)
    return range(0, 2 * half) if t.kind == "uint" else range(-half, half)


def _scalar(path: tuple[str, ...], types: list[Type]) -> Type:
    kinds = {t.kind for t in types}
    if kinds <= {"int", "uint"}:
        low, high = min(_integers(t).start for t in types), max(_integers(t).stop for t in types)
        for bits in (8, 16, 32, 64):
            for kind in ("uint", "int"):
                space = _integers(Type(kind, (bits,)))
                if (kind == "uint") == (low == 0) and space.start <= low and high <= space.stop:
                    return Type(kind, (bits,))
        return Type("decimal128", (20, 0))
    if kinds <= {"int", "uint", "decimal128", "decimal256"}:
        before = after = 0
        for t in types:
            if t.kind in ("int", "uint"):
                space = _integers(t)
                before = max(before, len(str(abs(space.start))), len(str(space.stop - 1)))
            else:
                before, after = max(before, t.args[0] - t.args[1]), max(after, t.args[1])
        total = before + after or 1
        if total > 76:
            raise Unsupported(f"{total} digits at {list(path)}")
        return Type("decimal256" if total > 38 or "decimal256" in kinds else "decimal128", (total, after))
    if kinds == {"float"}:
        return Type("float", (64 if any(t.args[0] == 64 for t in types) else 32,))
    if kinds == {"timestamp"} and len({t.args[1] for t in types}) == 1:
        return Type("timestamp", (sorted((t.args[0] for t in types), key=ORDER.get)[-1], types[0].args[1]))
    if len(kinds) == 1 and len(set(types)) == 1:
        return types[0]
    raise Unsupported(f"types differ at {list(path)}: {sorted(kinds)}")


def _metadata(path, holders: list[tuple[int, tuple]], conflicts: list[Conflict]) -> tuple:
    """Pairs that all holders have; a conflict for each other key."""
    common = set.intersection(*[set(pairs) for _, pairs in holders])
    agreed = {k for k, _ in common}
    for key in sorted({k for _, pairs in holders for k, _ in pairs} - agreed):
        conflicts.append(Conflict(path, key, tuple((s, dict(pairs).get(key)) for s, pairs in holders)))
    return tuple(common)


def derive(sources: tuple[Source, ...]) -> Proposal:
    """The proposal that the sources imply."""
    table = _entries(sources)
    conflicts: list[Conflict] = []
    built: dict[tuple[str, ...], Field] = {}
    # the deepest first, so that a struct's children are there when it is built
    for path in sorted(table, key=len, reverse=True):
        own = table[path]
        if len(path) == 1:
            parents = {s.source_id for s in sources}
        else:
            parents = {s for s, f in table[path[:-1]].items() if f.type.kind == "struct"}
        typed = [f.type for _, f in sorted(own.items()) if f.type.kind != "null"]
        if not typed:
            target = Type("null")
        elif any(t.kind == "struct" for t in typed):
            if any(t.kind != "struct" for t in typed):
                raise Unsupported(f"a struct and another type at {list(path)}")
            below = sorted(p for p in built if len(p) == len(path) + 1 and p[:-1] == path)
            target = Type("struct", (tuple(built[p] for p in below),))
        else:
            target = _scalar(path, typed)
        loose = parents != set(own) or any(f.nullable or f.type.kind == "null" for f in own.values())
        built[path] = Field(path[-1], target, loose, _metadata(path, [(s, f.metadata) for s, f in sorted(own.items())], conflicts))
    columns = tuple(built[p] for p in sorted(p for p in built if len(p) == 1))
    pairs = _metadata((), [(s.source_id, s.schema_metadata) for s in sources], conflicts)
    steps = []
    for source in sources:
        for path in sorted(built):
            own = table[path].get(source.source_id)
            above = table[path[:-1]].get(source.source_id) if len(path) > 1 else None
            if len(path) > 1 and (above is None or above.type.kind != "struct"):
                continue
            have, want = own and own.type, built[path].type
            if have == want:
                kind = "identity"
            elif have is None or have.kind == "null":
                kind = "null_insert"
            else:
                kind = "struct_union" if have.kind == "struct" else "widen"
            steps.append(Operation(source.source_id, path, have, want, kind))
    return Proposal(columns, pairs, tuple(sorted(steps, key=lambda o: (o.source_id, o.path))), tuple(sorted(conflicts, key=lambda c: (c.path, c.key))))
