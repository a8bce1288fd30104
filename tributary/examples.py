"""Two small sources with drifting schemas and two metadata conflicts, to try the commands on."""

from __future__ import annotations

import argparse
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

TICK = pa.timestamp("ns", tz="UTC")


def tables() -> dict[str, pa.Table]:
    metres, centimetres = {b"unit": b"m"}, {b"unit": b"cm"}
    old = pa.schema([("device", pa.int64()), ("tick", TICK), ("payload", pa.struct([pa.field("distance", pa.int32(), metadata=metres)]))], metadata={b"producer": b"legacy"})
    new = pa.schema([("device", pa.uint64()), ("tick", TICK), ("payload", pa.struct([pa.field("distance", pa.int64(), metadata=centimetres), pa.field("status", pa.string())])), ("note", pa.string())], metadata={b"producer": b"new"})
    base = 1_700_000_000_000_000_000
    return {
        "legacy.parquet": pa.Table.from_pydict({"device": [-1, 42], "tick": pa.array([base // 1000 + 1, base // 1000 + 999], pa.int64()).cast(TICK), "payload": [None, {"distance": 3}]}, schema=old),
        "new.parquet": pa.Table.from_pydict({"device": [(1 << 64) - 1], "tick": pa.array([base // 1000 + 1001], pa.int64()).cast(TICK), "payload": [{"distance": 125, "status": "ok"}], "note": ["new sensor"]}, schema=new),
    }


def create(root: Path) -> None:
    """Writes the sources into a new directory."""
    root.mkdir()
    for name, table in tables().items():
        pq.write_table(table, root / name, version="2.6", row_group_size=2)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("destination", type=Path)
    target = parser.parse_args(argv).destination
    try:
        create(target)
    except FileExistsError:
        print(f"CONFLICT: {target} exists; nothing was changed")
        return 1
    print(f"Created legacy.parquet and new.parquet in {target}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
