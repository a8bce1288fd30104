"""Expressions that never change a value silently."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tributary.plans.types import Type, UNITS, wide

TICKS = (-(1 << 63), (1 << 63) - 1)


def factor(have: Type, want: Type) -> int:
    """Ticks of `want` in one tick of `have`."""
    return 1000 ** (UNITS.index(want.unit) - UNITS.index(have.unit))


def tick_bounds(times: int) -> tuple[int, int]:
    """Ticks that stay within 64 bits when multiplied."""
    return -(-TICKS[0] // times), TICKS[1] // times


def same_float(a: Column, b: Column) -> Column:
    """Equal as observed: all NaNs are one value, the sign of zero counts, null equals null."""
    negative = lambda c: F.startswith(c.cast("string"), F.lit("-"))
    return a.eqNullSafe(b) & (F.coalesce(a != 0, F.lit(True)) | (negative(a) == negative(b)))


def decimal_text(column: Column, t: Type, scale: int) -> Column:
    """Plain decimal text of an exact number with `scale` decimals; equal numbers give equal text."""
    if wide(t):
        text, own = from_twos_complement(t.scale)(column), t.scale
    else:
        text, own = column.cast("string"), t.scale if t.kind.startswith("decimal") else 0
    if scale == own:
        return text
    return F.concat(text, F.lit(("." if own == 0 else "") + "0" * (scale - own)))


def from_twos_complement(scale: int):
    """Decimal text of big-endian two's-complement bytes: Arrow batches, for decimals above 38 digits only."""

    @F.arrow_udf(S.StringType())
    def text(raw: pa.Array) -> pa.Array:
        out = []
        for value in raw.to_pylist():
            if value is None:
                out.append(None)
                continue
            n = int.from_bytes(value, "big", signed=True)
            digits = str(abs(n)).rjust(scale + 1, "0")
            out.append(("-" if n < 0 else "") + (digits[:-scale] + "." + digits[-scale:] if scale else digits))
        return pa.array(out, pa.string())

    return text
