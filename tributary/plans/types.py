"""Types and fields of sources and targets, and their Arrow, Spark and JSON forms."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as S

from tributary.errors import LimitExceeded, Refusal, Unsupported
from tributary.plans.documents import check_int, check_keys, check_list, check_text, from_base64, to_base64

RESERVED = "__pc_"
SOURCE, ROW = "__pc_source", "__pc_row"
UNITS = ("s", "ms", "us", "ns")
#: The parameters of each kind of type, as documents name them.
PARAMETERS = {
    "null": (), "bool": (), "string": (), "binary": (),
    "int": ("bit_width",), "uint": ("bit_width",), "float": ("bit_width",),
    "decimal128": ("precision", "scale"), "decimal256": ("precision", "scale"),
    "timestamp": ("unit", "timezone"), "struct": ("fields",),
}

Pairs = tuple[tuple[bytes, bytes], ...]


@dataclass(frozen=True)
class Type:
    """A kind with its parameters in the order of PARAMETERS. Struct equality includes children's nullability and metadata."""

    kind: str
    args: tuple = ()

    def __post_init__(self):
        if self.kind not in PARAMETERS or len(self.args) != len(PARAMETERS[self.kind]):
            raise Refusal(f"no type {self.kind!r} with parameters {self.args!r}")
        if self.kind in ("int", "uint") and self.args[0] not in (8, 16, 32, 64) or self.kind == "float" and self.args[0] not in (32, 64):
            raise Refusal(f"no {self.kind} of {self.args[0]} bits")
        if self.kind.startswith("decimal"):
            check_int(self.precision, "precision", 1, 38 if self.kind == "decimal128" else 76)
            check_int(self.scale, "scale", 0, self.precision)
        if self.kind == "timestamp":
            if self.unit not in UNITS:
                raise Refusal(f"no timestamp unit {self.unit!r}")
            if self.zone is not None and not check_text(self.zone, "timezone"):
                raise Refusal("an empty timezone label")
        if self.kind == "struct":
            distinct_names(self.fields)

    bits = property(lambda self: self.args[0])
    precision = property(lambda self: self.args[0])
    scale = property(lambda self: self.args[1])
    unit = property(lambda self: self.args[0])
    zone = property(lambda self: self.args[1])
    fields = property(lambda self: self.args[0])

    @property
    def label(self) -> str:
        """As reports show it."""
        if self.kind in ("int", "uint", "float"):
            return f"{self.kind}{self.bits}"
        if self.kind.startswith("decimal"):
            return f"{self.kind}({self.precision},{self.scale})"
        if self.kind == "timestamp":
            return f"timestamp({self.unit}{',' + self.zone if self.zone else ''})"
        return self.kind

    def to_json(self) -> dict:
        values = [[f.to_json() for f in a] if name == "fields" else a for name, a in zip(PARAMETERS[self.kind], self.args)]
        return {"kind": self.kind, **dict(zip(PARAMETERS[self.kind], values))}

    @staticmethod
    def from_json(value: Any) -> Type:
        kind = value.get("kind") if type(value) is dict else None
        if type(kind) is not str or kind not in PARAMETERS:
            raise Refusal(f"no type {kind!r}")
        names = PARAMETERS[kind]
        check_keys(value, ("kind", *names), f"a type of kind {kind}")
        for name in names:
            if name in ("bit_width", "precision", "scale"):
                check_int(value[name], name)
        return Type(kind, tuple(tuple(Field.from_json(f) for f in check_list(value[n], n)) if n == "fields" else value[n] for n in names))


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    nullable: bool = True
    metadata: Pairs = ()

    def __post_init__(self):
        if check_text(self.name, "field name").startswith(RESERVED):
            raise Refusal(f"the name {self.name!r} is reserved")
        if type(self.nullable) is not bool:
            raise Refusal("nullable must be a boolean")
        object.__setattr__(self, "metadata", sorted_pairs(self.metadata))

    def to_json(self) -> dict:
        return {"name": self.name, "type": self.type.to_json(), "nullable": self.nullable, "metadata": pairs_to_json(self.metadata)}

    @staticmethod
    def from_json(value: Any) -> Field:
        check_keys(value, ("name", "type", "nullable", "metadata"), "a field")
        return Field(value["name"], Type.from_json(value["type"]), value["nullable"], pairs_from_json(value["metadata"]))


NULL, BOOL, STRING, BINARY = Type("null"), Type("bool"), Type("string"), Type("binary")


def int_(bits: int) -> Type:
    return Type("int", (bits,))


def uint(bits: int) -> Type:
    return Type("uint", (bits,))


def float_(bits: int) -> Type:
    return Type("float", (bits,))


def decimal(precision: int, scale: int, wide: bool = False) -> Type:
    return Type("decimal256" if wide or precision > 38 else "decimal128", (precision, scale))


def timestamp(unit: str, zone: str | None = None) -> Type:
    return Type("timestamp", (unit, zone))


def struct(*fields: Field) -> Type:
    return Type("struct", (tuple(fields),))


def distinct_names(fields) -> tuple[Field, ...]:
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise Refusal(f"a field name is repeated: {sorted(n for n in set(names) if names.count(n) > 1)[0]!r}")
    return tuple(fields)


def sorted_pairs(pairs) -> Pairs:
    pairs = tuple(sorted((bytes(k), bytes(v)) for k, v in pairs))
    if len({k for k, _ in pairs}) < len(pairs):
        raise Refusal("a metadata key is repeated")
    return pairs


def pairs_to_json(pairs: Pairs) -> list:
    return [[to_base64(k), to_base64(v)] for k, v in pairs]


def pairs_from_json(value: Any) -> Pairs:
    for pair in check_list(value, "metadata"):
        if type(pair) is not list or len(pair) != 2:
            raise Refusal("metadata must be pairs")
    return sorted_pairs((from_base64(k), from_base64(v)) for k, v in value)


def schema_size(fields, pairs: Pairs = ()) -> tuple[int, int, int]:
    """(fields at all levels, struct levels, metadata bytes)."""
    count, depth, size = len(fields), 0, sum(len(k) + len(v) for k, v in pairs)
    for f in fields:
        c, d, s = schema_size(f.type.fields, f.metadata) if f.type.kind == "struct" else (0, -1, schema_size((), f.metadata)[2])
        count, depth, size = count + c, max(depth, d + 1), size + s
    return count, depth, size


# Arrow


def from_arrow(t: pa.DataType, level: int = 0) -> Type:
    """The type of an Arrow type; whatever the lattice doesn't know is refused."""
    p = pa.types
    if isinstance(t, pa.BaseExtensionType):
        raise Unsupported(f"extension type {t}")
    for test, made in ((p.is_null, NULL), (p.is_boolean, BOOL), (p.is_string, STRING), (p.is_binary, BINARY)):
        if test(t):
            return made
    if p.is_signed_integer(t):
        return int_(t.bit_width)
    if p.is_unsigned_integer(t):
        return uint(t.bit_width)
    if p.is_floating(t) and t.bit_width >= 32:
        return float_(t.bit_width)
    if (p.is_decimal128(t) or p.is_decimal256(t)) and 0 <= t.scale <= t.precision:
        return decimal(t.precision, t.scale, wide=p.is_decimal256(t))
    if p.is_timestamp(t):
        return timestamp(t.unit, t.tz)
    if p.is_struct(t):
        if level >= 8:
            raise LimitExceeded("structs are nested deeper than 8 levels")
        return struct(*[field_from_arrow(t.field(i), level + 1) for i in range(t.num_fields)])
    raise Unsupported(f"type {t}")


def field_from_arrow(f: pa.Field, level: int = 0) -> Field:
    pairs = dict(f.metadata or {})
    if any(k.startswith(b"ARROW:extension:") for k in pairs):
        raise Unsupported(f"field {f.name!r} is tagged as an extension type")
    return Field(f.name, from_arrow(f.type, level), f.nullable, tuple(pairs.items()))


def to_arrow(t: Type) -> pa.DataType:
    if t.kind in ("int", "uint", "float"):
        return pa.type_for_alias(t.label if t.kind != "float" else {32: "float32", 64: "float64"}[t.bits])
    if t.kind.startswith("decimal"):
        return (pa.decimal128 if t.kind == "decimal128" else pa.decimal256)(t.precision, t.scale)
    if t.kind == "timestamp":
        return pa.timestamp(t.unit, tz=t.zone)
    if t.kind == "struct":
        return pa.struct([field_to_arrow(f) for f in t.fields])
    return {"null": pa.null(), "bool": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[t.kind]


def field_to_arrow(f: Field) -> pa.Field:
    return pa.field(f.name, to_arrow(f.type), nullable=f.nullable, metadata=dict(f.metadata) or None)


def schema_to_arrow(fields, pairs: Pairs = ()) -> pa.Schema:
    return pa.schema([field_to_arrow(f) for f in fields], metadata=dict(pairs) or None)


# Spark


def wide(t: Type) -> bool:
    """Decimals that Spark's 38 digits can't hold."""
    return t.kind == "decimal256" and t.precision > 38


def to_spark(t: Type) -> S.DataType:
    """The type that values of `t` have inside the engine.

    Unsigned integers are in the next wider signed type, timestamps are ticks, decimals above 38
    digits are plain decimal text at their scale, all-null columns are booleans.
    """
    if t.kind == "int":
        return {8: S.ByteType(), 16: S.ShortType(), 32: S.IntegerType(), 64: S.LongType()}[t.bits]
    if t.kind == "uint":
        return {8: S.ShortType(), 16: S.IntegerType(), 32: S.LongType(), 64: S.DecimalType(20, 0)}[t.bits]
    if t.kind == "float":
        return S.FloatType() if t.bits == 32 else S.DoubleType()
    if t.kind.startswith("decimal"):
        return S.StringType() if wide(t) else S.DecimalType(t.precision, t.scale)
    if t.kind == "timestamp":
        return S.LongType()
    if t.kind == "struct":
        return S.StructType([S.StructField(f.name, to_spark(f.type), True) for f in t.fields])
    return {"null": S.BooleanType(), "bool": S.BooleanType(), "string": S.StringType(), "binary": S.BinaryType()}[t.kind]


def to_scan(t: Type) -> S.DataType:
    """The type to read a Parquet column of `t` as; columns of kind null aren't read."""
    if wide(t):
        return S.BinaryType()  # big-endian two's complement
    if t.kind == "struct":
        return S.StructType([S.StructField(f.name, to_scan(f.type), True) for f in t.fields if readable(f.type)])
    return to_spark(t)


def readable(t: Type) -> bool:
    """Whether Parquet stores a column that tells null from not null: a struct needs one readable child."""
    return t.kind != "null" and (t.kind != "struct" or any(readable(f.type) for f in t.fields))
