"""Declared types, how C++ would promote them, and how Spark holds them.

Unsigned types narrower than 64 bits live in the next wider signed Spark type.
``UINT64`` lives in a ``LongType`` with the same 64 bits: sums and products wrap as
they should, and whatever depends on order or size goes through the helpers here.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ARITHMETIC, SchemaError, TypeMismatch, UnknownField, UnknownType

_BITS = {"INT8": 8, "INT16": 16, "INT32": 32, "INT64": 64, "UINT8": 8, "UINT16": 16, "UINT32": 32, "UINT64": 64, "FLOAT32": 32, "FLOAT64": 64}
_SPARK = {
    "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.LongType(),
    "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "BOOLEAN": T.BooleanType(), "CHAR": T.StringType(), "VARSIZED": T.StringType(),
}
#: SQL spellings.
_ALIASES = {"TINYINT": "INT8", "SMALLINT": "INT16", "INT": "INT32", "INTEGER": "INT32", "BIGINT": "INT64", "FLOAT": "FLOAT32", "DOUBLE": "FLOAT64", "BOOL": "BOOLEAN", "TEXT": "VARSIZED"}

TWO32, TWO64, LOW = 1 << 32, float(1 << 64), -(1 << 63)


@dataclass(frozen=True)
class DType:
    name: str
    nullable: bool = True

    @property
    def bits(self) -> int:
        return _BITS.get(self.name, 0)

    @property
    def is_float(self) -> bool:
        return self.name.startswith("FLOAT")

    @property
    def is_integer(self) -> bool:
        return self.name in _BITS and not self.is_float

    @property
    def is_numeric(self) -> bool:
        return self.name in _BITS

    @property
    def unsigned(self) -> bool:
        return self.name.startswith("U")

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.name]

    def but(self, nullable: bool) -> DType:
        return replace(self, nullable=nullable)


def dtype(name: str, nullable: bool = True) -> DType:
    """A type by its SQL spelling: ``INT UNSIGNED``, ``UINT32``, ``VARSIZED`` and so on."""
    words = name.upper().split()
    base = _ALIASES.get(words[0], words[0])
    if words[1:] == ["UNSIGNED"]:
        base = f"U{base}"
    elif words[1:]:
        raise UnknownType(f"no type {name}")
    if base not in _SPARK:
        raise UnknownType(f"no type {name}")
    return DType(base, nullable)


def of_spark(kind: T.DataType, nullable: bool = True) -> DType:
    """The declared type that a Spark type stands for when none is given."""
    for name in ("INT8", "INT16", "INT32", "INT64", "FLOAT32", "FLOAT64", "BOOLEAN", "VARSIZED"):
        if _SPARK[name] == kind:
            return DType(name, nullable)
    raise UnknownType(f"{kind.simpleString()} has no counterpart")


def join(a: DType, b: DType) -> DType:
    """The type in which both operands of an operation meet."""
    null = a.nullable or b.nullable
    if not (a.is_numeric and b.is_numeric):
        if a.name == b.name:
            return a.but(null)
        raise TypeMismatch(f"{a.name} and {b.name} have no common type")
    if a.is_float and b.is_float:
        return DType("FLOAT64" if 64 in (a.bits, b.bits) else "FLOAT32", null)
    if a.is_float or b.is_float:
        return (a if a.is_float else b).but(null)
    if max(a.bits, b.bits) < 32:
        return DType("INT32", null)
    if a.bits == b.bits:
        return DType(f"{'' if not (a.unsigned or b.unsigned) else 'U'}INT{a.bits}", null)
    return (a if a.bits > b.bits else b).but(null)


def _signed(c: Column, bits: int) -> Column:
    half = 1 << (bits - 1)
    return F.pmod(c.cast("long") + half, F.lit(1 << bits)) - half


def convert(c: Column, have: DType, want: DType) -> Column:
    """A conversion between numeric types as C does it: modulo for integers, truncation of floats."""
    if have.name == want.name:
        return c
    if want.is_float:
        value = as_double(c, have) if have.name == "UINT64" else c
        out = value.cast(want.spark)
        # The product keeps Spark from leaving FLOAT32 out where a wider float follows.
        return out * F.lit(1.0).cast(want.spark) if want.name == "FLOAT32" and have.bits >= 32 and have.is_integer else out
    if not (have.is_numeric and want.is_numeric):
        raise TypeMismatch(f"{have.name} does not convert to {want.name}")
    c = c.cast("long")
    if want.bits == 64 or have.is_integer and have.bits < want.bits and not (want.unsigned and not have.unsigned):
        return c.cast(want.spark)
    if want.unsigned:
        return F.pmod(c, F.lit(1 << want.bits)).cast(want.spark)
    return _signed(c, want.bits).cast(want.spark)


def as_double(c: Column, have: DType) -> Column:
    if have.name == "UINT64":
        return F.when(c < 0, c.cast("double") + TWO64).otherwise(c.cast("double"))
    return c.cast("double")


def as_decimal(c: Column, have: DType) -> Column:
    """An integer's value as DECIMAL(20,0)."""
    wide = c.cast("decimal(20,0)")
    if have.name != "UINT64":
        return wide
    return F.when(c < 0, (wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def from_decimal(c: Column) -> Column:
    """The 64 bits of a non-negative decimal below 2**64."""
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(c >= top, (c - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("long")).otherwise(c.cast("long"))


def ordered(c: Column, have: DType) -> Column:
    """A column that sorts as the declared type does."""
    return c.bitwiseXOR(F.lit(LOW)) if have.name == "UINT64" else c


def fail(code: int, message: str) -> Column:
    return F.raise_error(F.lit(f"{message} (error {code})"))


def divide(a: Column, b: Column, kind: DType, remainder: bool = False) -> Column:
    """Division or remainder of two columns that already have type ``kind``."""
    if kind.is_float:
        if remainder:
            return F.when(b == 0, F.lit(float("nan"))).otherwise(a % b).cast(kind.spark)
        at_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
        return F.when(a.isNull() | b.isNull(), None).when(b == 0, at_zero).otherwise(a / b).cast(kind.spark)
    whole = a % b if remainder else F.call_function("div", a, b)
    if kind.name == "UINT64":
        x, y = as_decimal(a, kind), as_decimal(b, kind)
        wide = from_decimal((x % y if remainder else F.call_function("div", x, y).cast("decimal(20,0)")).cast("decimal(20,0)"))
        whole = F.when((a >= 0) & (b > 0), whole).otherwise(wide)
    safe = F.when(b == 0, fail(ARITHMETIC, "division by zero").cast("long")).otherwise(whole.cast("long"))
    return convert(safe, DType("INT64"), kind)


@dataclass(frozen=True)
class Field:
    name: str
    type: DType


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for f in self.fields:
            if f.name in seen:
                raise SchemaError(f"field {f.name} is there twice")
            seen.add(f.name)

    @classmethod
    def of(cls, **fields: str) -> Schema:
        """``Schema.of(ts="UINT64 NOT NULL", name="VARSIZED")``; names are upper-cased as unquoted ones are."""
        return cls(tuple(Field(k.upper(), declared(v)) for k, v in fields.items()))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __getitem__(self, name: str) -> DType:
        for f in self.fields:
            if f.name == name:
                return f.type
        raise UnknownField(f"no field {name} among {', '.join(self.names)}")

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark, f.type.nullable, {"declared": f.type.name}) for f in self.fields])


def declared(text: str) -> DType:
    words = text.upper().split()
    not_null = words[-2:] == ["NOT", "NULL"]
    return dtype(" ".join(words[:-2] if not_null else words), not not_null)


@contextmanager
def c_semantics(spark: SparkSession):
    """Integer operators wrap, and times are UTC, in all that is analysed inside; the session's own settings stay.

    Spark fixes both when it analyses an expression, so queries built here keep them.
    """
    wanted = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
