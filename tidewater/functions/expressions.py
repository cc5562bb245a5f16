"""Expression trees: each node knows its declared type under a schema and its Spark column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidSyntax
from ..types import DType, Schema, dtype


class Expr:
    def type(self, schema: Schema) -> DType:
        raise NotImplementedError

    def column(self, schema: Schema) -> Column:
        raise NotImplementedError

    def text(self) -> str:
        """The name that an expression without an alias gets."""
        raise NotImplementedError

    def fields(self) -> set[str]:
        return set()

    # Python operators build calls, for use without SQL.
    def __add__(self, other): return Call("ADD", (self, other))  # noqa: E704
    def __sub__(self, other): return Call("SUB", (self, other))  # noqa: E704
    def __mul__(self, other): return Call("MUL", (self, other))  # noqa: E704
    def __truediv__(self, other): return Call("DIV", (self, other))  # noqa: E704
    def __mod__(self, other): return Call("MOD", (self, other))  # noqa: E704
    def __lt__(self, other): return Call("LESS", (self, other))  # noqa: E704
    def __le__(self, other): return Call("LESSEQUALS", (self, other))  # noqa: E704
    def __gt__(self, other): return Call("GREATER", (self, other))  # noqa: E704
    def __ge__(self, other): return Call("GREATEREQUALS", (self, other))  # noqa: E704
    def __and__(self, other): return Call("AND", (self, other))  # noqa: E704
    def __or__(self, other): return Call("OR", (self, other))  # noqa: E704
    def __invert__(self): return Call("NEGATE", (self,))  # noqa: E704
    def eq(self, other): return Call("EQUALS", (self, other))  # noqa: E704
    def ne(self, other): return ~self.eq(other)  # noqa: E704


@dataclass(frozen=True)
class Field(Expr):
    name: str

    def type(self, schema: Schema) -> DType:
        return schema[self.name]

    def column(self, schema: Schema) -> Column:
        schema[self.name]
        return F.col(f"`{self.name}`")

    def text(self) -> str:
        return self.name

    def fields(self) -> set[str]:
        return {self.name}


_RANGES = {f"INT{b}": (-(1 << b - 1), (1 << b - 1) - 1) for b in (8, 16, 32, 64)} | {f"UINT{b}": (0, (1 << b) - 1) for b in (8, 16, 32, 64)}


@dataclass(frozen=True)
class Const(Expr):
    """A literal; ``kind`` is mandatory wherever a value is needed, as the dialect has no untyped numbers."""

    value: str
    kind: DType | None

    def type(self, schema: Schema) -> DType:
        if self.kind is None:
            raise InvalidSyntax(f"constant {self.value} needs a type, such as INT32({self.value})")
        return self.kind

    def column(self, schema: Schema) -> Column:
        kind = self.type(schema)
        try:
            if kind.is_integer:
                value, (low, high) = int(self.value), _RANGES[kind.name]
                if not low <= value <= high:
                    raise ValueError
                return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast(kind.spark)
            if kind.is_float:
                return F.lit(float(self.value)).cast(kind.spark)
            if kind.name == "BOOLEAN":
                return F.lit({"true": True, "false": False}[str(self.value).lower()])
        except (ValueError, KeyError):
            raise InvalidSyntax(f"{self.value} is no {kind.name}") from None
        if kind.name == "CHAR" and len(self.value) != 1:
            raise InvalidSyntax(f"{self.value!r} is no single character")
        return F.lit(self.value)

    def text(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    #: The target of a cast.
    target: DType | None = None

    def _entry(self):
        from .scalar import function

        return function(self.name)

    def type(self, schema: Schema) -> DType:
        return self._entry().infer(self, [a.type(schema) for a in self.args])

    def column(self, schema: Schema) -> Column:
        kinds = [a.type(schema) for a in self.args]
        entry = self._entry()
        entry.infer(self, kinds)
        return entry.build(self, kinds, [a.column(schema) for a in self.args])

    def text(self) -> str:
        return f"{self.name}({', '.join(a.text() for a in self.args)})"

    def fields(self) -> set[str]:
        return set().union(*(a.fields() for a in self.args))


def field(name: str) -> Field:
    return Field(name.upper())


def const(value, kind: str) -> Const:
    return Const(str(value), dtype(kind, False))


def cast(expr: Expr, kind: str) -> Call:
    return Call("CASTTOTYPE", (expr,), dtype(kind))
