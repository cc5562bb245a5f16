"""Scalar functions: for each name a type rule and a column builder.

Comments name what differs from Spark's own function of that name.  Users add
functions with ``REGISTRY[name] = Scalar(...)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FORMAT, InvalidSyntax, StampError, TypeMismatch
from ..types import DType, as_double, convert, divide, fail, join, ordered


@dataclass(frozen=True)
class Scalar:
    infer: Callable[..., DType]
    build: Callable[..., Column]


def _arity(call, kinds, n: int) -> None:
    if len(kinds) != n:
        raise InvalidSyntax(f"{call.name} takes {n} argument{'s' * (n != 1)}")


def _numeric(call, kinds) -> None:
    if not all(k.is_numeric for k in kinds):
        raise StampError(f"{call.name} needs numbers, not {', '.join(k.name for k in kinds)}")


def _null(kinds) -> bool:
    return any(k.nullable for k in kinds)


def _promoted(call, kinds) -> DType:
    _arity(call, kinds, 2)
    _numeric(call, kinds)
    return join(*kinds)


def _arithmetic(op: Callable) -> Scalar:
    def build(call, kinds, cols):
        kind = join(*kinds)
        a, b = (convert(c, k, kind) for c, k in zip(cols, kinds))
        out = op(a, b)
        return convert(out, DType("INT64"), kind) if kind.name == "UINT32" else out

    return Scalar(_promoted, build)


def _division(remainder: bool) -> Scalar:
    def build(call, kinds, cols):
        kind = join(*kinds)
        return divide(*(convert(c, k, kind) for c, k in zip(cols, kinds)), kind, remainder)

    return Scalar(_promoted, build)


def _comparison(op: Callable, equality: bool = False) -> Scalar:
    def infer(call, kinds):
        _arity(call, kinds, 2)
        if not equality:
            _numeric(call, kinds)
        join(*kinds)
        return DType("BOOLEAN", _null(kinds))

    def build(call, kinds, cols):
        kind = join(*kinds)
        if not kind.is_numeric:
            return op(*cols)
        a, b = (convert(c, k, kind) for c, k in zip(cols, kinds))
        return op(a, b) if equality else op(ordered(a, kind), ordered(b, kind))

    return Scalar(infer, build)


def _logic(op: Callable, n: int = 2) -> Scalar:
    def infer(call, kinds):
        _arity(call, kinds, n)
        if any(k.name != "BOOLEAN" for k in kinds):
            raise StampError(f"{call.name} needs booleans")
        return DType("BOOLEAN", _null(kinds))

    return Scalar(infer, lambda call, kinds, cols: op(*cols))


def _same_type(op: Callable) -> Scalar:
    def infer(call, kinds):
        _arity(call, kinds, 1)
        _numeric(call, kinds)
        return kinds[0]

    return Scalar(infer, lambda call, kinds, cols: op(cols[0], kinds[0]))


def _to_double(n: int, op: Callable) -> Scalar:
    def infer(call, kinds):
        _arity(call, kinds, n)
        _numeric(call, kinds)
        return DType("FLOAT64", _null(kinds))

    return Scalar(infer, lambda call, kinds, cols: op(*(as_double(c, k) for c, k in zip(cols, kinds))))


def _strings(n: int, result: str, op: Callable) -> Scalar:
    def infer(call, kinds):
        _arity(call, kinds, n)
        if any(k.name not in ("VARSIZED", "CHAR") for k in kinds):
            raise TypeMismatch(f"{call.name} needs text")
        return DType(result, _null(kinds))

    return Scalar(infer, lambda call, kinds, cols: op(*cols))


#: From here on every float is whole.
_WHOLE = float(1 << 52)


def _whole(op: Callable) -> Callable:
    """Rounding keeps a float's type; integers are whole already, as are large floats, infinities and NaN (which is above all numbers here)."""
    return lambda c, k: F.when(F.abs(c) < _WHOLE, op(c.cast("double"))).otherwise(c.cast("double")).cast(k.spark) if k.is_float else c


def _floor(c: Column) -> Column:
    return F.when(c == 0, c).otherwise(F.floor(c).cast("double"))


def _ceil(c: Column) -> Column:
    # Above -1 and below 0 it is -0.0.
    return F.when(c == 0, c).otherwise(-F.floor(-c).cast("double"))


def _round(c: Column) -> Column:
    # Half away from zero, as in C; Spark's round goes by decimal digits of the printed number.
    size = F.abs(c)
    down = F.floor(size).cast("double")
    return F.signum(c) * (down + F.when(size - down >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))


def _unpacked(c: Column) -> Column:
    # What does not decode becomes empty.
    text = F.try_to_binary(c, F.lit("base64"))
    return F.when(c.isNull(), None).otherwise(F.coalesce(text.cast("string"), F.lit("")))


#: The time formats that CASTTOUNIXTS reads, as the shape of the text and Spark's pattern for it.
TIME_FORMATS = (
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:?\d\d)?$", None),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:?\d\d)?$", None),
    (r"^[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d GMT$", "EEE, dd MMM yyyy HH:mm:ss"),
)


def _unix_ms(c: Column) -> Column:
    iso = F.regexp_replace(F.regexp_replace(c, r"([+-]\d\d)(\d\d)$", "$1:$2"), " ", "T")
    rfc = F.substring(c, 6, 20)
    found = F.when(c.rlike(TIME_FORMATS[0][0]) | c.rlike(TIME_FORMATS[1][0]), F.try_to_timestamp(iso)).when(c.rlike(TIME_FORMATS[2][0]), F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss")))
    ms = F.unix_millis(found)
    return F.when(c.isNull(), None).when(ms.isNull() | (ms < 0), fail(FORMAT, "not a time since 1970").cast("long")).otherwise(ms)


def _time_part(op: Callable) -> Scalar:
    def infer(call, kinds):
        _arity(call, kinds, 1)
        if kinds[0].name != "UINT64":
            raise TypeMismatch(f"{call.name} needs UINT64 milliseconds")
        return kinds[0]

    return Scalar(infer, lambda call, kinds, cols: op(F.timestamp_millis(cols[0])).cast("long"))


def _from_unix(call, kinds):
    _arity(call, kinds, 1)
    if not kinds[0].is_integer:
        raise TypeMismatch(f"{call.name} needs milliseconds")
    return DType("VARSIZED", kinds[0].nullable)


def _cast_type(call, kinds):
    _arity(call, kinds, 1)
    have, want = kinds[0], call.target
    if want is None:
        raise InvalidSyntax(f"{call.name} needs a target type")
    if have.name != want.name and not (have.is_numeric and want.is_numeric) and not (have.name == "VARSIZED" and want.is_numeric):
        raise TypeMismatch(f"{have.name} does not cast to {want.name}")
    return want.but(have.nullable)


def _cast(call, kinds, cols):
    have, want, c = kinds[0], call.target, cols[0]
    if have.name == "VARSIZED" and want.is_numeric:
        # All but digits, signs, points and exponents goes; what does not parse then is an error.
        kept = F.regexp_replace(c, r"[^0-9.+\-eE]", "")
        value = _fitted_unsigned(kept) if want.name == "UINT64" else _fitted(kept, want)
        return F.when(c.isNull(), None).when(value.isNull(), fail(FORMAT, "not a number").cast(want.spark)).otherwise(value)
    return convert(c, have, want)


def _fitted(text: Column, want: DType) -> Column:
    if want.is_float:
        return text.cast(want.spark)
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.cast("long"))
    bits = want.bits
    low, high = (0, (1 << bits) - 1) if want.unsigned else (-(1 << bits - 1), (1 << bits - 1) - 1)
    return F.when((number >= low) & (number <= high), number).cast(want.spark)


def _fitted_unsigned(text: Column) -> Column:
    wide = F.when(text.rlike(r"^\+?\d{1,20}$"), text.cast("decimal(20,0)"))
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.when(wide < top, wide.cast("long")).when(wide < whole, (wide - whole).cast("long"))


REGISTRY: dict[str, Scalar] = {
    "ADD": _arithmetic(lambda a, b: a + b),
    "SUB": _arithmetic(lambda a, b: a - b),
    "MUL": _arithmetic(lambda a, b: a * b),
    "DIV": _division(False),
    "MOD": _division(True),
    "ABS": _same_type(lambda c, k: c if k.unsigned else F.abs(c)),
    "CEIL": _same_type(_whole(_ceil)),
    "FLOOR": _same_type(_whole(_floor)),
    "ROUND": _same_type(_whole(_round)),
    "SQRT": _to_double(1, F.sqrt),
    "POW": _to_double(2, F.pow),
    "EXP": _to_double(1, F.exp),
    "EQUALS": _comparison(lambda a, b: a == b, equality=True),
    "LESS": _comparison(lambda a, b: a < b),
    "LESSEQUALS": _comparison(lambda a, b: a <= b),
    "GREATER": _comparison(lambda a, b: a > b),
    "GREATEREQUALS": _comparison(lambda a, b: a >= b),
    "AND": _logic(lambda a, b: a & b),
    "OR": _logic(lambda a, b: a | b),
    "NEGATE": _logic(lambda a: ~a, 1),
    "ISNULL": Scalar(lambda call, kinds: _arity(call, kinds, 1) or DType("BOOLEAN", False), lambda call, kinds, cols: cols[0].isNull()),
    "CONCAT": _strings(2, "VARSIZED", F.concat),
    "CHAR_LENGTH": _strings(1, "UINT64", lambda c: F.char_length(c).cast("long")),
    "OCTET_LENGTH": _strings(1, "UINT64", lambda c: F.octet_length(c).cast("long")),
    # Without the line breaks that Spark puts in.
    "TO_BASE64": _strings(1, "VARSIZED", lambda c: F.regexp_replace(F.base64(c.cast("binary")), "\r\n", "")),
    "FROM_BASE64": _strings(1, "VARSIZED", _unpacked),
    "CASTTOTYPE": Scalar(_cast_type, _cast),
    "VARSIZEDTONUMERIC": Scalar(_cast_type, _cast),
    "CASTTOUNIXTS": _strings(1, "UINT64", _unix_ms),
    "CASTFROMUNIXTS": Scalar(_from_unix, lambda call, kinds, cols: F.date_format(F.timestamp_millis(cols[0]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
    "DAY_OF": _time_part(F.dayofmonth),
    "MONTH_OF": _time_part(F.month),
    "YEAR_OF": _time_part(F.year),
}


def function(name: str) -> Scalar:
    try:
        return REGISTRY[name.upper()]
    except KeyError:
        raise InvalidSyntax(f"no function {name}") from None
