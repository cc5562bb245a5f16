"""Every operation by every pair of types, with SQL made by the rules of promotion.

The operands are a wide value X, negative for some suppliers, and a small value Y above
zero, each cast to each type.  In SQL, an integer type's values are HUGEINT numbers,
wrapped to the type after each step; UINT64 results are shown as their 64 bits.
"""

from __future__ import annotations

from .types import DType, join

INTEGERS = ("INT8", "INT16", "INT32", "INT64", "UINT8", "UINT16", "UINT32", "UINT64")
NUMBERS = (*INTEGERS, "FLOAT32", "FLOAT64")
ROWS = "(SELECT s_suppkey AS k, CASTTOTYPE(s_acctbal * FLOAT64(1000) AS INT64) AS x, CASTTOTYPE(s_nationkey AS INT64) + INT64(1) AS y FROM supplier)"
ROWS_SQL = "(SELECT s_suppkey AS k, trunc(s_acctbal * 1000)::HUGEINT AS x, (s_nationkey + 1)::HUGEINT AS y FROM supplier)"
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}
COMPARISONS = {"eq": ("=", "="), "ne": ("!=", "<>"), "lt": ("<", "<"), "le": ("<=", "<="), "gt": (">", ">"), "ge": (">=", ">=")}


def _wrapped(sql: str, kind: DType) -> str:
    """An integer's value in an integer type."""
    whole, half = 1 << kind.bits, 1 << (kind.bits - 1)
    low = 0 if kind.unsigned else half
    return f"((({sql}) + {low}) % {whole}::HUGEINT + {whole}::HUGEINT) % {whole}::HUGEINT - {low}"


def _value(sql: str, have: DType, want: DType) -> str:
    if want.is_float:
        return f"({sql})::DOUBLE{'::FLOAT' if want.name == 'FLOAT32' else ''}"
    if have.is_float:
        return _wrapped(f"trunc({sql})::HUGEINT", want)
    return sql if have.name == want.name else _wrapped(sql, want)


def _shown(sql: str, kind: DType) -> str:
    if kind.is_float:
        return f"({sql})::{'FLOAT' if kind.name == 'FLOAT32' else 'DOUBLE'}"
    stored = {"INT8": "TINYINT", "INT16": "SMALLINT", "UINT8": "SMALLINT", "INT32": "INTEGER", "UINT16": "INTEGER"}.get(kind.name, "BIGINT")
    return f"({_wrapped(sql, DType('INT64')) if kind.name == 'UINT64' else sql})::{stored}"


def _operand(name: str, kind: DType) -> str:
    return _value(name, DType("INT64"), kind)


def _pairs():
    for a in NUMBERS:
        for b in NUMBERS:
            yield DType(a), DType(b), f"{a[0]}{a.strip('UINTFLOA')}_{b[0]}{b.strip('UINTFLOA')}".lower()


def register(sql, queries: dict, oracle: dict) -> None:
    for name, op in ARITHMETIC.items():
        cols, wanted = [], []
        for a, b, column in _pairs():
            kind = join(a, b)
            if kind.is_float and name == "mod":
                continue
            x, y = _value(_operand("x", a), a, kind), _value(_operand("y", b), b, kind)
            cols.append(f"CASTTOTYPE(x AS {a.name}) {op} CASTTOTYPE(y AS {b.name}) AS {column}")
            done = f"({x}) {'//' if op == '/' and not kind.is_float else op} ({y})"
            wanted.append(f"{_shown(done if kind.is_float else _wrapped(done, kind), kind)} AS {column}")
        sql(f"fn_by_type_{name}", "supplier", f"SELECT k, {', '.join(cols)} FROM {ROWS}", f"SELECT k, {', '.join(wanted)} FROM {ROWS_SQL}")
    for name, (op, own) in COMPARISONS.items():
        cols, wanted = [], []
        for a, b, column in _pairs():
            kind = join(a, b)
            cols.append(f"CASTTOTYPE(x AS {a.name}) {op} CASTTOTYPE(y AS {b.name}) AS {column}")
            wanted.append(f"({_value(_operand('x', a), a, kind)}) {own} ({_value(_operand('y', b), b, kind)}) AS {column}")
        sql(f"fn_by_type_{name}", "supplier", f"SELECT k, {', '.join(cols)} FROM {ROWS}", f"SELECT k, {', '.join(wanted)} FROM {ROWS_SQL}")
    cols, wanted = [], []
    for a, b, column in _pairs():
        if a.is_float and not b.is_float and b.bits < 64:
            continue  # a float beyond the integer's range converts as the machine pleases
        if a.is_float and b.name == "UINT64":
            continue
        cols.append(f"CASTTOTYPE(CASTTOTYPE(x AS {a.name}) AS {b.name}) AS {column}")
        wanted.append(f"{_shown(_value(_operand('x', a), a, b), b)} AS {column}")
    sql("fn_by_type_cast", "supplier", f"SELECT k, {', '.join(cols)} FROM {ROWS}", f"SELECT k, {', '.join(wanted)} FROM {ROWS_SQL}")

    cols, wanted = [], []
    for kind in map(DType, NUMBERS):
        c, x = kind.name.lower(), _operand("x", kind)
        # The least signed value has no positive counterpart and stays.
        size = f"abs({x})" if kind.is_float else _wrapped(f"abs({x})", kind)
        small = f"CASTTOTYPE(x AS {kind.name})"
        cols += [f"ABS({small}) AS abs_{c}", f"CEIL({small}) AS ceil_{c}", f"FLOOR({small}) AS floor_{c}", f"ROUND({small}) AS round_{c}", f"SQRT(CASTTOTYPE(y AS {kind.name})) AS sqrt_{c}", f"POW(CASTTOTYPE(y AS {kind.name}), INT32(3)) AS cube_{c}"]
        wanted += [f"{_shown(size, kind)} AS abs_{c}", *(f"{_shown(x, kind)} AS {f}_{c}" for f in ("ceil", "floor", "round")), f"sqrt(y::DOUBLE) AS sqrt_{c}", f"(y * y * y)::DOUBLE AS cube_{c}"]
    sql("fn_by_type_unary", "supplier", f"SELECT k, {', '.join(cols)} FROM {ROWS}", f"SELECT k, {', '.join(wanted)} FROM {ROWS_SQL}")

    # Floats from the smallest parts to beyond 2**53, with infinities and NaN.
    wide = "(SELECT s_suppkey AS k, s_acctbal * POW(FLOAT64(2), CASTTOTYPE(s_nationkey AS FLOAT64) * FLOAT64(6) - FLOAT64(24)) AS v, FLOAT64(0) AS o FROM supplier)"
    wide_sql = "(SELECT s_suppkey AS k, s_acctbal * pow(2.0, s_nationkey * 6.0 - 24) AS v FROM supplier)"
    sql("fn_round_extremes", "supplier", f"SELECT k, CEIL(v) AS c, FLOOR(v) AS f, ROUND(v) AS r, CEIL(v / o) AS ci, FLOOR(o / o) AS fn, ROUND(v / o) AS ri, ROUND(FLOAT64(0.49999999999999994)) AS below, ROUND(FLOAT64(4503599627370497)) AS odd FROM {wide}",
        f"SELECT k, ceil(v) AS c, floor(v) AS f, round(v) AS r, CASE WHEN v > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS ci, 'nan'::DOUBLE AS fn, CASE WHEN v > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS ri, 0.0::DOUBLE AS below, 4503599627370497::DOUBLE AS odd FROM {wide_sql}")

    aggs, wanted = ["COUNT(*) AS n"], ["count(*) AS n"]
    for kind in map(DType, NUMBERS):
        c, x = kind.name.lower(), _operand("x", kind)
        total = f"sum({x})"
        aggs += [f"MIN({c}) AS min_{c}", f"MAX({c}) AS max_{c}", f"COUNT({c}) AS count_{c}"]
        wanted += [f"{_shown(f'min({x})', kind)} AS min_{c}", f"{_shown(f'max({x})', kind)} AS max_{c}", f"count(*) AS count_{c}"]
        if not kind.is_float:  # sums of floats depend on their order
            aggs += [f"SUM({c}) AS sum_{c}"]
            wanted += [f"{_shown(_wrapped(f'({total})::HUGEINT', kind), kind)} AS sum_{c}"]
            if kind.bits < 64:
                aggs += [f"AVG({c}) AS avg_{c}", f"MEDIAN({c}) AS median_{c}"]
                wanted += [f"avg(({x})::BIGINT) AS avg_{c}", f"median(({x})::BIGINT) AS median_{c}"]
    inner = f"(SELECT UINT64(1) AS t, y, {', '.join(f'CASTTOTYPE(x AS {n}) AS {n.lower()}' for n in NUMBERS)} FROM {ROWS})"
    sql("agg_by_type", "supplier", f"SELECT y, {', '.join(aggs)} FROM {inner} GROUP BY y WINDOW TUMBLING(t, SIZE 1 SEC)", f"SELECT y::BIGINT AS y, {', '.join(wanted)} FROM {ROWS_SQL} GROUP BY y")

    # Keys of different types meet in their common type.
    for a, b in (("INT8", "UINT64"), ("UINT16", "INT32"), ("INT64", "FLOAT64"), ("UINT8", "INT8")):
        left = f"(SELECT k AS lk, CASTTOTYPE(x AS {a}) AS lx, UINT64(CASE0) AS t1 FROM {ROWS})".replace("UINT64(CASE0)", "CASTTOTYPE(k * INT64(300) AS UINT64)")
        right = f"(SELECT k AS rk, CASTTOTYPE(x AS {b}) AS rx, CASTTOTYPE(k * INT64(400) AS UINT64) AS t2 FROM {ROWS})"
        kind = join(DType(a), DType(b))
        on = f"({_value(_operand('l.x', DType(a)), DType(a), kind)}) = ({_value(_operand('r.x', DType(b)), DType(b), kind)})"
        sql(f"join_by_type_{a}_{b}".lower(), "supplier", f"SELECT start, lk, rk FROM {left} JOIN {right} ON lx = rx WINDOW TUMBLING(t1, t2, SIZE 10 SEC)",
            f"SELECT l.k * 300 - l.k * 300 % 10000 AS start, l.k AS lk, r.k AS rk FROM {ROWS_SQL} l JOIN {ROWS_SQL} r ON l.k * 300 // 10000 = r.k * 400 // 10000 AND {on}")
