"""Event-time windows and windowed aggregation.

Windows are ``[k*slide, k*slide + size)`` for k >= 0, in milliseconds since 1970.
Aggregation over overlapping windows groups rows into panes first: a pane is as long
as the greatest common divisor of size and slide, so every window is a run of whole
panes.  Rows are then aggregated once, whatever the overlap.  Where few windows
overlap, the panes' partial results are copied into windows.  Where many do, nothing
is copied: time is cut into blocks as long as a window, so a window is the end of one
block and the beginning of the next; running results from both ends of each block
give every window in two parts, and a window is made once by each.  A block of one key
has a bounded number of panes, so no key, however frequent, meets in one task.
MEDIAN has no partial result of bounded size, so its rows are copied instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from ..errors import InvalidSyntax, SchemaError, StampError
from ..functions import Expr, cast
from ..functions import Field as FieldExpr
from ..plans.relation import LAST_MS, Relation
from ..types import DType, Field, Schema, as_double, c_semantics, convert, ordered

START, END = "START", "END"
UNITS = {"MS": 1, "SEC": 1000, "MINUTE": 60_000, "HOUR": 3_600_000, "DAY": 86_400_000}
BOUND = DType("UINT64", False)
#: The column that holds a stream's event time as a timestamp with a watermark.
WATERMARK = "__time"
#: Windows that hold a pane, from which on panes are not copied into them.
MANY = 5


@dataclass(frozen=True)
class Window:
    """``time``: fields that hold event time, one or, for a join, two; none for ingestion time."""

    time: tuple[str, ...]
    size: int
    slide: int

    def __post_init__(self) -> None:
        if self.size <= 0 or self.slide <= 0:
            raise InvalidSyntax("a window needs a positive size and advance")


def tumbling(size: int, *time: str) -> Window:
    return Window(tuple(t.upper() for t in time), size, size)


def sliding(size: int, slide: int, *time: str) -> Window:
    return Window(tuple(t.upper() for t in time), size, slide)


def starts(at: Column, size: int, slide: int) -> Column:
    """The starts of the windows that hold time ``at``, as an array; for size <= slide there is one at most."""
    first = F.when(at < size, F.lit(0).cast("long")).otherwise((F.call_function("div", at - size, F.lit(slide).cast("long")) + 1) * slide)
    last = at - at % slide
    return F.when(at.isNotNull() & (at >= 0) & (first <= last), F.sequence(first, last, F.lit(slide).cast("long")))


def event_time(rel: Relation, name: str | None) -> Column:
    """Milliseconds; without a field, the time at which rows are read."""
    if name is None:
        return F.unix_millis(F.current_timestamp())
    if not rel.schema[name].is_integer:
        raise StampError(f"{name} is no time")
    return F.col(f"`{name}`").cast("long")


def assign(df: DataFrame, at: Column, size: int, slide: int, start: str = START, end: str = END) -> DataFrame:
    """``df`` with one row for each window that holds the row's time, and the window's bounds."""
    if slide >= size:  # one window at most: no array, and the filter can move to the scan
        out = df if slide == size else df.filter(at % slide < size)
        out = out.filter(at.isNotNull() & (at >= 0)).withColumn(start, at - at % slide)
    else:
        out = df.withColumn(start, F.explode(starts(at, size, slide)))
    return out.withColumn(end, F.col(f"`{start}`") + size)


@dataclass(frozen=True)
class Aggregate:
    """``func`` over ``arg`` (None: all rows), named ``name`` or ``<field>_<func>``."""

    func: str
    arg: Expr | None = None
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.name or f"{self.arg.text() if self.arg else '*'}_{self.func}"


@dataclass(frozen=True)
class _Kind:
    """Partial results, how partial results combine, and what comes of them."""

    result: object
    partial: object
    merge: object
    final: object


def _same(kind: DType) -> DType:
    return kind


_KINDS = {
    # The sum has its argument's type and wraps in it.
    "SUM": _Kind(_same, lambda c, k: [F.sum(c.cast("double" if k.is_float else "long"))], lambda p: [F.sum(p[0])], lambda p, k: convert(p[0], DType("FLOAT64" if k.is_float else "INT64"), k)),
    "MIN": _Kind(_same, lambda c, k: [F.min(ordered(c, k))], lambda p: [F.min(p[0])], lambda p, k: ordered(p[0], k)),
    "MAX": _Kind(_same, lambda c, k: [F.max(ordered(c, k))], lambda p: [F.max(p[0])], lambda p, k: ordered(p[0], k)),
    "AVG": _Kind(lambda k: DType("FLOAT64", k.nullable), lambda c, k: [F.sum(as_double(c, k)), F.count(c)], lambda p: [F.sum(p[0]), F.sum(p[1])], lambda p, k: F.when(p[1] > 0, p[0] / p[1])),
    "COUNT": _Kind(lambda k: DType("UINT64", False), lambda c, k: [F.count(c)], lambda p: [F.sum(p[0])], lambda p, k: p[0]),
    "MEDIAN": _Kind(lambda k: DType("FLOAT64", k.nullable), lambda c, k: [F.median(as_double(c, k))], None, lambda p, k: p[0]),
}
AGGREGATES = tuple(_KINDS)


def _kinds(rel: Relation, aggs: list[Aggregate]) -> list[tuple[Aggregate, _Kind, DType]]:
    out = []
    for a in aggs:
        if a.func not in _KINDS:
            raise InvalidSyntax(f"no aggregate {a.func}")
        if a.arg is None and a.func != "COUNT":
            raise InvalidSyntax(f"{a.func} needs an argument")
        kind = a.arg.type(rel.schema) if a.arg else DType("UINT64", False)
        if a.func != "COUNT" and not kind.is_numeric:
            raise StampError(f"{a.func} needs numbers, not {kind.name}")
        out.append((a, _KINDS[a.func], kind))
    return out


def with_watermark(rel: Relation, time: str | None, delay_ms: int = 0) -> DataFrame:
    """A stream with its event time as a timestamp, ``WATERMARK``, and the watermark on it; the least over all sources governs."""
    return rel.df.withColumn(WATERMARK, F.timestamp_millis(event_time(rel, time))).withWatermark(WATERMARK, f"{delay_ms} milliseconds")


def spans(df: DataFrame, window: Window, name: str) -> DataFrame:
    """A stream's rows with watermark, once for each window that holds their time; the window is Spark's own struct ``name``."""
    gap = window.slide > window.size
    # By the column that has the watermark, so that no row is left out before the watermark has seen it.
    at = F.unix_millis(WATERMARK)
    inside = at.isNotNull() & (at >= 0)
    df = df.filter(inside & (at % window.slide < window.size) if gap else inside)
    out = df.withColumn(name, F.window(WATERMARK, f"{window.slide if gap else window.size} milliseconds", f"{window.slide} milliseconds"))
    # What Spark does not know to be the same each time it does not move selections below.
    return out.filter(F.unix_millis(F.col(f"{name}.start")) >= 0).drop(WATERMARK).withColumn(f"{name}b", F.rand())


def _aggregate_stream(rel: Relation, window: Window, keys: list[str], kinds: list, schema: Schema, delay_ms: int) -> Relation:
    """The same windows as Spark's streaming aggregation: a window comes out when the watermark has passed its end."""
    time = window.time[0] if window.time else None
    df = with_watermark(rel, time, delay_ms)
    inputs = [(F.lit(1) if a.arg is None else a.arg.column(rel.schema)).alias(f"__x{i}") for i, (a, _, _) in enumerate(kinds)]
    rows = spans(df.select(WATERMARK, *(F.col(f"`{k}`") for k in keys), *inputs), window, "__w")
    partial = [(f"__p{i}_{j}", p) for i, (_, k, t) in enumerate(kinds) for j, p in enumerate(k.partial(F.col(f"__x{i}"), t))]
    grouped = _agg(rows.groupBy("__w", *(f"`{k}`" for k in keys)), [*partial, ("__wb", F.max("__wb"))]).filter("__wb >= 0")
    start = F.unix_millis("__w.start")
    finals = [k.final([F.col(f"__p{i}_{j}") for j in range(len(k.partial(F.lit(1), t)))], t).cast(k.result(t).spark).alias(a.alias) for i, (a, k, t) in enumerate(kinds)]
    out = grouped.select(start.alias(START), (start + window.size).alias(END), *(f"`{k}`" for k in keys), *finals)
    return Relation(out.filter(F.col(END) <= LAST_MS), schema)


def window_aggregate(rel: Relation, window: Window, keys: list[str], aggs: list[Aggregate], panes: bool | None = None, delay_ms: int = 0) -> Relation:
    """One row for each window and key that has rows: start, end, keys, aggregates.

    Without aggregates, the windows and keys themselves.  ``panes``: force pane
    pre-aggregation on or off; by default it is on where windows overlap.
    ``delay_ms``: how far a stream's watermark stays behind its latest time.
    """
    if len(window.time) > 1:
        raise InvalidSyntax("an aggregation has one time field")
    kinds = _kinds(rel, aggs)
    schema = Schema((Field(START, BOUND), Field(END, BOUND), *(Field(k, rel.schema[k]) for k in keys), *(Field(a.alias, k.result(t)) for a, k, t in kinds)))
    if rel.df.isStreaming:
        with c_semantics(rel.spark):
            return _aggregate_stream(rel, window, keys, kinds, schema, delay_ms)
    splits = all(k.merge for _, k, _ in kinds)
    if panes is None:
        panes = window.slide < window.size
    panes = panes and splits and window.slide < window.size
    with c_semantics(rel.spark):
        at = event_time(rel, window.time[0] if window.time else None)
        inputs = [F.lit(1) if a.arg is None else a.arg.column(rel.schema) for a, _, _ in kinds]
        rows = rel.df.select(at.alias("__at"), *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), *(c.alias(f"__x{i}") for i, c in enumerate(inputs)))
        key_cols = [f"__k{i}" for i in range(len(keys))]
        partial = [(f"__p{i}_{j}", p) for i, (_, k, t) in enumerate(kinds) for j, p in enumerate(k.partial(F.col(f"__x{i}"), t))]
        if panes:
            step = math.gcd(window.size, window.slide)
            rows = rows.filter("__at >= 0").groupBy((F.col("__at") - F.col("__at") % step).alias("__at"), *key_cols)
            rows = _agg(rows, partial)
            partial = [(f"__p{i}_{j}", m) for i, (_, k, t) in enumerate(kinds) for j, m in enumerate(k.merge([F.col(f"__p{i}_{n}") for n in range(len(k.partial(F.lit(1), t)))]))]
        # The bounds go into names that no field has, as a field may be called START itself.
        if panes and window.size >= MANY * window.slide and partial:
            merge = lambda names: [m for i, (_, k, t) in enumerate(kinds) for m in k.merge(names[i])]
            parts = [[f"__p{i}_{n}" for n in range(len(k.partial(F.lit(1), t)))] for i, (_, k, t) in enumerate(kinds)]
            placed = _by_blocks(rows, key_cols, parts, merge, window.size, window.slide).withColumn("__end", F.col("__start") + window.size)
        else:
            placed = assign(rows, F.col("__at"), window.size, window.slide, "__start", "__end")
        grouped = _agg(placed.groupBy("__start", "__end", *key_cols), partial)
        finals = []
        for i, (a, k, t) in enumerate(kinds):
            parts = [F.col(f"__p{i}_{j}") for j in range(len(k.partial(F.lit(1), t)))]
            finals.append(k.final(parts, t).cast(k.result(t).spark).alias(a.alias))
        out = grouped.select(F.col("__start").alias(START), F.col("__end").alias(END), *(F.col(c).alias(k) for c, k in zip(key_cols, keys)), *finals)
    return Relation(out, schema)


def _aligned(low: Column, high: Column, slide: int) -> Column:
    """The multiples of ``slide`` from ``low`` (0 at least) to ``high``, as an array."""
    low = F.greatest(low, F.lit(0).cast("long"))
    first = low + F.pmod(-low, F.lit(slide).cast("long"))
    return F.when(first <= high, F.sequence(first, high, F.lit(slide).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _by_blocks(panes: DataFrame, keys: list[str], parts: list[list[str]], merge, size: int, slide: int) -> DataFrame:
    """__start and partial results of windows, each window in one part or two, from panes (__at, keys, partial results)."""
    names = [n for p in parts for n in p]
    at, block = F.col("__at"), F.col("__at") - F.col("__at") % size
    panes = panes.withColumn("__block", block)
    order = Over.partitionBy("__block", *keys).orderBy("__at")
    up = order.rowsBetween(Over.unboundedPreceding, 0)
    down = Over.partitionBy("__block", *keys).orderBy(F.desc("__at")).rowsBetween(Over.unboundedPreceding, 0)
    cols = [[F.col(n) for n in p] for p in parts]
    head = [m.over(up).alias(f"{n}h") for m, n in zip(merge(cols), names)]
    tail = [m.over(down).alias(f"{n}t") for m, n in zip(merge(cols), names)]
    panes = panes.select("__block", "__at", *keys, F.lag("__at").over(order).alias("__before"), F.lead("__at").over(order).alias("__next"), *head, *tail)
    # Windows that begin in this block, after the pane before this one: from this pane to the block's end.
    begun = _aligned(F.coalesce(F.col("__before") + 1, F.col("__block")), at, slide)
    # Windows that begin in the block before and end in this one, before the next pane: from the block's start to this pane.
    ended = _aligned(at - size + 1, F.coalesce(F.col("__next") - size, F.col("__block") - 1), slide)
    row = lambda x, end: F.struct(x.alias("__start"), *(F.col(f"{n}{end}").alias(n) for n in names))
    both = F.concat(F.transform(begun, lambda x: row(x, "t")), F.transform(ended, lambda x: row(x, "h")))
    return panes.select(*keys, F.explode(both).alias("__w")).select(*keys, "__w.*")


def _agg(grouped, partial: list[tuple[str, Column]]) -> DataFrame:
    return grouped.agg(*(p.alias(n) for n, p in partial)) if partial else grouped.agg(F.count(F.lit(1)).alias("__n"))


def check_window_names(schema: Schema) -> None:
    for name in (START, END):
        if name in schema:
            raise SchemaError(f"field {name} collides with the window's")


__all__ = ["AGGREGATES", "Aggregate", "FieldExpr", "UNITS", "Window", "assign", "cast", "sliding", "starts", "tumbling", "window_aggregate"]
