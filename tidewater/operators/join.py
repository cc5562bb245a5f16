"""Windowed joins: rows match if they share a window and the predicate holds, once for each window they share.

Both sides get their windows and are joined on the window's start and the
predicate's equalities, and outer joins fill nulls for each window.  A predicate
without an equality leaves the window alone as the key, and one window may hold most
rows: in an outer join, the preserved side's rows are dealt to parts by a hash, and the
other side's are copied to each part.  In an inner join only windows of many rows are
dealt, both sides to a grid, and the rows of a cell are ordered by the predicate's fields
and joined tile by tile.  The pairs, which may be as many as the square of the rows, then
come out as the same short runs of values again and again, which a columnar file holds in
a fraction of a byte, and a task's pairs are of few rows.  An inner join on one equality
or another is the union of both joins, the second without what the first has found.

On streams both sides need a watermark, which ``Engine`` adds; windows are then
Spark's own, by which it knows when an outer row has waited long enough.
"""

from __future__ import annotations

from enum import Enum

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from ..errors import InvalidSyntax, JoinError, SchemaError
from ..functions import Call, Expr
from ..plans.relation import LAST, LAST_MS, Relation
from ..types import Field, Schema, c_semantics
from .windowed import BOUND, END, START, Window, assign, event_time, spans, with_watermark


#: Rows of a tile, a multiple of the 8 values that Parquet packs together; bytes of text after which a tile ends early.
TILE, TILE_BYTES = 128, 1 << 22
#: Rows of one side of a window that stay together.
CELL = 4096


class JoinKind(Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"


def _parts(on: Expr, name: str) -> list[Expr]:
    """The operands of nested calls of AND or OR."""
    if isinstance(on, Call) and on.name.upper() == name:
        return [p for a in on.args for p in _parts(a, name)]
    return [on]


def _equates(on: Expr, left: Schema, right: Schema) -> bool:
    """Whether ``on`` has an equality between an expression of each side."""
    for p in _parts(on, "AND"):
        if isinstance(p, Call) and p.name.upper() == "EQUALS":
            a, b = (x.fields() for x in p.args)
            for x, y in ((a, b), (b, a)):
                if x and y and x <= set(left.names) and y <= set(right.names):
                    return True
    return False


def _dealt(l: DataFrame, r: DataFrame, kind: JoinKind, parts: int) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """Both sides with a further key: rows of the preserved side in one of ``parts``, those of the other in each."""
    one, each = (r, l) if kind is JoinKind.RIGHT else (l, r)
    mine, theirs = ("__rp", "__lp") if kind is JoinKind.RIGHT else ("__lp", "__rp")
    one = one.withColumn(mine, F.pmod(F.xxhash64(*(f"`{c}`" for c in one.columns)), F.lit(parts)).cast("int"))
    each = each.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (each, one) if kind is JoinKind.RIGHT else (one, each)


def _grid(l: DataFrame, r: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """Both sides with a cell as further keys, __lp and __lq, __rp and __rq: a window of many rows is cut into ``most`` by ``most`` cells at most."""
    one = F.lit(1)
    rows = l.select(F.col("__ls").alias("__w"), F.lit(1).alias("__nl"), F.lit(0).alias("__nr")).union(r.select("__rs", F.lit(0), one))
    cuts = [F.least(F.lit(most), F.greatest(one, F.ceil(F.sum(n) / CELL).cast("int"))).alias(c) for n, c in (("__nl", "__cl"), ("__nr", "__cr"))]
    # Few, as each has more than CELL rows; one table for both sides, so Spark makes it once.
    many = F.broadcast(rows.groupBy("__w").agg(*cuts).filter("__cl > 1 OR __cr > 1"))

    def side(df: DataFrame, start: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        """Each row in one of the parts of its own side, and there once for each part of the other side."""
        names = [f"`{c}`" for c in df.columns]
        mine, theirs = (F.coalesce(n, one) for n in (own[0], other[0]))
        part = F.pmod(F.xxhash64(*names), mine).cast("int").alias(own[1])
        return df.join(many, F.col(start) == F.col("__w"), "left").select(*names, part, F.explode(F.sequence(F.lit(0), theirs - 1)).alias(other[1]))

    return side(l, "__ls", ("__cl", "__lp"), ("__cr", "__lq")), side(r, "__rs", ("__cr", "__rq"), ("__cl", "__rp"))


def _tiles(df: DataFrame, schema: Schema, first: list[str], keys: list[str], name: str, parts: int) -> DataFrame:
    """One row for each tile: keys and, as ``name``, an array of its rows, which follow each other by the fields ``first``."""
    names = [f"`{n}`" for n in (*first, *(n for n in schema.names if n not in first))]
    order = Over.partitionBy(*keys).orderBy(*names)
    cuts = {"__t": F.floor((F.row_number().over(order) - 1) / TILE)}
    texts = [f"`{n}`" for n, kind in df.dtypes if n in schema and kind in ("string", "binary")]
    if texts:
        size = sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts), F.lit(0))
        cuts["__tb"] = F.floor(F.sum(size).over(order.rowsBetween(Over.unboundedPreceding, 0)) / TILE_BYTES)
    # By number, as the pairs are the work: Spark would send few bytes to few tasks.
    rows = df.repartition(min(parts, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys).withColumns(cuts)
    return rows.groupBy(*keys, *cuts).agg(F.sort_array(F.collect_list(F.struct(*names))).alias(name))


def _by_tiles(l: DataFrame, r: DataFrame, left: Schema, right: Schema, on: Expr, parts: int) -> DataFrame:  # noqa: E741
    """The inner join of rows with __ls and __rs on these and ``on``: __ls and all fields."""
    schema, both = Schema(left.fields + right.fields), []
    for p in _parts(on, "AND"):
        used = p.fields()
        if used and used <= set(left.names):
            l = l.filter(p.column(schema))  # noqa: E741
        elif used and used <= set(right.names):
            r = r.filter(p.column(schema))
        else:
            both.append(p)
    used = set().union(*(p.fields() for p in both))
    l, r = _grid(l, r, max(1, math.isqrt(parts)))  # noqa: E741
    l = _tiles(l, left, [n for n in left.names if n in used], ["__ls", "__lp", "__lq"], "__l", parts)  # noqa: E741
    r = _tiles(r, right, [n for n in right.names if n in used], ["__rs", "__rp", "__rq"], "__r", parts)
    same = (F.col("__ls") == F.col("__rs")) & (F.col("__lp") == F.col("__rp")) & (F.col("__lq") == F.col("__rq"))
    pairs = l.join(r, same).select("__ls", F.explode("__l").alias("__l"), "__r").select("__ls", "__l", F.explode("__r").alias("__r"))
    out = pairs.select("__ls", *(F.col(side)[n].alias(n) for side, s in (("__l", left), ("__r", right)) for n in s.names))
    for p in both:
        out = out.filter(p.column(schema))
    return out


def window_join(left: Relation, right: Relation, on: Expr, window: Window, kind: JoinKind = JoinKind.INNER, delay_ms: int = 0) -> Relation:
    """start, end, all left fields, all right fields; the side that may be missing becomes nullable."""
    if len(window.time) != 2:
        raise InvalidSyntax("a windowed join has two time fields")
    both = set(left.schema.names) & set(right.schema.names)
    if both:
        raise SchemaError(f"both sides have a field {', '.join(sorted(both))}")
    if {START, END} & {*left.schema.names, *right.schema.names}:
        raise SchemaError("a side has a field START or END, which the join adds")
    schema = Schema(left.schema.fields + right.schema.fields)
    if on.type(schema).name != "BOOLEAN":
        raise SchemaError("a join needs a boolean predicate")
    if kind is not JoinKind.INNER and not on.fields():
        raise JoinError("an outer join needs a predicate over fields")
    times = window.time if window.time[0] in left.schema else window.time[::-1]
    with c_semantics(left.spark):
        at = event_time(left, times[0]), event_time(right, times[1])
        streams = left.df.isStreaming, right.df.isStreaming
        if any(streams):
            if not all(streams):
                raise JoinError("a stream joins a stream")
            l, r = (spans(with_watermark(rel, t, delay_ms).drop(LAST), window, name) for rel, t, name in zip((left, right), times, ("__ls", "__rs")))  # noqa: E741
        else:
            l = assign(left.df, at[0], window.size, window.slide, "__ls", "__le").drop("__le")  # noqa: E741
            r = assign(right.df, at[1], window.size, window.slide, "__rs", "__re").drop("__re")
        same = F.col("__ls") == F.col("__rs")
        branches = _parts(on, "OR")
        if kind is JoinKind.INNER and len(branches) > 1 and all(_equates(b, left.schema, right.schema) for b in branches):
            joined, found = None, F.lit(False)
            for b in branches:
                own = b.column(schema)
                part = l.join(r, same & own & ~found, "inner")
                joined = part if joined is None else joined.union(part)
                found = found | F.coalesce(own, F.lit(False))
        else:
            key = same & on.column(schema)
            if any(streams):  # Spark's joins of streams take null keys for equal
                key = key & F.coalesce(on.column(schema), F.lit(False))
            parts = int(left.spark.conf.get("spark.sql.shuffle.partitions"))
            if any(streams) or kind is JoinKind.FULL or _equates(on, left.schema, right.schema):
                joined = l.join(r, key, kind.value)
            elif kind is JoinKind.INNER:
                joined = _by_tiles(l, r, left.schema, right.schema, on, parts)
            else:
                l, r = _dealt(l, r, kind, max(1, math.isqrt(parts)))  # noqa: E741
                joined = l.join(r, (F.col("__lp") == F.col("__rp")) & key, kind.value)
        start = {JoinKind.RIGHT: F.col("__rs"), JoinKind.FULL: F.coalesce("__ls", "__rs")}.get(kind, F.col("__ls"))
        if any(streams):
            start = F.unix_millis(start["start"])
        if any(streams):
            joined = joined.filter("coalesce(__lsb, 0) + coalesce(__rsb, 0) >= 0")
        out = joined.select(start.alias(START), (start + window.size).alias(END), *(f"`{n}`" for n in schema.names))
        if any(streams):
            out = out.filter(F.col(END) <= LAST_MS)
    may_miss = {JoinKind.LEFT: (False, True), JoinKind.RIGHT: (True, False), JoinKind.FULL: (True, True)}.get(kind, (False, False))
    fields = [Field(f.name, f.type.but(f.type.nullable or miss)) for rel, miss in zip((left, right), may_miss) for f in rel.schema.fields]
    return Relation(out, Schema((Field(START, BOUND), Field(END, BOUND), *fields)))
