"""Projection, selection and union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions import Expr
from ..functions import Field as FieldExpr
from ..plans.relation import LAST, Relation, ended
from ..types import Field, Schema, c_semantics

#: Stands for all fields of the input in a projection.
STAR = "*"


def project(rel: Relation, items: list[tuple[Expr | str, str | None]]) -> Relation:
    """``items``: (expression, name), or ``(STAR, None)`` for all input fields."""
    fields, columns = [], []
    with c_semantics(rel.spark):
        for expr, name in items:
            if isinstance(expr, str):
                expanded = [(FieldExpr(f), f) for f in rel.schema.names]
            else:
                expanded = [(expr, name or expr.text())]
            for e, n in expanded:
                fields.append(Field(n, e.type(rel.schema)))
                columns.append(e.column(rel.schema).alias(n))
        schema = Schema(tuple(fields))
        return Relation(rel.df.select(*ended(rel.df, columns, fields)), schema)


def filter_(rel: Relation, predicate: Expr) -> Relation:
    """Rows for which the predicate is true; null drops them."""
    kind = predicate.type(rel.schema)
    if kind.name != "BOOLEAN":
        raise SchemaError(f"a selection needs a boolean, not {kind.name}")
    with c_semantics(rel.spark):
        keep = predicate.column(rel.schema)
        return Relation(rel.df.filter(F.col(LAST) | keep if LAST in rel.df.columns else keep), rel.schema)


def union(rels: list[Relation]) -> Relation:
    """All rows of all inputs, which must have the same fields in any order."""
    first = rels[0]
    for other in rels[1:]:
        if set(other.schema.fields) != set(first.schema.fields):
            raise SchemaError("inputs of a union differ in their fields")
    return Relation(reduce(lambda a, b: a.unionByName(b), (r.df for r in rels)), first.schema)
