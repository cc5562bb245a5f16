"""Turns syntax trees into relations, given what names stand for."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import InvalidSyntax, SchemaError
from ..functions import Call, Const, Expr, Field
from ..operators.basic import STAR, filter_, project, union
from ..operators.inference import Model, infer
from ..operators.join import window_join
from ..operators.windowed import Aggregate, window_aggregate
from ..plans import Relation
from . import tree as t


class Binder:
    """``source``: name to relation; ``inline``: a connector in place to a relation; ``model``: name to model."""

    def __init__(self, source: Callable[[str], Relation], inline: Callable[[t.Inline], Relation], model: Callable[[str], Model], delay_ms: int = 0):
        self.source, self.inline, self.model, self.delay_ms = source, inline, model, delay_ms

    def relation(self, node) -> Relation:
        if isinstance(node, t.Query):
            return self.relation(node.body)
        if isinstance(node, t.Named):
            return self.source(node.name)
        if isinstance(node, t.Inline):
            return self.inline(node)
        if isinstance(node, t.Infer):
            return infer(self.relation(node.source), self.model(node.model))
        if isinstance(node, t.Union):
            return union([self.relation(p) for p in node.parts])
        if isinstance(node, t.Join):
            return window_join(self.relation(node.left), self.relation(node.right), node.on, node.window, node.kind, self.delay_ms)
        return self.select(node)

    def select(self, node: t.Select) -> Relation:
        rel = self.relation(node.source)
        if node.where is not None:
            _refuse_aggregates(node.where)
            rel = filter_(rel, node.where)
        items = node.items
        if node.window is not None:
            rel, items = self.aggregate(rel, node)
        else:
            for e, _ in items:
                if isinstance(e, Expr):
                    _refuse_aggregates(e)
        names = [n or e.text() for e, n in items if isinstance(e, Expr)]
        if len(set(names)) < len(names):
            raise SchemaError("a name is there twice")
        for e, _ in items:
            if isinstance(e, Const) and e.kind is None:
                raise InvalidSyntax(f"constant {e.value} needs a type")
        rel = project(rel, [(STAR, None) if e == "*" else (e, n) for e, n in items])
        if node.having is not None:
            rel = filter_(rel, node.having)
        return rel

    def aggregate(self, rel: Relation, node: t.Select) -> tuple[Relation, list]:
        """The windowed aggregation below a projection, and the projection's items over its result."""
        aggs: dict[str, Aggregate] = {}

        def replaced(e: Expr) -> Expr:
            if isinstance(e, t.AggCall):
                name = e.text()
                aggs.setdefault(name, Aggregate(e.func, e.arg, name))
                return Field(name)
            if isinstance(e, Call):
                return Call(e.name, tuple(map(replaced, e.args)), e.target)
            return e

        items = [(e, n) if e == "*" else (replaced(e), n or e.text()) for e, n in node.items]
        out = window_aggregate(rel, node.window, node.keys, list(aggs.values()), delay_ms=self.delay_ms)
        return out, items


def _refuse_aggregates(e: Expr) -> None:
    if isinstance(e, t.AggCall):
        raise InvalidSyntax(f"{e.func} needs a window")
    for a in getattr(e, "args", ()):
        _refuse_aggregates(a)
