"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import Expr
from ..operators.join import JoinKind
from ..operators.windowed import Window
from ..types import Schema


@dataclass(frozen=True)
class AggCall(Expr):
    """An aggregate inside an expression; the binder puts a field in its place."""

    func: str
    arg: Expr | None

    def text(self) -> str:
        return f"{self.arg.text()}_{self.func}" if self.arg else f"*_{self.func}"

    def fields(self) -> set[str]:
        return self.arg.fields() if self.arg else set()


@dataclass
class Named:
    name: str


@dataclass
class Inline:
    """A connector given in place: its type, options by prefix, and schema if there is one."""

    kind: str
    options: dict[str, dict[str, str]]
    schema: Schema | None


@dataclass
class Join:
    left: object
    right: object
    on: Expr
    window: Window
    kind: JoinKind


@dataclass
class Infer:
    model: str
    source: object


@dataclass
class Select:
    #: (expression or "*", alias)
    items: list[tuple[Expr | str, str | None]]
    source: object
    where: Expr | None = None
    keys: list[str] = field(default_factory=list)
    window: Window | None = None
    having: Expr | None = None
    sinks: list[object] = field(default_factory=list)


@dataclass
class Union:
    parts: list[object]


@dataclass
class Query:
    body: object
    options: dict[str, dict[str, str]]

    @property
    def sink(self) -> object | None:
        parts = self.body.parts if isinstance(self.body, Union) else [self.body]
        found = [s for p in parts for s in getattr(p, "sinks", [])]
        return found[0] if found else None


@dataclass
class CreateLogical:
    name: str
    schema: Schema


@dataclass
class CreatePhysical:
    logical: str
    kind: str
    options: dict[str, dict[str, str]]


@dataclass
class CreateSink:
    name: str
    schema: Schema
    kind: str
    options: dict[str, dict[str, str]]


@dataclass
class CreateModel:
    name: str
    path: str
    inputs: Schema
    outputs: Schema


@dataclass
class CreateWorker:
    host: str
    options: dict[str, dict[str, str]]


@dataclass
class Drop:
    subject: str
    attribute: str
    value: str


@dataclass
class Show:
    subject: str
    attribute: str | None
    value: str | None
    format: str


@dataclass
class Explain:
    query: Query
