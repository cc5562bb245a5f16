"""The engine: a catalog of sources, sinks and models, and the statements that use it."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .errors import InvalidConfig, InvalidSyntax, QueryExists, SchemaError, SinkExists, SourceExists, UnknownModel, UnknownSink, UnknownSource, UnsupportedStatement
from .operators.basic import union
from .operators.inference import Model
from .plans.relation import LAST, Relation
from .sources import read, write
from .sql import Binder, parse
from .sql import tree as t
from .streaming.runner import Ends, run, state_dir
from .types import Schema, c_semantics

Options = dict[str, dict[str, str]]


@dataclass
class _Physical:
    id: int
    logical: str
    kind: str
    options: Options


@dataclass
class _Sink:
    schema: Schema | None
    kind: str
    options: Options


@dataclass
class Running:
    """A query that was submitted: its id, its text's state, and its result."""

    id: str
    relation: Relation
    sink: _Sink | None = None
    state: str = "REGISTERED"
    #: Of a stream.
    stream: StreamingQuery | None = None


@dataclass
class Engine:
    """One session.  ``sql`` runs statements and gives the last one's result.

    With ``streaming``, files, sockets and generators are read as streams; a query with
    a sink then runs until DROP QUERY.  With ``to_end`` besides, it reads all input that is
    there, fires the windows that are left, and stops.  ``delay_ms``: how far watermarks
    stay behind the latest time.

    >>> engine = Engine(spark)
    >>> engine.sql("CREATE LOGICAL SOURCE s(ts UINT64 NOT NULL, v INT32)")
    """

    spark: SparkSession
    streaming: bool = False
    to_end: bool = False
    delay_ms: int = 0
    logical: dict[str, Schema] = field(default_factory=dict)
    physical: list[_Physical] = field(default_factory=list)
    tables: dict[str, list[Relation]] = field(default_factory=dict)
    sinks: dict[str, _Sink] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    workers: dict[str, Options] = field(default_factory=dict)
    queries: dict[str, Running] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._ids = itertools.count(1)
        self.ends = Ends(self.spark) if self.streaming and self.to_end else None

    # -- catalog by Python

    def register(self, name: str, df: DataFrame, schema: Schema | None = None) -> Relation:
        """A DataFrame as a physical source of logical source ``name``, which is made if it is new."""
        name = name.upper()
        rel = Relation.of(df, self.logical.get(name) or schema)
        self.logical.setdefault(name, rel.schema)
        self.tables.setdefault(name, []).append(rel)
        return rel

    def model(self, name: str, run, inputs: Schema, outputs: Schema) -> None:
        self.models[name.upper()] = Model(name.upper(), inputs, outputs, run=run)

    # -- statements

    def sql(self, text: str):
        """Runs all statements; queries without a sink, SHOW and EXPLAIN give DataFrame, DataFrame and text."""
        out = None
        for statement in parse(text):
            out = self.run(statement)
        return out

    def query(self, text: str) -> Relation:
        """The relation of one query, whatever its sink."""
        (statement,) = parse(text)
        if not isinstance(statement, t.Query):
            raise InvalidSyntax("not a query")
        return self._relation(statement)

    def run(self, s):
        if isinstance(s, t.CreateLogical):
            if s.name in self.logical:
                raise SourceExists(f"logical source {s.name} is there already")
            self.logical[s.name] = s.schema
        elif isinstance(s, t.CreatePhysical):
            self._logical(s.logical)
            self.physical.append(_Physical(next(self._ids), s.logical, s.kind, s.options))
        elif isinstance(s, t.CreateSink):
            if s.name in self.sinks:
                raise SinkExists(f"sink {s.name} is there already")
            self.sinks[s.name] = _Sink(s.schema, s.kind, s.options)
        elif isinstance(s, t.CreateModel):
            if not s.path.endswith(".onnx"):
                raise InvalidConfig("a model is an .onnx file")
            self.models[s.name] = Model(s.name, s.inputs, s.outputs, path=s.path)
        elif isinstance(s, t.CreateWorker):
            self.workers[s.host] = s.options  # placement is Spark's; workers are metadata only
        elif isinstance(s, t.Drop):
            self._drop(s)
        elif isinstance(s, t.Show):
            return self._show(s)
        elif isinstance(s, t.Explain):
            return self._explain(s)
        else:
            return self._submit(s)
        return None

    def _logical(self, name: str) -> Schema:
        if name not in self.logical:
            raise UnknownSource(f"no logical source {name}")
        return self.logical[name]

    def _source(self, name: str) -> Relation:
        """The union of all physical sources of a logical one."""
        schema = self._logical(name)
        parts = list(self.tables.get(name, []))
        for p in self.physical:
            if p.logical == name:
                options = {**p.options.get("INPUT_FORMATTER", {}), **p.options.get("SOURCE", {})}
                parts.append(self._read(p.kind, schema, options))
        if not parts:
            raise UnknownSource(f"logical source {name} has no physical source")
        return union(parts)

    def _inline(self, node: t.Inline) -> Relation:
        if node.schema is None:
            raise InvalidConfig("an inline source needs SCHEMA(...) AS SOURCE.SCHEMA")
        options = {**node.options.get("INPUT_FORMATTER", {}), **node.options.get("SOURCE", {})}
        return self._read(node.kind, node.schema, options)

    def _read(self, kind: str, schema: Schema, options: dict[str, str]) -> Relation:
        rel = read(self.spark, kind, schema, options, self.streaming)
        return self.ends.of(rel) if self.ends and rel.df.isStreaming else rel

    def _model(self, name: str) -> Model:
        if name not in self.models:
            raise UnknownModel(f"no model {name}")
        return self.models[name]

    def _relation(self, query: t.Query) -> Relation:
        with c_semantics(self.spark):
            return Binder(self._source, self._inline, self._model, self.delay_ms).relation(query)

    def _submit(self, query: t.Query):
        rel = self._relation(query)
        name = query.options.get("QUERY", {}).get("ID") or str(next(self._ids))
        if name in self.queries:
            raise QueryExists(f"query {name} is there already")
        sink = self._sink(query.sink, rel)
        self.queries[name] = running = Running(name, rel, sink)
        if sink is None:
            running.state = "STOPPED"
            return rel.df
        if sink.schema is not None:
            rel = _to_schema(rel, sink.schema)
        running.state = "RUNNING"
        options = {**sink.options.get("OUTPUT_FORMATTER", {}), **sink.options.get("SINK", {})}
        try:
            if rel.df.isStreaming:
                state = state_dir(self.spark, f"query-{name}")
                rel = Relation(rel.df.filter(f"not {LAST}").drop(LAST) if LAST in rel.df.columns else rel.df, rel.schema)
                start = lambda trigger: write(rel, sink.kind, options, state, trigger)
                running.stream = run(start, self.ends) if self.to_end else start({})
                running.state = "STOPPED" if self.to_end else "RUNNING"
            else:
                write(rel, sink.kind, options)
                running.state = "STOPPED"
        except Exception:
            running.state = "FAILED"
            raise
        return rel.df

    def _sink(self, node, rel: Relation) -> _Sink | None:
        if node is None:
            return None
        if isinstance(node, t.Inline):
            return _Sink(node.schema, node.kind, node.options)
        if node.name not in self.sinks:
            raise UnknownSink(f"no sink {node.name}")
        return self.sinks[node.name]

    def _drop(self, s: t.Drop) -> None:
        value = s.value
        if s.subject == "LOGICAL SOURCE" and s.attribute == "NAME":
            self._logical(value.upper() if value not in self.logical else value)
            key = value if value in self.logical else value.upper()
            del self.logical[key]
            self.tables.pop(key, None)
            self.physical = [p for p in self.physical if p.logical != key]
        elif s.subject == "PHYSICAL SOURCE" and s.attribute == "ID":
            if not any(str(p.id) == value for p in self.physical):
                raise UnknownSource(f"no physical source {value}")
            self.physical = [p for p in self.physical if str(p.id) != value]
        elif s.subject in ("SINK", "MODEL") and s.attribute == "NAME":
            kept = self.sinks if s.subject == "SINK" else self.models
            key = value if value in kept else value.upper()
            if key not in kept:
                raise (UnknownSink if s.subject == "SINK" else UnknownModel)(f"no {s.subject.lower()} {value}")
            del kept[key]
        elif s.subject == "QUERY" and s.attribute == "ID":
            if value not in self.queries:
                raise InvalidConfig(f"no query {value}")
            running = self.queries.pop(value)
            if running.stream is not None and running.stream.isActive:
                running.stream.stop()
        else:
            raise UnsupportedStatement(f"cannot drop a {s.subject.lower()} by {s.attribute}")

    def _show(self, s: t.Show) -> DataFrame:
        spell = lambda schema: ", ".join(f"{f.name} {f.type.name}{'' if f.type.nullable else ' NOT NULL'}" for f in schema.fields) if schema else ""
        if s.subject == "LOGICAL SOURCES":
            columns, rows = ["NAME", "SCHEMA"], [(n, spell(v)) for n, v in self.logical.items()]
        elif s.subject == "PHYSICAL SOURCES":
            columns = ["ID", "LOGICAL_SOURCE", "TYPE", "CONFIG"]
            rows = [(str(p.id), p.logical, p.kind, json.dumps(p.options, sort_keys=True)) for p in self.physical]
        elif s.subject == "SINKS":
            columns, rows = ["NAME", "SCHEMA", "TYPE", "CONFIG"], [(n, spell(v.schema), v.kind, json.dumps(v.options, sort_keys=True)) for n, v in self.sinks.items()]
        elif s.subject == "MODELS":
            columns, rows = ["NAME", "PATH", "INPUT", "OUTPUT"], [(n, m.path or "", spell(m.inputs), spell(m.outputs)) for n, m in self.models.items()]
        else:
            columns, rows = ["ID", "STATE"], [(q.id, _state(q)) for q in self.queries.values()]
        if s.attribute is not None:
            if s.attribute not in columns:
                raise InvalidSyntax(f"{s.subject.lower()} have no {s.attribute}")
            at = columns.index(s.attribute)
            rows = [r for r in rows if r[at] in (s.value, s.value.upper())]
        if s.format == "JSON":
            rows, columns = [(json.dumps([dict(zip(columns, r)) for r in rows]),), ], ["JSON"]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))

    def _explain(self, s: t.Explain) -> str:
        return self._relation(s.query).df._jdf.queryExecution().explainString(
            self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
        )


def _state(q: Running) -> str:
    if q.state == "RUNNING" and q.stream is not None and not q.stream.isActive:
        return "FAILED" if q.stream.exception() else "STOPPED"
    return q.state


def _to_schema(rel: Relation, schema: Schema) -> Relation:
    """``rel`` in the order of a sink's schema, whose fields it must have."""
    if {(f.name, f.type.name) for f in rel.schema.fields} != {(f.name, f.type.name) for f in schema.fields}:
        raise SchemaError("the sink's schema and the query's differ")
    for f in schema.fields:
        if rel.schema[f.name].nullable and not f.type.nullable:
            raise SchemaError(f"{f.name} may be null, but the sink's is NOT NULL")
    columns = [f"`{n}`" for n in schema.names] + [LAST] * (LAST in rel.df.columns)
    return Relation(rel.df.select(*columns), schema)
