"""Sinks: files, standard output, nothing, and a checksum of the CSV text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, UnknownSinkKind
from ..plans import Relation
from ..types import DType, as_decimal

Options = dict[str, str]


def text_of(c: Column, kind: DType, quote: bool = False) -> Column:
    """A value as CSV text: floats with six decimals, trailing zeros cut but one; null as NULL."""
    if kind.is_float:
        fixed = F.format_string("%.6f", c.cast("double"))
        out = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
        out = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(out)
    elif kind.name == "UINT64":
        out = as_decimal(c, kind).cast("string")
    elif kind.name in ("VARSIZED", "CHAR") and quote:
        out = F.concat(F.lit('"'), c, F.lit('"'))
    else:
        out = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), out), F.lit("NULL"))


def csv_lines(rel: Relation, options: Options | None = None) -> DataFrame:
    """One column ``value``: a line for each row."""
    options = options or {}
    quote = options.get("QUOTE_STRINGS", "false").lower() == "true"
    cells = [text_of(F.col(f"`{f.name}`"), f.type, quote) for f in rel.schema.fields]
    return rel.df.select(F.concat_ws(options.get("FIELD_DELIMITER", ","), *cells).alias("value"))


def json_lines(rel: Relation) -> DataFrame:
    cells = [(as_decimal(F.col(f"`{f.name}`"), f.type) if f.type.name == "UINT64" else F.col(f"`{f.name}`")).alias(f.name) for f in rel.schema.fields]
    return rel.df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def checksum(rel: Relation) -> DataFrame:
    """count, checksum: rows, and the sum of all bytes of their CSV lines, newlines included, as signed chars.

    The bytes' hexadecimal digits are summed by counting each of the sixteen: no row leaves the JVM.
    """
    text = csv_lines(rel).select(F.hex(F.concat("value", F.lit("\n")).cast("binary")).alias("h"))
    halves = text.select(F.regexp_replace("h", "(.).", "$1").alias("high"), F.regexp_replace("h", ".(.)", "$1").alias("low"))
    total = F.lit(0).cast("long")
    for k, digit in enumerate("0123456789ABCDEF"):
        times = lambda c, d=digit: F.length(c) - F.length(F.replace(F.col(c), F.lit(d), F.lit("")))
        total = total + times("low") * k + times("high") * (16 * k if k < 8 else 16 * k - 256)
    lines = halves.select(total.alias("b"))
    return lines.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("b"), F.lit(0)).alias("checksum"))


def _known(options: Options, *names: str) -> None:
    """An option that the sink does not have is an error."""
    if unknown := set(options) - {*names, "OUTPUT_FORMAT", "TYPE", "FIELD_DELIMITER", "TUPLE_DELIMITER", "QUOTE_STRINGS", "ADD_TIMESTAMP", "TRIGGER"}:
        raise InvalidConfig(f"a sink has no option {', '.join(sorted(unknown))}")


def _format(options: Options, *kinds: str) -> str:
    kind = options.get("OUTPUT_FORMAT", options.get("TYPE", "CSV")).upper()
    if kind not in kinds:
        raise InvalidConfig(f"no output format {kind}")
    return kind


def _stamped(rel: Relation, options: Options) -> Relation:
    if options.get("ADD_TIMESTAMP", "false").lower() != "true":
        return rel
    from ..operators.windowed import BOUND
    from ..types import Field, Schema

    return Relation(rel.df.withColumn("TIMESTAMP_MS", F.unix_millis(F.current_timestamp())), Schema((*rel.schema.fields, Field("TIMESTAMP_MS", BOUND))))


def _lines(rel: Relation, options: Options) -> DataFrame:
    return json_lines(rel) if _format(options, "CSV", "JSON") == "JSON" else csv_lines(rel, options)


def _started(writer, state: str | None, trigger: dict):
    writer = writer.option("checkpointLocation", state).outputMode("append")
    return writer.trigger(**trigger) if trigger else writer


def _file(rel: Relation, options: Options, state: str | None, trigger: dict):
    _known(options, "FILE_PATH", "APPEND")
    path, kind = options.get("FILE_PATH"), _format(options, "CSV", "JSON", "PARQUET")
    if not path:
        raise InvalidConfig("a File sink needs SINK.FILE_PATH")
    rel = _stamped(rel, options)
    df = rel.df if kind == "PARQUET" else _lines(rel, options)
    form = "parquet" if kind == "PARQUET" else "text"
    if df.isStreaming:
        writer = _started(df.writeStream.format(form).option("path", path), state, trigger)
        return (writer if form == "parquet" else writer.option("lineSep", options.get("TUPLE_DELIMITER", "\n"))).start()
    writer = df.write.format(form).mode("append" if options.get("APPEND", "false").lower() == "true" else "overwrite")
    (writer if form == "parquet" else writer.option("lineSep", options.get("TUPLE_DELIMITER", "\n"))).save(path)


def _print(rel: Relation, options: Options, state: str | None, trigger: dict):
    """Lines on standard output, a partition at a time: what is printed has to come to the driver."""
    _known(options)
    df = _lines(_stamped(rel, options), options)

    def show(batch: DataFrame, _number: int = 0) -> None:
        for row in batch.toLocalIterator():
            print(row["value"])

    if df.isStreaming:
        return _started(df.writeStream.foreachBatch(show), state, trigger).start()
    show(df)


def _void(rel: Relation, options: Options, state: str | None, trigger: dict):
    _known(options)
    if rel.df.isStreaming:
        return _started(rel.df.writeStream.format("noop"), state, trigger).start()
    rel.df.write.format("noop").mode("overwrite").save()


def _checksum(rel: Relation, options: Options, state: str | None, trigger: dict):
    """Prints the number of rows and their checksum: of a stream, after every batch, of all so far in this run."""
    _known(options, "FILE_PATH")
    if not rel.df.isStreaming:
        count, total = checksum(rel).first()
        print(f"{count} {total}")
        return None
    so_far = [0, 0]

    def add(batch: DataFrame, _number: int) -> None:
        found = checksum(Relation(batch, rel.schema)).first()
        so_far[0], so_far[1] = so_far[0] + found[0], so_far[1] + found[1]
        print(f"{so_far[0]} {so_far[1]}")

    return _started(rel.df.writeStream.foreachBatch(add), state, trigger).start()


#: Each writes a finite relation, or starts a query for a stream and returns it; state: where a stream keeps its progress.
SINKS: dict[str, Callable] = {"FILE": _file, "PRINT": _print, "VOID": _void, "CHECKSUM": _checksum}


def write(rel: Relation, kind: str, options: Options, state: str | None = None, trigger: dict | None = None):
    try:
        sink = SINKS[kind.upper()]
    except KeyError:
        raise UnknownSinkKind(f"no sink type {kind}") from None
    return sink(rel, options, state, trigger or {})
