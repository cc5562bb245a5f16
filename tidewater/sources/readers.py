"""Readers for the physical sources: files in CSV, JSON or Parquet, TCP, inline rows, generated rows.

Options are the dialect's, upper-cased keys without their prefix: ``FILE_PATH`` and so
on under SOURCE, ``TYPE``, ``FIELD_DELIMITER`` and so on under INPUT_FORMATTER.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FORMAT, InvalidConfig, UnknownSourceKind
from ..plans import Relation
from ..types import Schema, fail
from .generator import generator

Options = dict[str, str]


def _checked(df: DataFrame, schema: Schema) -> DataFrame:
    """A null in a field that is NOT NULL fails the query."""
    columns = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        columns.append((c if f.type.nullable else F.coalesce(c, fail(FORMAT, f"null in {f.name}").cast(f.type.spark))).alias(f.name))
    return df.select(*columns)


def _csv_options(options: Options) -> dict[str, str]:
    commas = options.get("ALLOW_COMMAS_IN_STRINGS", "false").lower() == "true"
    out = {"sep": options.get("FIELD_DELIMITER", ","), "mode": "FAILFAST", "nullValue": "", "emptyValue": "", "quote": '"' if commas else "", "ignoreLeadingWhiteSpace": "false", "enforceSchema": "true"}
    if options.get("TUPLE_DELIMITER", "\n") != "\n":
        out["lineSep"] = options["TUPLE_DELIMITER"]
    return out


def _nullable(schema: Schema):
    struct = schema.struct
    for f in struct.fields:
        f.nullable = True
    return struct


def _wide(schema: Schema):
    """UINT64 values above 2**63 do not parse as a Spark long, so those fields are read as decimals."""
    from pyspark.sql import types as T

    struct = _nullable(schema)
    for f, own in zip(struct.fields, schema.fields):
        if own.type.name == "UINT64":
            f.dataType = T.DecimalType(20, 0)
    return struct


def _narrow(df: DataFrame, schema: Schema) -> DataFrame:
    from ..types import from_decimal

    return df.select(*((from_decimal(F.col(f"`{f.name}`")) if f.type.name == "UINT64" else F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields))


FORMAT_OPTIONS = {"TYPE", "FIELD_DELIMITER", "TUPLE_DELIMITER", "ALLOW_COMMAS_IN_STRINGS"}


def _known(options: Options, *names: str) -> None:
    """An option that the source does not have is an error."""
    if unknown := set(options) - {*names, *FORMAT_OPTIONS}:
        raise InvalidConfig(f"a source has no option {', '.join(sorted(unknown))}")


def _json_row(text: Column, schema: Schema) -> list[Column]:
    """The fields of a JSON object: keys match whatever their case, in any order, and others are ignored; a value of another type fails."""
    found = F.transform_keys(F.from_json(text, "map<string,string>", {"mode": "FAILFAST"}), lambda k, _: F.upper(k))
    out = []
    for f, wide in zip(schema.fields, _wide(schema).fields):
        raw = F.try_element_at(found, F.lit(f.name.upper()))
        value = raw if f.type.name in ("VARSIZED", "CHAR") else raw.try_cast(wide.dataType)
        if f.type.is_integer:
            value = F.when(raw.rlike(r"^-?\d+$"), value)
        bad = raw.isNotNull() & value.isNull()
        out.append(F.when(bad, fail(FORMAT, f"{f.name} is no {f.type.name}").cast(wide.dataType)).otherwise(value).alias(f.name))
    return out


def file_source(spark: SparkSession, schema: Schema, options: Options, stream: bool = False) -> Relation:
    _known(options, "FILE_PATH", "FILES_PER_TRIGGER")
    path, kind = options.get("FILE_PATH"), options.get("TYPE", "CSV").upper()
    if not path:
        raise InvalidConfig("a File source needs SOURCE.FILE_PATH")
    reader = spark.readStream if stream else spark.read
    if stream and "FILES_PER_TRIGGER" in options:
        reader = reader.option("maxFilesPerTrigger", options["FILES_PER_TRIGGER"])
    if kind == "CSV":
        df = reader.schema(_wide(schema)).options(**_csv_options(options)).csv(path)
        return Relation(_checked(_narrow(df, schema), schema), schema)
    if kind == "JSON":
        return Relation(_checked(_narrow(reader.text(path).filter("trim(value) != ''").select(*_json_row(F.col("value"), schema)), schema), schema), schema)
    if kind == "PARQUET":
        df = reader.schema(_nullable(schema)).parquet(path) if stream else reader.parquet(path)
        return Relation.of(df, schema)
    raise InvalidConfig(f"no input format {kind}")


def inline_source(spark: SparkSession, schema: Schema, options: Options, stream: bool = False) -> Relation:
    """Rows given in the statement's text, as CSV or JSON lines: for tests and small tables."""
    _known(options, "ROWS")
    lines = [line for line in options.get("ROWS", "").split("\n") if line]
    text = spark.createDataFrame([(line,) for line in lines], "value string")
    return Relation(_checked(_narrow(_parsed(text, schema, options), schema), schema), schema)


def _parsed(text: DataFrame, schema: Schema, options: Options) -> DataFrame:
    """The rows of lines (value)."""
    if options.get("TYPE", "CSV").upper() == "JSON":
        return text.select(*_json_row(F.col("value"), schema))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _wide(schema).fields)
    return text.select(F.from_csv("value", F.lit(ddl), _csv_options(options)).alias("r")).select("r.*")


TCP_OPTIONS = ("SOCKET_HOST", "SOCKET_PORT", "SOCKET_DOMAIN", "SOCKET_TYPE", "SOCKET_BUFFER_SIZE", "FLUSH_INTERVAL_MS", "CONNECT_TIMEOUT_SECONDS")


def tcp_source(spark: SparkSession, schema: Schema, options: Options, stream: bool = True) -> Relation:
    """Tuples from a socket, one to a line; always a stream.

    Spark's reader connects by host and port as an IPv4 or IPv6 stream socket, and buffers and flushes by
    micro-batches, so the options for those have no further effect; what it cannot do is refused.
    """
    _known(options, *TCP_OPTIONS)
    if options.get("SOCKET_TYPE", "SOCK_STREAM").upper() != "SOCK_STREAM" or options.get("SOCKET_DOMAIN", "AF_INET").upper() not in ("AF_INET", "AF_INET6"):
        raise InvalidConfig("a TCP source is a stream socket of the internet")
    if options.get("TUPLE_DELIMITER", "\n") != "\n":
        raise InvalidConfig("a TCP source has a tuple on each line")
    try:
        lines = spark.readStream.format("socket").option("host", options["SOCKET_HOST"]).option("port", options["SOCKET_PORT"]).load()
    except KeyError as e:
        raise InvalidConfig(f"a TCP source needs SOURCE.{e.args[0]}") from None
    return Relation(_checked(_narrow(_parsed(lines, schema, options), schema), schema), schema)


SOURCES: dict[str, Callable[..., Relation]] = {"FILE": file_source, "INLINE": inline_source, "TCP": tcp_source, "GENERATOR": generator}


def read(spark: SparkSession, kind: str, schema: Schema, options: Options, stream: bool = False) -> Relation:
    try:
        make = SOURCES[kind.upper()]
    except KeyError:
        raise UnknownSourceKind(f"no source type {kind}") from None
    return make(spark, schema, options, stream)
