"""Generated rows, computed from the row number on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..plans import Relation
from ..types import Schema, dtype

#: Words that a list may have, as they go into the plan.
MOST_WORDS = 100_000
OPTIONS = {"GENERATOR_SCHEMA", "SEED", "STOP_GENERATOR_WHEN_SEQUENCE_FINISHES", "MAX_RUNTIME_MS", "GENERATOR_RATE_TYPE", "GENERATOR_RATE_CONFIG", "FLUSH_INTERVAL_MS", "TYPE"}


def _sequence(words: list[str], row: Column) -> tuple[Column, int]:
    kind, start, end, step = dtype(words[0]), *map(float, words[1:4])
    if step == 0:
        raise InvalidConfig("a sequence needs a step")
    length = max(0, math.ceil((end - start) / step))
    value = F.least(F.lit(end), F.lit(start) + row * step) if step > 0 else F.greatest(F.lit(end), F.lit(start) + row * step)
    if kind.is_integer:
        value = F.least(F.lit(int(end)), int(start) + row * int(step)) if step > 0 else F.greatest(F.lit(int(end)), int(start) + row * int(step))
    return value.cast(kind.spark), length


def _field(text: str, row: Column, seed: int, spark: SparkSession) -> tuple[Column, int | None]:
    name, *words = text.split()
    name = name.upper()
    if name == "SEQUENCE":
        return _sequence(words, row)
    if name == "NORMAL_DISTRIBUTION":
        kind, mean, spread = dtype(words[0]), float(words[1]), float(words[2])
        return (F.randn(seed) * spread + mean).cast(kind.spark), None
    if name == "RANDOMSTR":
        low, high = int(words[0]), int(words[-1])
        size = low + F.floor(F.rand(seed) * (high - low + 1)).cast("int")
        return F.substring(F.concat(*(F.sha2(F.concat(row.cast("string"), F.lit(f"/{seed}/{k}")), 256) for k in range(high // 64 + 1))), F.lit(1), size), None
    if name == "WORDLIST":
        found = [r["value"] for r in spark.read.text(words[0]).filter("value != ''").limit(MOST_WORDS + 1).collect()]
        if len(found) > MOST_WORDS:
            raise InvalidConfig(f"a word list has at most {MOST_WORDS} words")
        listed = F.array(*map(F.lit, found))
        return F.element_at(listed, (F.floor(F.rand(seed) * len(found)) + 1).cast("int")), None
    raise InvalidConfig(f"no generated field {name}")


def generator(spark: SparkSession, schema: Schema, options: dict[str, str], stream: bool = False) -> Relation:
    """Rows by ``GENERATOR_SCHEMA``, one part for each field.

    Sequences stop short of their end and then stay there.  Rows stop when all
    sequences have finished (ALL), when one has (ONE), or never (NONE); a
    ``MAX_RUNTIME_MS`` and the emit rate bound them besides.  A stream without a bound
    goes on; as a finite relation it is refused.  The rate is FIXED, so many rows a
    second, or SINUS, whose number of rows changes from second to second.
    """
    if unknown := set(options) - OPTIONS:
        raise InvalidConfig(f"a Generator has no option {', '.join(sorted(unknown))}")
    parts = [p.strip() for p in options.get("GENERATOR_SCHEMA", "").split(",") if p.strip()]
    if len(parts) != len(schema.fields):
        raise InvalidConfig("GENERATOR_SCHEMA and the schema differ in length")
    seed = int(options.get("SEED", "1"))
    row = F.col("value") if stream else F.col("id")
    made = [_field(p, row, seed + k, spark) for k, p in enumerate(parts)]
    lengths = [n for _, n in made if n is not None]
    rate = _rate(options)
    stop = options.get("STOP_GENERATOR_WHEN_SEQUENCE_FINISHES", "NONE").upper()
    if stop not in ("ALL", "ONE", "NONE"):
        raise InvalidConfig(f"no stop rule {stop}")
    runtime = float(options.get("MAX_RUNTIME_MS", "-1"))
    bounds = [max(lengths) if stop == "ALL" else min(lengths)] if stop != "NONE" and lengths else []
    if runtime >= 0:
        seconds = int(runtime // 1000)
        bounds.append(sum(map(rate, range(seconds))) + int(rate(seconds) * (runtime - 1000 * seconds) / 1000))
    if stream:
        # Spark's rate is even; a changing one is met on average over its first hour.
        mean = sum(map(rate, range(3600))) / 3600
        df = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(mean))).load()
        df = df.filter(F.col("value") < min(bounds)) if bounds else df
    elif bounds:
        df = spark.range(min(bounds))
    else:
        raise InvalidConfig("an endless Generator is a stream: give a stop rule or MAX_RUNTIME_MS")
    return Relation(df.select(*(c.cast(f.type.spark).alias(f.name) for f, (c, _) in zip(schema.fields, made))), schema)


def _rate(options: dict[str, str]) -> Callable[[int], int]:
    """Rows that are emitted in each second."""
    kind = options.get("GENERATOR_RATE_TYPE", "FIXED").upper()
    words = options.get("GENERATOR_RATE_CONFIG", "emit_rate 1000").replace(",", " ").split()
    given = {k.lower(): float(v) for k, v in zip(words[::2], words[1::2])}
    try:
        if kind == "FIXED":
            rows = given["emit_rate"]
            return lambda second: int(rows)
        if kind == "SINUS":
            amplitude, frequency = given["amplitude"], given["frequency"]
            return lambda second: sinus_rate(amplitude, frequency, second)
    except KeyError as e:
        raise InvalidConfig(f"the rate needs {e.args[0]}") from None
    raise InvalidConfig(f"no rate {kind}")


def sinus_rate(amplitude: float, frequency: float, second: int) -> int:
    """Rows that a source of sinusoidal rate emits in a second."""
    return max(0, round(amplitude * (1 + math.sin(2 * math.pi * frequency * second)) / 2))
