"""Runs the dialect on inline rows and gives the result as CSV lines, as golden tests hold it."""

from __future__ import annotations

from tidewater.session import Engine
from tidewater.sources import csv_lines
from tidewater.types import Field, Schema, declared


def schema(text: str) -> Schema:
    return Schema(tuple(Field(p.split()[0].upper(), declared(" ".join(p.split()[1:]))) for p in text.split(",")))


def engine(spark, **sources: tuple[str, str]) -> Engine:
    """``name=(schema, rows)``; rows are CSV lines."""
    out = Engine(spark)
    for name, (fields, rows) in sources.items():
        lines = "\n".join(line.strip() for line in rows.strip().split("\n"))
        out.sql(f"CREATE LOGICAL SOURCE {name}({fields})")
        out.sql(f"""CREATE PHYSICAL SOURCE FOR {name} TYPE Inline SET('{lines.replace("'", "''")}' AS "SOURCE".ROWS)""")
    return out


def lines(e: Engine, query: str) -> list[str]:
    return sorted(r["value"] for r in csv_lines(e.query(query)).collect())


def expected(text: str) -> list[str]:
    return sorted(",".join(c.strip() for c in line.strip().split(",")) for line in text.strip().split("\n"))
