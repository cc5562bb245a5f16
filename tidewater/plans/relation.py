"""A DataFrame together with the declared types of its columns.

Operators take and return relations; all of them only build plans, so Catalyst sees
the whole query.  A relation over a streaming DataFrame works the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..types import Field, Schema, of_spark


#: On a stream that can be ended, a column that no schema names: true in the row that ends it.
LAST = "__last"
#: The time of that row: the year 2200, in milliseconds.
LAST_MS = 7_258_118_400_000


def ended(df: DataFrame, columns: list, fields) -> list:
    """``columns`` for ``fields`` of ``df``; the row that ends a stream has the last time, or null, in place of each."""
    if LAST not in df.columns:
        return columns
    out = []
    for c, f in zip(columns, fields):
        last = F.lit(LAST_MS if f.type.bits == 64 and f.type.is_integer else None).cast(f.type.spark)
        out.append(F.when(F.col(LAST), last).otherwise(c).alias(f.name))
    return [*out, F.col(LAST)]


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    schema: Schema

    @classmethod
    def of(cls, df: DataFrame, schema: Schema | None = None) -> Relation:
        """``df`` with the columns and types of ``schema``, or with the types that its own ones stand for.

        Columns that the schema does not name are not read at all.
        """
        if schema is None:
            schema = Schema(tuple(Field(f.name.upper(), of_spark(f.dataType, f.nullable)) for f in df.schema))
        by_name = {c.upper(): c for c in df.columns}
        missing = [f.name for f in schema.fields if f.name.upper() not in by_name]
        if missing:
            raise SchemaError(f"no column {', '.join(missing)}")
        return cls(df.select(*(F.col(f"`{by_name[f.name.upper()]}`").cast(f.type.spark).alias(f.name) for f in schema.fields)), schema)

    @property
    def spark(self):
        return self.df.sparkSession

    def select(self, names: list[str]) -> Relation:
        return Relation(self.df.select(*(f"`{n}`" for n in names)), Schema(tuple(Field(n, self.schema[n]) for n in names)))

    def lower(self) -> DataFrame:
        """The DataFrame with lower-case column names."""
        return self.df.toDF(*(c.lower() for c in self.df.columns))
