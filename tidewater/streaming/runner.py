"""Runs streaming queries on all input that is there, and ends them.

Operators see that a relation is a stream and use Spark's own windows, with a watermark
that they put on their time field.  Windows come out when the watermark has passed
their end, so a finite stream leaves its last ones in state.  ``Ends`` gives every
source a second input, empty at first; one row far in the future in each of them,
once all else is read, fires what is left.  That row passes selections, and its
own windows are dropped.

Rows of windows that have fired already are an error, as in the batch order of a
stream; Spark drops and counts them, and ``run`` looks at the count.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidConfig, LateRow
from ..plans.relation import LAST, LAST_MS, Relation


def state_dir(spark: SparkSession, name: str) -> str:
    """A folder for a query's state that all executors reach: below spark.checkpoint.dir, which only a local session may leave unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidConfig("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tidewater-state-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Ends:
    """The second inputs of all sources of an engine."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.schemas = spark, state_dir(spark, "ends"), {}

    def of(self, rel: Relation) -> Relation:
        """``rel`` with the input that will end it."""
        struct = rel.df.withColumn(LAST, F.lit(True)).schema
        path = f"{self.folder}/{len(self.schemas)}"
        self.schemas[path] = (struct, rel.schema)
        self.spark.createDataFrame([], struct).write.parquet(path)
        stream = self.spark.readStream.schema(struct).parquet(path)
        return Relation(rel.df.withColumn(LAST, F.lit(False)).unionByName(stream), rel.schema)

    def write(self) -> None:
        """Puts the last row into every second input."""
        for path, (struct, schema) in self.schemas.items():
            fields = [F.lit(LAST_MS if f.type.bits == 64 and f.type.is_integer else None).cast(f.type.spark).alias(f.name) for f in schema.fields]
            self.spark.range(1).select(*fields, F.lit(True).alias(LAST)).select(*struct.names).write.mode("append").parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had fired."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def run(start: Callable[[dict], StreamingQuery], ends: Ends | None = None) -> StreamingQuery:
    """Starts a query, by its trigger, on all input that is there; with ``ends`` once more to fire what is left."""
    query = start({"availableNow": True})
    query.awaitTermination()
    late = late_rows(query)
    if ends is not None and not late:
        ends.write()
        query = start({"availableNow": True})
        query.awaitTermination()
        late = late_rows(query)
    if late:
        raise LateRow(f"{late} rows of windows that have fired")
    return query


def to_table(out: DataFrame, ends: Ends | None = None, mode: str = "append") -> DataFrame:
    """All rows of a streaming DataFrame as Parquet, read again: for tests and for streams that end."""
    state = state_dir(out.sparkSession, "stream")
    path = f"{state}/rows"
    writer = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{state}/state").option("path", path)
    run(lambda trigger: writer.trigger(**trigger).start(), ends)
    return out.sparkSession.read.schema(out.schema).parquet(path)
