"""What the operators of this subpackage share: tables, batches and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of texts, or of sets of them, that Spark hands to a Python worker at once.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, texts: bool = False, **options: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: lineage ends there and a lost executor costs nothing.

    ``texts``: Python workers get small batches meanwhile, as rows are long; that changes no result.
    """
    spark = df.sparkSession
    path, schema, rows = new_path(spark, name), df.schema, spark.conf.get(_BATCH)
    if texts:
        spark.conf.set(_BATCH, TEXT_ROWS)
    try:
        df.write.options(**options).parquet(path)
    finally:
        if texts:
            spark.conf.set(_BATCH, rows)
    out = spark.read.schema(schema).parquet(path)
    out._tidewater_path = path  # for removed()
    return out


def keyed(df: DataFrame) -> DataFrame:
    """row (all columns of ``df`` as a struct) and key, a number of each row; written, so that keys stay what they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    return written(df.select(row, F.monotonically_increasing_id().alias("key")), "keyed")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, longer if need be, so that none of ``columns`` has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more.

    A collection then lets Spark's cleaner drop the shuffle files of plans that
    nothing refers to, which a driver with much free heap would keep for long.
    """
    path, spark = getattr(df, "_tidewater_path", None), df.sparkSession
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``most`` bytes of text each, and their texts (null: empty)."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(column):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo), [b"" if x is None else x for x in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
