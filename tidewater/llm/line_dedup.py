"""Operator 2: exact line dedup against levelled sorted runs.

The index of lines seen so far is a log-structured merge tree of runs in the shared
folder.  A run is a bucketed Parquet table of the 128-bit hashes of lines with the
smallest ``doc_id`` that has them, each bucket one file sorted by hash; no hash is in
two runs.  A batch of documents is reduced to one row for each hash, merge-joined
with every run, and what no run has becomes a new run of level 0.  When a level holds
``fanout`` runs they are merged into one of the next level, so a hash is
rewritten once for each level and a batch meets few runs.  Runs have equal buckets, so
neither a batch's joins nor a merge deal out a run's rows again.

Batches come in ascending ``doc_id``, so the first document that brings a hash is
the one that keeps its lines.  Hashes that a second document brings are noted
with their keeper; only these are joined with the lines again.  A line that very
many documents hold is one row for each batch by then, and the join back is an
ordinary one, whose hot partitions adaptive execution splits.

Defined cases: a null or empty text is one empty line; lines whose key is shorter
than ``min_chars`` code points always stay; lines repeated inside one document
stay or go together; rows with the same ``doc_id`` are one document when lines are
compared; rows with null ``doc_id`` are returned as they are and hold nothing
against others; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, fresh, new_path, partitions, removed, slices, table, written

SPACES = b" \t\n\x0b\x0c\r"
MIN_CHARS, BATCHES, FANOUT = 10, 4, 2
KEY = ["hi", "lo"]


def line_key(line: bytes) -> bytes:
    """A line without outer white space, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def line_hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hi, lo, doc_id: once for each document and key that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                ids, raw = [], bytearray()
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), texts):
                    keys = {k for line in text.split(b"\n") if _long_enough(k := line_key(line), min_chars)}
                    ids += [doc_id] * len(keys)
                    for k in keys:
                        raw += line_hash(k)
                both = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(bytes(raw))])
                longs = pa.Array.from_buffers(pa.int64(), 2 * len(ids), [None, both.buffers()[1]])
                yield pa.RecordBatch.from_arrays([longs[::2] if len(ids) else longs, longs[1::2] if len(ids) else longs, pa.array(ids, pa.int64())], names=["hi", "lo", "doc_id"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return typed.mapInArrow(run, "hi long, lo long, doc_id long")


class LineIndex:
    """The runs, by level; ``add`` takes batches in ascending doc_id."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.places: dict[int, tuple[str, str]] = {}
        self.levels: list[list[DataFrame]] = [[]]
        self.shared: list[DataFrame] = []
        self.lines: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _run(self, rows: DataFrame, level: int) -> DataFrame:
        """``rows``, whose partitions are buckets already, as a run."""
        name, path = f"lines_l{level}_{uuid.uuid4().hex}", new_path(self.spark, f"lines-l{level}")
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        self.places[id(run)] = name, path
        return run

    def _forget(self, run: DataFrame) -> None:
        name, path = self.places.pop(id(run))
        self.spark.sql(f"DROP TABLE {name}")
        run._tidewater_path = path
        removed(run)

    def close(self) -> None:
        """Deletes the runs; what batches have noted stays."""
        for run in self.runs():
            self._forget(run)
        self.levels = [[]]

    def add(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> None:
        """Indexes a batch, and notes hashes that more than one document has, with their keeper."""
        lines = written(hashed_lines(docs, min_chars), "lines", texts=True)
        self.lines.append(lines)
        fresh = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
        known = []
        for run in self.runs():
            known.append(fresh.hint("merge").join(run.select(*KEY, F.col("first_doc").alias("keeper")), KEY))
            fresh = fresh.hint("merge").join(run.select(*KEY), KEY, "left_anti")
        level0 = self._run(fresh.repartition(self.buckets, *KEY), 0)
        self.levels[0].append(level0)
        for found in known:
            self.shared.append(written(found.select(*KEY, "keeper"), "lines-shared"))
        self.shared.append(written(level0.filter("n > 1").select(*KEY, F.col("first_doc").alias("keeper")), "lines-shared"))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for run in level[1:]:  # no hash is in both, so this is a merge
                    merged = merged.hint("merge").join(run.select(*KEY, *(F.col(c).alias(f"other_{c}") for c in ("first_doc", "n"))), KEY, "full")
                    merged = merged.select(*KEY, *(F.coalesce(c, f"other_{c}").alias(c) for c in ("first_doc", "n")))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._run(merged, k + 1))
                for run in level:
                    self._forget(run)
                self.levels[k] = []

    def dropped(self) -> DataFrame:
        """doc_id and the hashes of the lines that it loses."""
        keepers, lines = self.shared[0], self.lines[0]
        for more in self.shared[1:]:
            keepers = keepers.unionByName(more)
        for more in self.lines[1:]:
            lines = lines.unionByName(more)
        # A key may be noted by several batches.  Written, so that a line which very many documents hold can be split in the join.
        keepers = written(keepers.groupBy(*KEY).agg(F.min("keeper").alias("keeper")), "lines-keepers")
        lost = lines.join(keepers, KEY).filter("doc_id > keeper")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("lost"))


def _ranges(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Batches of about as many documents each, in ascending ranges of doc_id."""
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.2 / batches)  # no row: no cut
    cuts = sorted({int(c) for c in cuts})
    if not cuts and batches > 1 and docs.filter("doc_id is not null").isEmpty():
        return []
    out = []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = docs.filter("doc_id is not null") if lo is None else docs.filter(F.col("doc_id") >= lo)
        out.append(part if hi is None else part.filter(F.col("doc_id") < hi))
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` without its dropped lines, and n_lines and n_dropped; other columns stay.

    The columns n_lines and n_dropped of ``docs``, if any, are replaced, whatever their case; a column lost goes.
    """
    spark = docs.sparkSession
    index = LineIndex(spark, fanout)
    for batch in _ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches):
        index.add(batch, min_chars)
    index.close()
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "lost")]
    if not index.lines:
        joined = docs.select(*kept, F.lit(None).cast("array<struct<hi:long,lo:long>>").alias("lost"))
    else:
        name = fresh("of", [*kept, "lost"])
        lost = index.dropped().withColumnRenamed("doc_id", name)
        joined = docs.select(*kept).join(lost, F.col("doc_id").cast("long") == F.col(name), "left").drop(name)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch, texts in slices(whole):
                out, n_lines, n_dropped = [], [], []
                for text, lost in zip(texts, column(batch, "lost").to_pylist()):
                    lines = text.split(b"\n")
                    stay = lines
                    if lost:
                        gone = {(x["hi"], x["lo"]) for x in lost}
                        stay = [line for line in lines if not _is_lost(line, gone, min_chars)]
                    out.append(b"\n".join(stay).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                cols = [pa.array(out, pa.string()) if c == "text" else column(batch, c) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    schema = StructType([f for f in docs.schema if f.name in kept]).add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(run, schema)


def _is_lost(line: bytes, gone: set, min_chars: int) -> bool:
    key = line_key(line)
    if not _long_enough(key, min_chars):
        return False
    raw = line_hash(key)
    return (int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)) in gone


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB SQL for the rows of op2_line_dedup.
SQL = """
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
keepers AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
    SELECT k.*, coalesce(doc_id > keeper, false) AS lost FROM keyed k LEFT JOIN keepers USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
