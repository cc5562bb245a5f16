"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage works on all documents that the one before it kept, and all but the last
return the columns of ``documents``.  ``run`` writes each stage's result to the
shared folder and reads it again for the next.

Each row is a document, also where ``doc_id`` is null or repeated, except that lines
are compared by ``doc_id``: rows that share one are one document there, and rows
without one keep all their lines.  A text that line dedup empties stays as an empty
document.  Of near duplicates the row with the smallest ``doc_id`` stays, null last.
Columns besides those of ``documents`` come along, whatever their names.  The other
defined cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, mixing, ngram_join, packing, quality
from tidewater.llm.common import keyed, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no certified rule of their language rejects."""
    return quality.judged(quality.features(docs, whole=True), table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars follows the text."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    lines = line_dedup.dedup_lines(docs.select("doc_id", "text", rest))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return lines.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; each row is a document."""
    rows = keyed(docs)
    classes = ngram_join.similar_classes(rows.select(F.col("key").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = rows.select("key", "row.doc_id").join(classes, "key").groupBy("component_id").agg(first.alias("x")).select("x.key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Shingle classes and bin completion are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
