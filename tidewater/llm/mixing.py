"""Operator 9: mixing sources to target weights, in DataFrame operations only.

Sources, in code point order with null last, weigh 1, 2, 3, repeating, and share
all words; a source that would have to give more than ``most`` times its own words
is held there and the excess shared anew, which a sort by room per weight and
running sums solve in one go.

Documents get a hash-random key, of ``doc_id`` and text.  Within a source they are ordered by key: the
leading bits of a key, being uniform, cut the source into ranges of equal size, so
that no source, however large, is sorted in one task.  Words are summed by range,
then over the ranges of a source, then inside each range; the three levels give
every document the words that stand before it.  A source's budget is its target,
rounded.  Whole epochs take every document; the last epoch takes documents in key
order until the budget is spent, the document at the cut in part.

Defined cases: a null text has size 0 and is never taken; a null source is a source
of its own; rows with null or repeated ``doc_id`` are documents of their own, and of
equal rows any may be taken; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
#: Documents that one range should hold at most, on average.
RANGE_ROWS = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str = SEED, number: str | None = None) -> DataFrame:
    """doc_id, source, size and key of each document, written: texts are read once; ``number``: a column that comes along under that name."""
    parts = F.col("doc_id").cast("string"), F.lit(seed), F.md5(F.col("text").cast("binary"))
    key = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *([F.col(number).alias("number")] if number else [])), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    rows = by_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("room", (F.col("source_size") * most).cast("double")).withColumn("per_weight", F.col("room") / F.col("weight"))
    # Held sources are the first by room per weight.  The level is what one unit of weight gets from what they leave.
    held = Window.orderBy("per_weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"held_room": F.coalesce(F.sum("room").over(held), F.lit(0.0)), "held_weight": F.coalesce(F.sum("weight").over(held), F.lit(0))})
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.col("held_room")) / (F.sum("weight").over(every) - F.col("held_weight")))
    level = F.min(F.when(F.col("per_weight") >= F.col("level"), F.struct("per_weight", "level"))).over(every)["level"]
    return rows.select("source", "source_size", F.coalesce(F.least("room", F.col("weight") * level), F.col("room")).alias("target"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (and number) for ``sizes`` as ``sized`` gives them."""
    number = ["number"] if "number" in sizes.columns else []
    bits = max(4, math.ceil(math.log2(max(1, sizes.count()) / RANGE_ROWS + 1)) + 2)
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = sizes.withColumn("range", F.shiftright(lead, 32 - min(bits, 31)))
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "range", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("before_range"))
    goal = targets(sizes, weights, most)
    starts = starts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.select(F.col("source").alias("s"), F.col("range").alias("r"), "before_range", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *number).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before_range") - F.col("before")))
    return placed.select(*number, "doc_id", "key", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns; every row is a document of its own.

    The document at the cut is taken whole if at least half of it is taken, as a
    part of it would be another text; so a source misses its target by half a
    document at most.
    """
    rows = keyed(docs)
    taken = mix(sized(rows.select("key", "row.doc_id", "row.source", "row.text"), seed, "key"), weights, most).filter("size > 0")
    times = taken.select("number", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).filter("times > 0")
    rows = rows.join(times, F.col("key") == F.col("number"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).drop("key")


#: DuckDB SQL for the rows of op9_mixing.
SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, md5(concat_ws('/', doc_id, 'mix-1', md5(text))) AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
    SELECT source, source_size, weight, (source_size * 3)::DOUBLE AS room, (source_size * 3)::DOUBLE / weight AS per_weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
          FROM sizes GROUP BY source)),
levels AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(room) OVER held, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER held, 0)) AS level
    FROM sources WINDOW held AS (ORDER BY per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
    SELECT source, source_size, coalesce(least(room, weight * (SELECT arg_min(level, per_weight) FROM levels WHERE per_weight >= level)), room) AS target
    FROM levels),
placed AS (
    SELECT s.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM placed
"""
