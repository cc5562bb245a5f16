"""Operator 10: quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules reject texts with fewer than 50 words, and texts more than half of whose
words lie in repeated three-word windows.  Four more rules reject by a ratio above
a cutoff, each stratum (language) having its own cutoffs.  Labelled documents that
pass the base rules are split by a hash of ``doc_id``:

* one third chooses, for each stratum and rule, the cutoff that rejects most bad
  documents, a rejected good one counting ``price`` bad ones; the highest of equals;
* the other two thirds, the holdout, certify.  All cutoffs of a stratum tighten
  together in ``STEPS`` steps from the loosest, which rejects nothing, to the chosen
  ones.  A step is certified if the exact binomial tail P(Bin(n, risk) <= k) is at
  most delta / strata, where the rules together reject k of the stratum's n good
  held-out documents.  Rejections grow with the steps, so the certified ones are the
  first ones, and the last of them is taken (fixed-sequence testing: no correction
  along the steps; Bonferroni over the strata).

So, at confidence 1 - delta for all strata together, the four rules together reject at
most a share ``risk`` of the good documents of each stratum.  That takes
ln(delta / strata) / ln(1 - risk) good held-out documents.  Languages with fewer are
pooled as one stratum, for which the promise then holds as a whole; whether to pool
depends on numbers of documents alone, not on their rejections.  A language without
labels, or a pool that is still too small, gets no cutoffs: only the base rules act.

Cutoffs stand on grids fixed in advance.  Calibration sees one row for each stratum,
rule and grid cell, however many documents are labelled.

Defined cases: a null or empty text has no words and is rejected; null language is
a language of its own; labels with a null value or without their document say
nothing; a document with several labels counts once for each; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED = 50, 50
RISK, DELTA, PRICE, CELLS, STEPS = 0.05, 0.05, 5, 50, 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def windows(w: Column) -> Column:
    """A hash of each three-word window of array ``w``; null where there are fewer than two windows."""
    last = F.size(w) - 2
    return F.when(last >= 2, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The counts of every document of ``docs`` (doc_id, lang, text); written: texts are read once.

    ``whole``: also all columns of ``docs`` as the struct ``row``.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * whole
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("text"), words(F.col("text")).alias("w"), *row)
    # Most texts repeat no window and need nothing more than a count of the distinct ones.
    df = df.withColumn("h", windows(F.col("w")))
    df = df.withColumn("repeats", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)))
    paired = F.array_sort(F.transform(F.col("h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.col("repeats"), paired))
    n = F.size("s")
    same = lambda i, j: F.element_at(F.col("s"), i)["h"] == F.element_at(F.col("s"), j)["h"]
    hit = F.filter(F.sequence(F.lit(1), n), lambda i: F.when((i > 1) & same(i, F.greatest(i - 1, F.lit(1))), True).otherwise((i < n) & same(i, F.least(i + 1, n))))
    places = F.array_sort(F.transform(hit, lambda i: F.element_at(F.col("s"), i)["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"],
    )
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    out = df.select(
        "doc_id", "lang",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"!")).cast("long").alias("n_shouts"),
        F.size(lines).cast("long").alias("n_lines"),
        *["row"] * whole,
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return written(out.withColumn("base_failed", failed), "quality")


#: Rule: the two counts whose ratio it watches, and the highest cutoff of its grid.
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.5),
    "shouts": ("n_shouts", "word_chars", 0.5),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 0.5),
}


def _cell(rule: str) -> Column:
    """The grid cell of a document: it is rejected by cutoff c (cell/CELLS of the highest) if its cell is above c."""
    part, whole, top = RULES[rule]
    ratio = F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    return F.least(F.lit(CELLS), F.ceil(ratio / top * CELLS)).cast("int")


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term from 0."""
    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(a["sum"], term) - high))).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("sum")), step, lambda a: a["sum"])


def _first_step(cell: Column, chosen: Column) -> Column:
    """The first step at which a document in ``cell`` is rejected, if the last one's cutoff is ``chosen``; null: none."""
    return F.when(cell > chosen, F.floor(STEPS * (CELLS - cell) / (CELLS - chosen)) + 1)


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, price: float = PRICE) -> DataFrame:
    """lang, pooled, n_good, rejected, and cut_<rule>, the cell above which the rule rejects, or null; one row for each language with labels; written."""
    cells = [_cell(r).alias(f"c_{r}") for r in RULES]
    known = found.filter("not base_failed").join(labels.select("doc_id", "quality").filter("quality is not null"), "doc_id")
    holdout = F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(3)) > 0
    known = known.select("lang", (F.col("quality") > 0).alias("good"), holdout.alias("holdout"), *cells)
    # Whatever the number of labels, one row for each language, half and combination of cells goes on.
    known = written(known.groupBy("lang", "good", "holdout", *(f"c_{r}" for r in RULES)).agg(F.count(F.lit(1)).alias("docs")), "quality-labels")

    every = Window.partitionBy(F.lit(0))  # one row for each language
    n = F.sum(F.when(F.col("good") & F.col("holdout"), F.col("docs")).otherwise(0))
    strata = known.groupBy("lang").agg(n.alias("n")).withColumn("langs", F.count(F.lit(1)).over(every))
    pooled = F.col("n") < F.ceil(F.log(F.lit(delta) / F.col("langs")) / math.log1p(-risk))
    strata = strata.withColumn("pooled", pooled).withColumn("stratum", F.struct("pooled", F.when(~F.col("pooled"), F.col("lang")).alias("lang")))
    count = F.sum(F.expr("cast(not pooled as int)")).over(every) + F.max(F.expr("cast(pooled as int)")).over(every)
    strata = written(strata.select(F.col("lang").alias("of"), "pooled", "stratum", count.alias("strata")), "quality-strata")
    known = known.join(F.broadcast(strata), F.col("lang").eqNullSafe(F.col("of")))

    # Choosing: documents above each cutoff, bad and good.
    chooses = known.filter("not holdout")
    cells = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"c_{r}").alias("cell")) for r in RULES))
    cells = chooses.select("stratum", "good", "docs", F.explode(cells).alias("c")).filter("c.cell > 0")
    above = cells.select("stratum", "good", "docs", "c.rule", F.explode(F.sequence(F.lit(0), F.col("c.cell") - 1)).alias("cut"))
    worth = F.sum(F.when(F.col("good"), -price * F.col("docs")).otherwise(F.col("docs").cast("double")))
    best = above.groupBy("stratum", "rule", "cut").agg(worth.alias("worth")).filter("worth > 0").groupBy("stratum", "rule").agg(F.max(F.struct("worth", "cut")).alias("b"))
    chosen = best.groupBy(F.col("stratum").alias("s")).agg(*(F.max(F.when(F.col("rule") == r, F.col("b.cut"))).alias(f"last_{r}") for r in RULES))
    chosen = written(chosen, "quality-chosen")

    # Certifying: good held-out documents by the first step that rejects them.
    tests = known.filter("holdout and good").join(F.broadcast(chosen), F.col("stratum") == F.col("s"))
    first = F.least(*(_first_step(F.col(f"c_{r}"), F.col(f"last_{r}")) for r in RULES), F.lit(STEPS + 1).cast("long"))
    hits = tests.groupBy("stratum", "strata", first.alias("first")).agg(F.sum("docs").alias("docs"))
    hits = hits.groupBy("stratum", "strata").agg(F.sum("docs").alias("n"), F.collect_list(F.struct("first", "docs")).alias("hits"))  # at most a row for each step
    steps = hits.select("stratum", "strata", "n", "hits", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
    k = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= F.col("step"), x["docs"]).otherwise(F.lit(0)))
    steps = steps.withColumn("k", k).filter(F.col("k") < F.col("n") * risk)  # beyond that the tail is about a half or more
    steps = steps.filter(log_tail(F.col("n"), F.col("k"), risk) <= F.log(F.lit(delta) / F.col("strata")))
    last = steps.groupBy(F.col("stratum").alias("t")).agg(F.max(F.struct("step", "n", "k")).alias("b"))
    cut = lambda r: F.floor(CELLS - F.col("b.step") * (CELLS - F.col(f"last_{r}")) / STEPS).cast("int").alias(f"cut_{r}")
    out = strata.join(F.broadcast(chosen), F.col("stratum") == F.col("s"), "left").join(F.broadcast(last), F.col("stratum") == F.col("t"), "left")
    return written(out.select(F.col("of").alias("lang"), "pooled", F.col("b.n").alias("n_good"), F.col("b.k").alias("rejected"), *map(cut, RULES)), "quality-cutoffs")


def judged(found: DataFrame, labels: DataFrame, **levels: float) -> DataFrame:
    """``found`` with kept, false if a base rule or a certified rule of the stratum rejects, and the ratios cut_<rule> above which rules reject (null: none)."""
    chosen = cutoffs(found, labels, **levels).select(F.col("lang").alias("of"), *(f"cut_{r}" for r in RULES))  # one row for each language
    rows = found.join(chosen, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    passes = ~F.col("base_failed")
    for r in RULES:
        passes &= F.coalesce(_cell(r) <= F.col(f"cut_{r}"), F.lit(True))
    rows = rows.withColumn("kept", passes)
    return rows.withColumns({f"cut_{r}": F.col(f"cut_{r}") * (RULES[r][2] / CELLS) for r in RULES})


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features(table(spark, sf_dir, "documents"))
    return judged(found, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", *(f"cut_{r}" for r in RULES))
