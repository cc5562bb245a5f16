"""Operator 8: which documents' sets of five-word shingles have a Jaccard similarity of 0.75 or more.

Documents with the same set are one from the start.  For the others, tokens
(shingle hashes) have a total order, rarer first, and the multi-match prefix
principle holds for every l: if two sets must share a tokens, the first
|x| - a + l tokens of each share at least l.  The shorter set of a pair is
indexed, each token with the smallest l whose prefix has it; the longer one
probes with the l that its own tokens' estimated frequencies make cheapest, and
only pairs with at least l shared tokens are verified, on their whole sets.
Frequencies come from one hashed counter array over all documents; its noise
changes the order and the choice of l, never the result.

What is wanted are classes, so links inside a class that is already known are
not sought.  First every token's holders are compared with one of them
only, which joins groups of near copies in a linear number of checks.  Then all
candidates between different classes are verified, so no link between classes is
lost.  Classes are found by star contraction of the links.

Defined cases: a null or empty text, or one without words, has the empty set and is
linked with nothing; fewer words than a shingle has make one shingle; rows with
the same ``doc_id`` are one document, linked if any of their texts are; rows with
null ``doc_id`` stand for themselves; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import column, keyed, partitions, removed, slices, table, written
from .components import components

WIDTH = 5
#: The similarity is NUM / DEN or more.
NUM, DEN = 3, 4
#: Largest l.
MOST_MATCHES = 6
#: Other documents that a token without a known frequency is taken to have.
FLOOR = 0.05
#: Counters of the frequency estimate, bits of the filters of documents to be verified and of tokens met twice (as powers of two).
COUNTER_BITS, FILTER_BITS, TOKEN_BITS = 22, 24, 27
CHUNKS = 32
#: Rounds in which each document is compared with one pivot, most further ones for crowded groups, and rounds of each document's most promising pair.
TURNS, MORE_TURNS, FIRST_TURNS = 2, 4, 1
#: Pairs that one token may form before its documents are a crowd, and documents of a token that a crowd's pairs are formed by.
CROWD, FEW = 2048, 64
#: Numbers of 64 bits in the sketch of a crowd document's set.
SKETCH = 16

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    buf, at = wh.padded([t.lower() for t in texts], b"\n")
    starts, lens = wh.words(buf, int(at[-1]))
    h = wh.hash_spans(buf, starts, lens)
    first = np.searchsorted(starts, at)
    s = h.copy()
    for k in range(1, width):
        if h.size > k:
            s[:-k] = wh.mix(s[:-k] * _A + h[k:])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        if n >= width:
            out.append(np.unique(s[lo : hi - width + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for w in h[lo:hi]:
                x = wh.mix(x * _B + w)
            out.append(x)
        else:
            out.append(h[:0])
    return out


def required(a: int, b: int) -> int:
    """The fewest tokens that sets of these sizes must share."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _chunks(counts: np.ndarray) -> list[bytes]:
    return [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(counts, CHUNKS)]


def _whole(chunks: list[bytes]) -> np.ndarray:
    """The array whose compressed parts these are.  Workers put it together; the driver only passes the parts on."""
    return np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in chunks]) if chunks else np.zeros(0, np.uint32)


def _collected(rows: DataFrame) -> list[bytes]:
    """The data of ``CHUNKS`` rows at most (chunk, data), by chunk."""
    return [bytes(r["data"]) for r in sorted(rows.collect(), key=lambda r: r["chunk"])]


def _merged(rows: DataFrame, combine) -> list[bytes]:
    """Arrays that tasks have sent in ``CHUNKS`` parts (chunk, data), combined, as compressed parts; each task holds one part of the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(column(batch, "chunk").to_pylist(), column(batch, "data")):
                x = np.frombuffer(zlib.decompress(data.as_py()), "<u4").astype(np.uint32)
                sums[k] = combine(sums[k], x) if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "data"])

    return _collected(rows.repartition(CHUNKS, "chunk").mapInArrow(run, "chunk int, data binary"))


def _profiles(docs: DataFrame) -> DataFrame:
    """Each document's set size and fingerprint, and each task's token counters; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        names = ["doc_id", "n", "f1", "f2", "chunk", "data"]
        none = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                slot, times = np.unique((flat >> np.uint64(64 - COUNTER_BITS)).astype(np.uint32), return_counts=True)
                counts[slot] += times.astype(np.uint32)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                cut = np.cumsum(size) - size
                full = np.flatnonzero(size)
                prints = []
                for seed in (_A, _B):
                    f = np.zeros(len(sets), np.uint64)
                    if full.size:
                        f[full] = np.add.reduceat(wh.mix(flat ^ seed), cut[full])
                    prints.append(f.view(np.int64))
                k = len(sets)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(size, pa.int32()), *map(pa.array, prints), none(k, pa.int32()), none(k, pa.binary())], names=names)
        data = _chunks(counts)
        yield pa.RecordBatch.from_arrays([none(CHUNKS, pa.int64()), none(CHUNKS, pa.int32()), none(CHUNKS, pa.int64()), none(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(data, pa.binary())], names=names)

    return written(docs.mapInArrow(run, "doc_id long, n int, f1 long, f2 long, chunk int, data binary"), "profiles", texts=True)


def frequency_levels(counts: np.ndarray, mean: float | None = None) -> np.ndarray:
    """0 where a counter holds what chance alone may put there, else the binary logarithm of how far it stands above, from 1 on.

    Most tokens are in one document, so a counter's share of them varies as a Poisson number does.
    ``mean``: that of all counters, where ``counts`` are a part of them.
    """
    if not counts.size:
        return np.zeros(1 << COUNTER_BITS, np.uint8)
    if mean is None:
        mean = float(counts.sum(dtype=np.int64)) / counts.size
    out = np.zeros(counts.size, np.uint8)
    high = np.flatnonzero(counts > mean + 4 * mean**0.5 + 3)
    for at in np.array_split(high, 1 + high.size // (1 << 16)):  # the driver does this for all counters
        out[at] = np.ceil(np.log2((counts[at] - mean) / (4 * mean**0.5 + 3))) + 1
    return out


def _levels(chunks: list[bytes]) -> list[bytes]:
    """``frequency_levels`` of the counters with these parts, as compressed parts; one part at a time is unpacked."""
    counts = lambda c: np.frombuffer(zlib.decompress(c), "<u4")
    mean = sum(int(counts(c).sum(dtype=np.int64)) for c in chunks) / (1 << COUNTER_BITS)
    return [zlib.compress(frequency_levels(counts(c), mean).tobytes(), 1) for c in chunks]


def choose_matches(level: np.ndarray, n: int) -> int:
    """The l for a probing set whose tokens, in order, have these frequency levels.

    Looking up the prefix costs what its tokens' holders number; a candidate costs
    a verification and has l of those hits at least, so there are at most 1/l of
    them.  Levels are relative to chance; level 0 counts as ``FLOOR``.
    """
    need = -(-NUM * n // DEN)
    most = min(MOST_MATCHES, need)
    base = n - need
    hits = np.where(level[: base + most] > 0, np.exp2(level[: base + most].astype(np.float64)), FLOOR)
    total = np.cumsum(hits)
    best, least = 1, None
    for m in range(1, most + 1):
        cost = total[min(base + m, total.size) - 1] * (1 + n / 8 / m)
        if least is None or cost < least:
            best, least = m, cost
    return best


def _prefixes(docs: DataFrame, levels) -> DataFrame:
    """token, doc, n, pos, lev (smallest l whose index prefix has the token, 0: none), ell (the probe's l, 0: not in its prefix); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = np.frombuffer(b"".join(map(zlib.decompress, levels.value)), np.uint8) if levels.value else frequency_levels(np.zeros(0, np.uint32))
        for batch in batches:
            for part, texts in slices(batch):
                tokens, meta = [], []
                for doc_id, own in zip(column(part, "doc_id").to_pylist(), shingle_sets(texts)):
                    n = own.size
                    if not n or doc_id is None:
                        continue
                    level = level_of[(own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    order = np.argsort(level, kind="stable") if level.any() else slice(None)
                    level = level[order]
                    ell = choose_matches(level, n)
                    probe = n - -(-NUM * n // DEN) + ell
                    spare = n - required(n, n)
                    index = min(n, spare + MOST_MATCHES)
                    top = max(probe, index)
                    place = np.arange(top)
                    lev = np.where(place < index, np.maximum(1, place - spare + 1), 0)
                    tokens.append(own[order][:top])
                    meta.append((doc_id, n, top, lev, np.where(place < probe, ell, 0)))
                if not meta:
                    continue
                times = [m[2] for m in meta]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array([m[0] for m in meta], np.int64), times)), pa.array(np.repeat(np.array([m[1] for m in meta], np.int32), times)), pa.array(np.concatenate([np.arange(m[2]) for m in meta]), pa.int32()), pa.array(np.concatenate([m[3] for m in meta]), pa.int8()), pa.array(np.concatenate([m[4] for m in meta]), pa.int8())],
                    names=["token", "doc", "n", "pos", "lev", "ell"],
                )

    return written(docs.mapInArrow(run, "token long, doc long, n int, pos int, lev byte, ell byte"), "prefixes", texts=True, compression="zstd")


def _bits(wanted: DataFrame) -> list[bytes]:
    """Bits of fixed number, set for the documents in ``wanted`` (doc) and few others, as compressed parts."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        for batch in batches:
            h = _bit(column(batch, "doc").to_numpy(zero_copy_only=False))
            np.bitwise_or.at(seen, h >> 5, np.uint32(1) << (h & 31).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(_chunks(seen), pa.binary())], names=["chunk", "data"])

    return _merged(wanted.select("doc").mapInArrow(bits, "chunk int, data binary"), np.bitwise_or)


def _chosen(batch: pa.RecordBatch, seen: np.ndarray) -> pa.RecordBatch:
    if not seen.size:
        return batch.slice(0, 0)
    h = _bit(column(batch, "doc_id").fill_null(0).to_numpy(zero_copy_only=False))
    return batch.filter(pa.array((seen[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, tokens (packed) of the documents in ``wanted`` (doc) and few others; written.

    Texts are not shuffled: bits of the wanted ids, of fixed size however many there are, keep most others out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _whole(shared.value)
        for batch in batches:
            for part, texts in slices(_chosen(batch, seen)):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["doc", "tokens"])

    return written(docs.filter("doc_id is not null").mapInArrow(run, "doc long, tokens binary"), "sets", texts=True)


def _met_twice(prefixes: DataFrame) -> list[bytes]:
    """Bits of fixed number, set at least where two rows of ``prefixes`` or more have their token, as compressed parts."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << (TOKEN_BITS - 5), np.uint32) for _ in range(2))
        for batch in batches:
            slot, n = np.unique(_slot(column(batch, "token")), return_counts=True)
            bit = np.uint32(1) << (slot & 31).astype(np.uint32)
            again = (n > 1) | (once[slot >> 5] & bit > 0)
            np.bitwise_or.at(twice, slot[again] >> 5, bit[again])
            np.bitwise_or.at(once, slot >> 5, bit)
        for k, (a, b) in enumerate(zip(_chunks(once), _chunks(twice))):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, *data in zip(column(batch, "chunk").to_pylist(), column(batch, "once"), column(batch, "twice")):
                a, b = (np.frombuffer(zlib.decompress(x.as_py()), "<u4") for x in data)
                if k in seen:
                    once, twice = seen[k]
                    a, b = once | a, twice | b | (once & a)
                seen[k] = a, b
        for k, (_, twice) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["chunk", "data"])

    marked = prefixes.select("token").mapInArrow(marks, "chunk int, once binary, twice binary").repartition(CHUNKS, "chunk")
    return _collected(marked.mapInArrow(merge, "chunk int, data binary"))


def _slot(tokens: pa.Array) -> np.ndarray:
    """From the low bits: tokens of a prefix are the least of their level, so their high bits are not even."""
    return tokens.to_numpy(zero_copy_only=False) & ((1 << TOKEN_BITS) - 1)


def _maybe_shared(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` without most of the tokens that only one row has; those that more have all stay."""
    twice = prefixes.sparkSession.sparkContext.broadcast(_met_twice(prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _whole(twice.value)
        for batch in batches:
            slot = _slot(column(batch, "token"))
            yield batch.filter(pa.array((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1))

    return prefixes.mapInArrow(run, prefixes.schema)


def _held_by_several(prefixes: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose token has other rows; rows of a token lie side by side and are looked at in passing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, True  # the row before, and whether it has come out
        for batch in batches:
            if not len(batch):
                continue
            token = column(batch, "token").to_numpy(zero_copy_only=False)
            same = np.concatenate([[last is not None and column(last, "token")[0].as_py() == token[0]], token[1:] == token[:-1]])
            if same[0] and not kept:
                yield last
            keep = same.copy()
            keep[:-1] |= same[1:]
            yield batch.filter(pa.array(keep))
            last, kept = batch.slice(len(batch) - 1), bool(keep[-1])

    return prefixes.repartition(partitions(prefixes.sparkSession), "token").sortWithinPartitions("token").mapInArrow(run, prefixes.schema)


def _bit(ids: np.ndarray) -> np.ndarray:
    return (wh.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets are similar enough; written.

    Sets join their second documents first: in a star around a, those differ, and
    a's own set meets them only in the last join, where nothing is shuffled on.
    """
    sets = _sets(docs, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")))
    side = {x: sets.select(F.col("doc").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab"}
    both = pairs.join(side["b"], "b").join(side["a"], "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = column(batch, "a"), column(batch, "b"), []
            kept_key, kept_set = None, None
            for key, x, y in zip(a.to_pylist(), column(batch, "ta"), column(batch, "tb")):
                if key != kept_key:
                    kept_key, kept_set = key, np.frombuffer(x.as_py(), np.uint64)
                y = np.frombuffer(y.as_py(), np.uint64)
                n, m = kept_set.size, y.size
                need = required(n, m)
                at = np.searchsorted(kept_set, y)
                at[at == n] = 0
                keep.append(bool(n and m and need <= min(n, m) and int((kept_set[at] == y).sum()) >= need))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    out = written(both.mapInArrow(run, "a long, b long").distinct(), "similar", texts=True)
    removed(sets)
    return out


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes (node, component) ``known`` with more ``links`` (a, b); contraction goes on from them."""
    old = [] if known is None else [known.select(F.col("node").alias("a"), F.col("component").alias("b"))]
    return components(functools.reduce(DataFrame.union, old, links))


def _classes(shared: DataFrame, known: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """``shared`` with each document's class and its token's main one, for tokens that several classes have; those tokens' pivots.

    The main class has most of the token's holders; its pivot is the one whose tokens are most common or, in later
    turns, whose hash is least, so that most tokens of a group of near copies have the same pivot.
    """
    if known is None:
        classed = shared.withColumn("class", F.col("doc"))
    else:
        classed = shared.join(known.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("class", F.coalesce("component", "doc")).drop("component")
    rank = F.xxhash64("doc", F.lit(turn)).cast("double") if turn else F.col("score")
    per = classed.groupBy("token", "class").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct(rank.alias("h"), "n", "doc")).alias("s"))
    first = F.max(F.struct("c", F.col("s.h").alias("h"), "class", "s"))
    main = per.groupBy("token").agg(first.alias("m"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    main = main.select("token", F.col("m.class").alias("main"), F.col("m.s.n").alias("m"), F.col("m.s.doc").alias("a"))
    return classed.join(main.select("token", "main"), "token"), main.drop("main")


def _stars(classed: DataFrame, pivots: DataFrame, least: int = 4) -> DataFrame:
    """For each document the pivot, of another class, with which it shares most tokens, if that is a ``least``-th of its prefix; written."""
    star = classed.filter("class != main").join(pivots, "token").filter(f"{DEN} * least(m, n) >= {NUM} * greatest(m, n)")
    size = F.max(F.expr(f"n - ceil({NUM} * n / {DEN}) + greatest(ell, 1)"))
    star = star.groupBy("a", F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("c"), size.alias("size")).filter(f"{least} * c >= size")
    best = star.groupBy("b").agg(F.max(F.struct("c", -F.col("a"), "a")).alias("x"))
    return written(best.select("x.a", "b"), "pairs")


def _sketch() -> list[Column]:
    """Aggregates of ``token`` by document: bits of a fixed number, one of them set for each token."""
    return [F.expr(f"bit_or(if((shiftright(token, 24) & {SKETCH - 1}) = {k}, shiftleft(1L, cast(shiftright(token, 32) & 63 as int)), 0L))").alias(f"s{k}") for k in range(SKETCH)]


_SKETCHED = ["most", "spare", *(f"s{k}" for k in range(SKETCH))]


def _may_share(x: str, y: str) -> Column:
    """Whether two sets (columns that begin with ``x`` and ``y``) may share enough, by their sketches.

    Shared tokens set bits that both sketches have.  They are more than those bits only by tokens that meet on a bit, of
    which neither set has more than ``spare``: its number of tokens less that of its bits.
    """
    bits = " + ".join(f"bit_count({x}s{k} & {y}s{k})" for k in range(SKETCH))
    return F.expr(f"{NUM + DEN} * ({bits} + least({x}spare, {y}spare)) >= {NUM} * ({x}n + {y}n)")


def _met(classed: DataFrame, condition: Column, more: list[str] | None = None) -> DataFrame:
    """Pairs of documents of different classes that share as many prefix tokens as the probe asks for, and by how much they may be more similar than need be.

    ``classed`` also has ``own``: the place of a token in its prefix among the tokens that no other class has, and
    ``able``: the most tokens that the document can share with another class at all.  Tokens have one order, so what
    two sets share past the last token that both prefixes have is at most what is left of either; pairs that cannot
    reach the required number that way go too.  The same holds for what lies before a shared token: a token of either
    prefix there that no other class has is not shared, and a pair for which that leaves too few is not even formed.
    ``condition`` is one more on x_* and y_*, which also have the columns ``more``.
    """
    side = {x: classed.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("doc", "n", "pos", "own", "lev", "ell", "class", "main", "able", "crowd", *(more or [])))) for x in "xy"}
    # x is outside its token's main class, y anywhere; pairs of two outsiders come up from both sides and count once.
    met = side["x"].filter("x_class != x_main").join(side["y"], "token").filter("x_class != y_class and (y_class = y_main or x_doc < y_doc)").filter(condition)
    x_longer = F.expr("(x_n > y_n) or (x_n = y_n and x_doc > y_doc)")

    def both(c: str) -> tuple:
        x, y = F.col(f"x_{c}"), F.col(f"y_{c}")
        return F.when(x_longer, x).otherwise(y), F.when(x_longer, y).otherwise(x)

    (p, s), (pn, sn), (pp, sp), (ell, _), (_, lev) = both("doc"), both("n"), both("pos"), both("ell"), both("lev")
    met = met.filter((ell > 0) & (lev > 0) & (lev <= ell) & (DEN * sn >= NUM * pn))
    # Of either, only as many first tokens count as this pair's own requirement asks for.
    for x in "xy":
        met = met.filter((NUM + DEN) * (F.col(f"{x}_n") - F.col(f"{x}_pos") + ell - 1) >= NUM * (F.col("x_n") + F.col("y_n")))
    before, after = (F.least(F.expr(f"x_{a} - x_{b}"), F.expr(f"y_{a} - y_{b}")) for a, b in (("pos", "own"), ("n", "pos")))
    met = met.filter((NUM + DEN) * F.least(before + after, "x_able", "y_able") >= NUM * (F.col("x_n") + F.col("y_n")))
    met = met.select(s.alias("a"), p.alias("b"), ell.alias("ell"), sn.alias("an"), pn.alias("bn"), sp.alias("ap"), pp.alias("bp"))
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *(F.max(x).alias(x) for x in ("ell", "an", "bn", "ap", "bp")))
    most = F.col("c") + F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) - 1
    margin = ((NUM + DEN) * most - NUM * (F.col("an") + F.col("bn"))).cast("long").alias("margin")
    return pairs.filter(F.col("c") >= F.col("ell")).select("a", "b", margin).filter("margin >= 0")


def _crowd_tokens(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, token of the whole sets of the documents in ``crowd`` (doc); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(column(batch, "doc").to_pylist(), column(batch, "tokens")):
                tokens = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(tokens.size, doc, np.int64)), pa.array(tokens)], names=["doc", "token"])

    sets = _sets(docs, crowd)
    own = sets.join(crowd.select("doc"), "doc", "left_semi")
    out = written(own.mapInArrow(run, "doc long, token long"), "crowd-tokens", texts=True, compression="zstd")
    removed(sets)
    return out


def _crowded(classed: DataFrame) -> DataFrame:
    """The tokens that would form more than ``CROWD`` pairs."""
    per = classed.groupBy("token").agg(F.count(F.lit(1)).alias("all"), F.sum(F.expr("cast(class != main as long)")).alias("out"))
    return per.filter(F.col("out") * F.col("all") > CROWD).select("token")


def _candidates(classed: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of documents of different classes that may be similar, none of the similar ones missing; written.

    A token is crowded if documents outside its main class times all its documents exceed ``CROWD``; the crowd are the
    documents that have such a token in their prefix.  A pair that is not inside the crowd shares no crowded token, so
    the other tokens find it, each with a bounded number of pairs.  For the crowd, tokens of whole sets are counted
    among the crowd.  A token that one class has is shared with no other.  Tokens that ``FEW`` documents at most have
    are joined, which gives a bounded number of pairs for each, and a pair stands only if what it shares of these and
    the common tokens of either together reach what is required.  A pair that shares none of these must reach it with
    common tokens alone; few documents can, and only those are joined by prefix.  In a group of copies that were
    edited one by one, edits are tokens of few.  What two such copies lack of the text that they were made from differs
    too: sketches of what each shares with other classes keep most pairs that lack too much together from being formed.
    """
    before = Window.partitionBy("doc").orderBy("pos")
    classed = classed.withColumn("own", F.col("pos") - F.row_number().over(before) + 1)
    crowded = written(_crowded(classed), "crowded")
    crowd = written(classed.join(crowded, "token", "left_semi").groupBy("doc").agg(F.max("n").alias("n"), F.max("class").alias("class")), "crowd")

    flagged = classed.join(crowd.select("doc", F.lit(True).alias("crowd")), "doc", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    sparse = _met(flagged.join(crowded, "token", "left_anti").withColumn("able", F.col("n")), F.expr("not (x_crowd and y_crowd)"))

    tokens = _crowd_tokens(crowd, docs)
    held = tokens.join(crowd.select("doc", "class"), "doc")
    per = held.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("least"), F.max("class").alias("most")).filter("least < most").select("token", "c")
    shared = written(tokens.join(per, "token"), "crowd-shared", compression="zstd")
    few = shared.filter(f"c <= {FEW}").select("token", "doc")
    known = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("most"), F.sum(F.expr(f"cast(c > {FEW} as long)")).alias("able"), *_sketch())
    spare = F.expr("most - (" + " + ".join(f"bit_count(s{k})" for k in range(SKETCH)) + ")").alias("spare")
    known = written(known.select("*", spare).join(crowd, "doc"), "crowd-known")
    # Only documents that can be similar to any other at all.
    rows = few.join(known.filter(f"{DEN} * most >= {NUM} * n"), "doc")
    side = {x: rows.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("doc", "n", "class", "able", *_SKETCHED))) for x in "ab"}
    joined = side["a"].join(side["b"], "token").filter(f"a_doc < b_doc and a_class != b_class and {NUM + DEN} * least(a_most, b_most) >= {NUM} * (a_n + b_n)").filter(_may_share("a_", "b_"))
    joined = joined.groupBy(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(F.expr(f"{NUM} * (a_n + b_n) - {NUM + DEN} * least(a_able, b_able)")).alias("short"))
    by_few = joined.select("a", "b", F.expr(f"cast({NUM + DEN} * c - short as long)").alias("margin")).filter("margin >= 0")
    able = classed.join(known.filter(f"{DEN} * able >= {NUM} * n").select("doc", "able", *_SKETCHED), "doc").withColumn("crowd", F.lit(True))
    by_common = _met(able, _may_share("x_", "y_"), _SKETCHED)
    every = sparse.union(by_few).union(by_common)
    return written(every.groupBy("a", "b").agg(F.max("margin").alias("margin")), "pairs")


def _linked(pairs: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes ``known``, joined by all similar pairs among ``pairs`` (a, b, margin) between different ones.

    Each document's most promising pair goes first.  Pairs inside a class that has come together need no check; in the
    last round all that are left are checked.
    """
    for turn in range(FIRST_TURNS + 1):
        if turn:
            for x in "ab":
                pairs = pairs.join(known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
            # A pair that has been checked without being similar is checked again at most once, at the end.
            pairs = written(pairs.filter("ca != cb").select("a", "b", "margin"), "pairs")
        own = pairs
        if turn < FIRST_TURNS:
            best = [pairs.groupBy(x).agg(F.max(F.struct("margin", F.xxhash64("a", "b", F.lit(turn)).alias("h"), y)).alias("m")).select(F.col(x), f"m.{y}") for x, y in ("ab", "ba")]
            own = written(best[0].select("a", "b").union(best[1].select("a", "b")).distinct(), "pairs")
        known = _joined(known, _verified(own.select("a", "b"), docs))
    return known


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = _profiles(docs)
    again = profiles.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if again.isEmpty():
        return _classes_of(docs, profiles)
    # Ids repeat: rows get numbers, and those of one id are linked besides.
    rows = keyed(docs.filter("doc_id is not null")).select("key", "row.doc_id", "row.text")
    numbered = rows.select(F.col("key").alias("doc_id"), "text")
    found = written(_classes_of(numbered, _profiles(numbered)), "classes")
    named = found.select(F.col("doc_id").alias("key"), "n_shingles", "component_id").join(rows.select("key", "doc_id"), "key")
    same = named.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("a"))
    links = named.filter("n_shingles > 0").select("doc_id", F.col("component_id").alias("b")).join(same, "doc_id").select("a", "b").distinct()
    both = components(links).withColumnRenamed("component", "joined")
    named = named.join(both, F.col("component_id") == F.col("node"), "left").withColumn("joined", F.coalesce("joined", "component_id")).drop("node")
    full = named.filter("n_shingles > 0").select("doc_id", "joined").distinct()
    name = full.groupBy("joined").agg(F.min("doc_id").alias("least"))
    of = full.join(name, "joined").select("doc_id", "least")
    named = named.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    none = profiles.filter("chunk is null and doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.union(none)


def _classes_of(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``similar_classes`` where no ``doc_id`` repeats."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_levels(_merged(profiles.filter("chunk is not null").select("chunk", "data"), np.add)))
    rows = profiles.filter("chunk is null").select("doc_id", "n", "f1", "f2")
    full = rows.filter("n > 0 and doc_id is not null")
    groups = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = full.join(groups.filter("copies > 1"), ["n", "f1", "f2"]).select(F.col("doc_id").alias("doc"), "rep").filter("doc != rep").distinct()
    copies = written(copies, "copies")

    prefixes = _prefixes(docs, levels)
    several = written(_held_by_several(_maybe_shared(prefixes)), "prefixes", compression="zstd")
    removed(prefixes)
    likely = several.join(copies.select("doc"), "doc", "left_anti")
    met = likely.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("lev").alias("i"), F.max("ell").alias("p")).filter("df > 1 and i > 0 and p > 0").select("token", "df")
    shared = written(likely.join(met, "token"), "shared", compression="zstd")
    removed(several)
    # How common a document's tokens are: in a group of copies of one text, each edited by itself, that text stands out,
    # as its tokens are in all copies, and it may be the only one that all of them are similar to.
    score = written(shared.groupBy("doc").agg((F.sum("df") / F.max("n")).alias("score")), "scores")
    scored = written(shared.drop("df").join(score, "doc"), "shared", compression="zstd")
    removed(shared)
    shared = scored

    # Two rounds of one check at most for each document, then all candidates between different classes.
    known = None
    for turn in range(TURNS):
        classed, main = _classes(shared, known, turn)
        known = _joined(known, _verified(_stars(classed, main), docs))
    classed, _ = _classes(shared, known, 0)
    classed = written(classed, "classed", compression="zstd")
    # In groups that are crowded still, more rounds, as long as they find links: first with the documents whose tokens are
    # most common, as the first round's classes have come together meanwhile.
    crowded = written(_crowded(classed), "crowded")
    if not crowded.isEmpty():
        small = written(shared.join(crowded, "token", "left_semi"), "crowded-rows")
        for turn in range(MORE_TURNS):
            own, main = _classes(small, known, turn and TURNS + turn)
            found = _verified(_stars(own, main, 100), docs)
            if found.isEmpty():
                break
            known = _joined(known, found)
        removed(small)
        removed(classed)
        classed = written(_classes(shared, known, 0)[0], "classed", compression="zstd")
    removed(shared)
    both = _linked(_candidates(classed, docs), known, docs)
    removed(classed)

    named = full.join(groups, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "rep")
    named = named.join(both, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.union(alone)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))
