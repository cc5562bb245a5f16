"""Operator 6: best-fit packing by bin completion.

Documents longer than a sequence are cut into whole sequences, the remainder
first; the pieces that are left are packed without cutting.  What decides a
packing is only how many pieces there are of each length, a histogram as long as
a sequence however large the corpus is.  The driver solves that:

* the incumbent is best-fit decreasing on the histogram, or what a quick search over
  few fillings of each room finds;
* bin completion takes the longest piece left and enumerates all undominated fillings
  of the room beside it, least waste first, and repeats a filling as often as the
  histogram allows, then once;
* a branch is cut when its waste exceeds what a solution with one sequence less
  than the incumbent may waste; the search ends at the lower bound, when nothing is
  left to try (the incumbent is the optimum), or after ``max_nodes`` fillings or
  ``STEPS`` times as many steps of their enumeration, and the incumbent stands.

A plan is a list of (filling, how often).  A piece's rank among those of its length
comes from counts by partition and its place in its partition, so no group of
equal lengths ever meets in one task, and rank and plan fix sequence and offset.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each; null ``doc_id`` is kept; an empty table gives no rows; further columns are
ignored.  Ids come from the vocabulary file given by name or path.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, slices, table, written
from .encode import BYTE, encoder

VOCABULARY, END_ID, CAPACITY, MAX_NODES = "byte_bpe_50k.json", 0, 2048, 20_000
#: Steps of the enumeration for each filling that may be tried.
STEPS = 20
#: Enumerations of fillings that the search keeps; what it finds does not depend on it.
LIVE = 16


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: open sequences are kept by room, equal ones together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                for n, times in ((per, left // per), (left % per, 1)):
                    if n and times:
                        group = open_.setdefault(capacity - n * length, {})
                        group[(length,) * n] = group.get((length,) * n, 0) + times
                break
            fill, times = next(iter(open_[room].items()))
            per = min(room // length, left)
            used = min(times, left // per)
            left -= used * per
            if used == times:
                del open_[room][fill]
            else:
                open_[room][fill] = times - used
            if not open_[room]:
                del open_[room]
            group = open_.setdefault(room - per * length, {})
            new = fill + (length,) * per
            group[new] = group.get(new, 0) + used
    return [(fill, times) for group in open_.values() for fill, times in group.items()]


def _nearest(counts: np.ndarray, below: np.ndarray, room: int, keep: int) -> list[tuple[int, ...]]:
    """Some fillings of ``room``, least waste first, at most ``keep``, for a first packing.

    ``below[r]``: the longest length up to r that is left (0: none).  A filling is
    built around its longest piece; the others are each the longest that fits.
    """
    top = int(below[room])
    if not top:
        return [()]
    first = np.flatnonzero(counts[: top + 1])
    first = first[first > 0]
    rest = room - first
    second = below[np.minimum(rest, first)]
    same = (second == first) & (counts[first] < 2)
    second = np.where(same, below[np.minimum(rest, first - 1)], second)
    third_room = rest - second
    third = below[np.minimum(third_room, second)]
    third = np.where(counts[third] >= 3, third, np.where((third == second) | (third == first), 0, third))
    waste = third_room - third
    order = np.lexsort((-first, waste))[:keep]
    out = []
    for k in order.tolist():
        fill = [int(x) for x in (first[k], second[k], third[k]) if x]
        spare = room - sum(fill)
        while spare and len(fill) >= 3:  # room for yet more: greedily the longest that is left
            x = int(below[spare])
            while x and fill.count(x) >= counts[x]:
                x = int(below[x - 1])
            if not x:
                break
            fill.append(x)
            spare -= x
        out.append(tuple(fill))
    out.sort(key=lambda f: (room - sum(f), len(f), tuple(-x for x in f)))
    return list(dict.fromkeys(out))


def first_plan(counts: np.ndarray, capacity: int, max_nodes: int, branch: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """The best of best-fit decreasing and of a search over few fillings of each room."""
    incumbent = best_fit(counts, capacity)
    best = sum(t for _, t in incumbent)
    total = int((counts * np.arange(counts.size)).sum())
    bound = lower_bound(counts, capacity)
    if best == bound:
        return incumbent
    nodes = 0

    def search(branches: int) -> None:
        nonlocal incumbent, best, nodes
        left, chosen, wasted = counts.copy(), [], 0
        stack: list[tuple[list[tuple[int, ...]], int]] = []

        def expand() -> bool:
            top = np.flatnonzero(left)
            if not top.size:
                return False
            head = int(top[-1])
            left[head] -= 1
            size = np.where(left > 0, np.arange(left.size), 0)
            below = np.maximum.accumulate(size)
            stack.append((_nearest(left, below, capacity - head, branches), head))
            left[head] += 1
            return True

        if not expand():
            return
        while stack:
            options, head = stack[-1]
            if len(chosen) == len(stack):  # coming back from below
                fill, times = chosen.pop()
                for x in fill:
                    left[x] += times
                wasted -= times * (capacity - sum(fill))
            if not options or nodes >= max_nodes or best == bound:
                stack.pop()
                continue
            nodes += 1
            fill = (head, *options.pop(0))
            each: dict[int, int] = {}
            for x in fill:
                each[x] = each.get(x, 0) + 1
            times = min(int(left[x]) // n for x, n in each.items())
            if wasted + times * (capacity - sum(fill)) > (best - 1) * capacity - total:
                times = min(times, max(0, ((best - 1) * capacity - total - wasted) // max(1, capacity - sum(fill))))
            if not times:
                continue
            for x in fill:
                left[x] -= times
            wasted += times * (capacity - sum(fill))
            chosen.append((fill, times))
            if not expand():
                used = sum(t for _, t in chosen)
                if used < best:
                    best, incumbent = used, list(chosen)
                stack.append(([], 0))

    search(1)
    if best > bound:
        search(branch)
    return incumbent


def _fillings(left: list[int], room: int, spend: Callable[[], bool]) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room``, least waste first; ends early when ``spend`` says so.

    A filling is dominated if a piece that stays out fits in its place for some of its pieces and is
    longer than they are together, or as long as two or more.  Sets of sums are the bits of numbers.
    """
    lengths = [x for x in range(1, room + 1) if left[x]]
    if room and left[room]:
        yield (room,)
        return
    if sum(left[x] * x for x in lengths) <= room:
        yield tuple(x for x in reversed(lengths) for _ in range(left[x]))
        return
    full, reach = (1 << (room + 1)) - 1, [1]  # reach[i]: sums of the i shortest lengths
    for x in lengths:
        sums, most, step = reach[-1], min(left[x], room // x), 1
        while most:
            k = min(step, most)
            sums |= (sums << (k * x)) & full
            most, step = most - k, 2 * step
        reach.append(sums)

    def build(j: int, target: int, fill: tuple[int, ...], one: int, more: int, out: int):
        """Fillings with ``target`` more of the ``j`` shortest lengths; ``one``, ``more``: sums of one piece, of several; ``out``: lengths that stay out."""
        if not target:
            yield fill, one | more, out
            return
        for i in range(min(j, bisect_right(lengths, target)) - 1, -1, -1):
            if not reach[i + 1] >> target & 1:
                return
            x = lengths[i]
            for k in range(min(left[x], target // x), 0, -1):
                if not reach[i] >> (target - k * x) & 1:
                    continue
                if not spend():
                    return
                o, m = one, more
                for _ in range(k):
                    m |= (o | m) << x
                    o |= 1 << x
                rest = out & ~(1 << x) if k == left[x] else out
                if not m & rest:
                    yield from build(i, target - k * x, fill + (x,) * k, o, m, rest)

    free = sum(1 << x for x in lengths)
    for target in range(room, 0, -1):
        spare = room - target
        for fill, sums, out in build(len(lengths), target, (), 0, 0, free):
            cover, width = (sums | 1) << 1, 1  # what up to ``spare`` more than some of its pieces, or none, comes to
            while width < spare:
                k = min(width, spare - width)
                cover |= cover << k
                width += k
            if not (spare and cover & out):
                yield fill


def plan(counts: np.ndarray, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for ``counts[length]`` pieces of each length."""
    counts = np.asarray(counts, np.int64)
    incumbent = first_plan(counts, capacity, max_nodes)
    best = sum(t for _, t in incumbent)
    total = int((counts * np.arange(counts.size)).sum())
    bound = lower_bound(counts, capacity)
    left: list[int] = counts.tolist() + [0] * (capacity + 1 - counts.size)
    chosen: list[tuple[tuple[int, ...], int]] = []
    wasted = nodes = steps = 0

    def moves(again: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings for the longest piece left; the first ``again`` have come before and cost no steps."""
        head = max(x for x in range(capacity + 1) if left[x])
        own, done = left.copy(), 0
        own[head] -= 1

        def spend() -> bool:
            nonlocal steps
            steps += done >= again
            return done < again or steps <= STEPS * max_nodes

        for fill in _fillings(own, capacity - head, spend):
            fill = (head, *fill)
            times = min(left[x] // n for x, n in Counter(fill).items())
            for often in (times, 1) if times > 1 else (times,):  # any number between follows from single ones
                done += 1
                if done > again:
                    yield fill, often

    # Of each place in the search its fillings and how many were tried.  Enumerations are large and the search is as deep
    # as there are fillings, so only the last ``LIVE`` are kept; others begin again when the search comes back to them.
    stack: list[tuple[Iterator | None, int]] = [(moves(0), 0)] if best > bound else []
    while stack and best > bound:
        if len(chosen) == len(stack):  # coming back from below
            fill, times = chosen.pop()
            for x in fill:
                left[x] += times
            wasted -= times * (capacity - sum(fill))
        fill, times = (), 0
        if nodes < max_nodes:
            options, tried = stack[-1]
            options = moves(tried) if options is None else options
            fill, times = next(options, ((), 0))
            stack[-1] = options, tried + 1
        waste, may = capacity - sum(fill), (best - 1) * capacity - total - wasted
        if waste and times:
            times = min(times, max(0, may) // waste)
        if not times:  # the next ones waste as much or more
            stack.pop()
            continue
        nodes += 1
        for x in fill:
            left[x] -= times
        wasted += times * waste
        chosen.append((fill, times))
        if any(left):
            stack.append((moves(0), 0))
            if len(stack) > LIVE:
                stack[-LIVE - 1] = None, stack[-LIVE - 1][1]
            continue
        used = sum(t for _, t in chosen)
        if used < best:
            best, incumbent = used, list(chosen)
        stack.append((iter(()), 0))
    return incumbent


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: all ids together, or the pieces of which no two fit in one."""
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(counts.size)).sum())
    return max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))


def _lookup(fills: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks by length: ranks from ``rank`` on lie at ``offset`` in sequences from ``sequence`` on."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for fill, times in fills:
        offset = 0
        for x in fill:
            rows.append((x, int(used[x]), sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), cols.T.copy()))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its partition and its place among the pieces of its length there; written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(vocabulary, BYTE), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, texts in slices(batch):
                ids, at = coder.encode(texts)
                raw = memoryview(np.insert(ids, at[1:], end_id).astype("<u4").tobytes())
                n = np.diff(at) + 1
                of = np.cumsum(n) - n
                per = -(-n // capacity)
                doc = np.repeat(np.arange(n.size), per)
                piece = np.arange(doc.size) - np.repeat(np.cumsum(per) - per, per)
                head = n - (per - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                begin = of[doc] + start
                sums = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                runs = length[order]
                within = np.arange(runs.size) - np.searchsorted(runs, runs)
                place = np.empty(runs.size, np.int64)
                place[order] = seen[runs] + within
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(doc.size, task), pa.int32()), pa.array(place)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
                )

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(typed.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"), "pieces", texts=True)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    cut = pieces(docs, vocabulary, end_id, capacity)
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    runs = _lookup(plan(histogram, capacity, max_nodes), capacity)
    span = int(histogram.max()) + 1
    key = runs["length"] * span + runs["rank"]
    by_task = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(by_task), F.lit(0))).select("task", "length", "before")
    shared = docs.sparkSession.sparkContext.broadcast((key, runs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = shared.value
        for batch in batches:
            length, rank = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * span + rank, "right") - 1
            sequence = runs["sequence"][at] + rank - runs["rank"][at]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(runs["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
