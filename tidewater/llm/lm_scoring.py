"""Operator 1: scoring texts with a causal self-attention model on subword ids.

A text is its words, lower-cased, and an end.  Each word, with a leading space, is a
sequence of subword ids of a public vocabulary; an id with a leading space begins the
next word.  The model (``attention``) is trained in numpy; its softmax gives every
next id's probability, without any table of n-grams.  A text's score is the log10
probability of all its ids and its end.

Scoring cuts a text into windows of ``WINDOW`` ids that overlap; each window scores the
ids that no earlier one has scored, so each id is scored once and, past the first
window, with ``OVERLAP`` ids of context at least.  Windows of many texts are attended to
together, as masked batches.

What is learned:

* One pass over all documents encodes them and writes their ids, from which all else is
  read.  Of training documents it counts all words (for ``base_score``) and all subword
  ids (the order of the softmax and its first biases), and keeps all windows of all
  training documents.
* Training begins on the driver with the ``SEED_WINDOWS`` windows whose hashes are least.
  Then, in ``ROUNDS`` rounds, executors train on all windows, each in one round: each task takes Adam
  steps from the common parameters over its own windows, some at a time, and for every row of the
  parameters the tasks' moves are averaged by how often each task moved it.  So steps,
  tasks and data grow with the corpus; what the driver holds is bounded by the vocabulary.

An id that training never saw shares one entry of the softmax evenly with all such ids.
The probabilities of all continuations sum to one, so scores compare with those of any
other model of words and ends.

For ``base_score`` the counts of frequent words are sent to the executors (at most
``WORDS``, a cache that changes no result); each occurrence of another word is a row
that is joined with all counts.  A word is told apart by 128 bits of hash of its ids,
which spell it exactly.

Defined cases: a null or empty text is its end alone; without training documents all
ids are equally likely; a null ``doc_id`` trains and is not held out; repeated rows
train and are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from . import wordhash as wh
from .attention import Net, windows
from .common import column, slices, table, written
from .encode import BYTE, encoder

VOCABULARY = "byte_bpe_50k.json"
#: One window in SHARE trains the model: all of them.
SHARE = 1
SEED_WINDOWS, SEED_STEPS, SEED_RATE = 16_384, 1500, 0.01
ROUNDS, ROUND_RATE = 2, 0.008
#: Windows that a training task has, about, if there are that many, and at most at once; windows in one of its steps.
TASK_WINDOWS, ROUND_BATCH = 4096, 128
#: Words whose counts are sent to the executors, and words that a worker remembers.
WORDS, KEPT_WORDS = 500_000, 700_000
#: Numbers in a piece of the parameters.
PIECE = 8192


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# -- words and ids --------------------------------------------------------------------


def lower_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and lengths of the words of A-Z-lower-cased texts, and each text's first word with an end."""
    buf, at = wh.padded([t.lower() for t in texts], b"\n")
    starts, lens = wh.words(buf, int(at[-1]))
    return buf, starts, lens, np.searchsorted(starts, at)


def marks(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64 bits of each word's first and last eight bytes and its length, apart from its hash."""
    last = wh.first8(buf, starts + np.maximum(lens - 8, 0), lens)
    return wh.first8(buf, starts, lens) * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F) + lens.astype(np.uint64)


def word_keys(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each word's ids; words begin at ``first``."""
    if not first.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(ids.size)
    place -= np.repeat(first, np.diff(np.append(first, ids.size)))
    x = wh.mix((ids.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
    y = wh.mix(x * np.uint64(0xD6E8FEB86659FD93))
    return np.add.reduceat(x, first).view(np.int64), np.add.reduceat(y, first).view(np.int64)


class Speller:
    """The subword ids of words; remembers at most ``KEPT_WORDS`` words, which have consecutive rows."""

    def __init__(self, vocabulary: str):
        self.coder = encoder(vocabulary, BYTE)
        self.coder.most = 1 << 17  # whole words are kept here
        self.end, self.start = self.coder.token_len.size, self.coder.token_len.size + 1
        self.clear()

    def clear(self) -> None:
        self.table = wh.Table(16)
        self.mark, self.keys = np.zeros(1024, np.uint64), np.zeros((2, 1024), np.int64)
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    @property
    def full(self) -> bool:
        return self.table.size > KEPT_WORDS

    def rows(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Each word's row; rows from the table's former size on are new."""
        h, g = wh.hash_spans(buf, starts, lens), marks(buf, starts, lens)
        rows = self._find(h, g)
        miss = np.flatnonzero(rows < 0)
        if miss.size:
            order = miss[np.lexsort((g[miss], h[miss]))]
            first = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]))
            self._learn(buf, starts[order[first]], lens[order[first]], h[order[first]], g[order[first]])
            rows[miss] = self._find(h[miss], g[miss])
        return rows

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        rows = self.table.find(h)
        other = np.flatnonzero((rows >= 0) & (self.mark[rows] != g))
        if other.size:  # another word has this hash: its row is kept under a second one
            again = self.table.find(wh.mix(h[other] ^ g[other]))
            again[(again >= 0) & (self.mark[again] != g[other])] = -1
            rows[other] = again
        return rows

    def _learn(self, buf, starts, lens, h, g) -> None:
        data = buf.tobytes()
        ids, at = self.coder.encode([b" " + data[s : s + n] for s, n in zip(starts.tolist(), lens.tolist())])
        taken = np.concatenate([[False], h[1:] == h[:-1]]) | (self.table.find(h) >= 0)
        rows = self.table.add(np.where(taken, wh.mix(h ^ g), h))
        size = self.table.size
        if size > self.mark.size:
            grown = lambda x: np.concatenate([x, np.zeros((*x.shape[:-1], size), x.dtype)], axis=-1)
            self.mark, self.keys, self.starts, self.lens = map(grown, (self.mark, self.keys, self.starts, self.lens))
        need = self.used + ids.size
        if need > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros(need, np.int32)])
        self.ids[self.used : need] = ids
        self.mark[rows] = g
        self.keys[:, rows] = word_keys(ids, at[:-1])
        self.starts[rows], self.lens[rows] = self.used + at[:-1], np.diff(at)
        self.used = need

    def spelled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's closed by the end, and the texts' first places with a final end."""
        n = self.lens[rows]
        cut = np.concatenate([[0], np.cumsum(n)])[first]
        return np.insert(self.ids[wh.spread(self.starts[rows], n)].astype(np.int64), cut[1:], self.end), cut + np.arange(cut.size)


_SPELLERS: dict[str, Speller] = {}


def speller_of(vocabulary: str) -> Speller:
    """One for each Python worker."""
    if vocabulary not in _SPELLERS:
        _SPELLERS[vocabulary] = Speller(vocabulary)
    return _SPELLERS[vocabulary]


# -- one pass over the documents --------------------------------------------------------------

WORD, ID, WINDOW, TEXT = 0, 1, 2, 3


def _gathered(docs: DataFrame, vocabulary: str) -> DataFrame:
    """kind, h, g, c, data from ``docs`` (doc_id, text, held); written.

    Of training documents' words the two keys and the count; of their ids the id (h) and its count; of their windows the
    hash, the place from which they score, 1 for one that is in the share that trains, and the ids (int32), with the two
    before them.  A task keeps its ``SEED_WINDOWS`` least windows besides the share.  Of each text ``doc_id``, whether it
    is held out, the number of words, and all its ids with the end (int32).
    """
    names = ["kind", "h", "g", "c", "data"]

    def rows(kind: int, h, g, c, data: list | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(data, pa.binary()) if data is not None else pa.nulls(len(h), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = speller_of(vocabulary)
        counts, often = np.zeros(speller.mark.size, np.int64), np.zeros(speller.end + 1, np.int64)
        low: list[tuple[int, int, bytes]] = []  # a heap of the least windows, by negative hash

        def words() -> pa.RecordBatch:
            used = np.flatnonzero(counts)
            out = rows(WORD, *speller.keys[:, used], counts[used])
            counts[:] = 0
            return out

        for batch in batches:
            for part, texts in slices(batch, most=1 << 20):
                if speller.full:
                    yield words()
                    speller.clear()
                buf, starts, lens, first = lower_words(texts)
                of = speller.rows(buf, starts, lens)
                ids, at = speller.spelled(of, first)
                wide, n = ids.astype(np.int32), np.diff(first)
                held = column(part, "held").to_numpy(zero_copy_only=False)
                yield rows(TEXT, column(part, "doc_id"), held.astype(np.int64), n, [wide[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())])
                if counts.size < speller.mark.size:
                    counts = np.concatenate([counts, np.zeros(speller.mark.size - counts.size, np.int64)])
                found = np.bincount(of[~np.repeat(held, n)], minlength=1)
                counts[: found.size] += found
                often += np.bincount(ids[~np.repeat(held, np.diff(at))], minlength=often.size)
                text, begin, since = windows(np.diff(at))
                key = np.array([zlib.crc32(t) for t in texts], np.uint64)[text] << np.uint64(32)
                key = (wh.mix(key ^ begin.astype(np.uint64)) >> np.uint64(1)).view(np.int64)
                lo = begin + at[text]
                hi = np.minimum(lo + attention.WINDOW, at[1:][text])
                cut = lambda i: (np.int32([speller.start] * 2).tobytes() if not begin[i] else wide[lo[i] - 2 : lo[i]].tobytes()) + wide[lo[i] : hi[i]].tobytes()
                share, trains = key % SHARE == 0, ~held[text]
                kept = np.flatnonzero(share & trains)
                if kept.size:
                    yield rows(WINDOW, key[kept], since[kept], np.ones(kept.size, np.int64), [cut(i) for i in kept.tolist()])
                most = -low[0][0] if len(low) >= SEED_WINDOWS else np.iinfo(np.int64).max
                for i in np.flatnonzero(~share & trains & (key <= most)).tolist():
                    row = (-int(key[i]), int(since[i]), cut(i))
                    if len(low) < SEED_WINDOWS:
                        heapq.heappush(low, row)
                    elif row > low[0]:
                        heapq.heapreplace(low, row)
        yield words()
        used = np.flatnonzero(often)
        yield rows(ID, used, np.zeros(used.size, np.int64), often[used])
        if low:
            yield rows(WINDOW, [-k for k, _, _ in low], [s for _, s, _ in low], np.zeros(len(low), np.int64), [x for _, _, x in low])

    # The hash that chooses windows is that of a text, so copies are chosen or left together.
    made = docs.select("doc_id", "text", "held").mapInArrow(run, "kind byte, h long, g long, c long, data binary")
    return written(made, "gathered", texts=True, compression="zstd")


# -- training -----------------------------------------------------------------------------------


@dataclass
class Model:
    """All that a worker needs: the net, the rank of each id, how many ids share the last rank, and how many words and ends trained."""

    vocabulary: str
    net: Net
    rank: np.ndarray
    unseen: int
    tokens: int
    distinct: int
    ends: int


def _ranked(data: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    return [rank[np.frombuffer(x, np.int32)] for x in data]


def _pieces(name: str, x: np.ndarray) -> Iterator[tuple[str, slice]]:
    step = max(1, PIECE // (x.size // max(1, x.shape[0])))
    for lo in range(0, x.shape[0], step):
        yield f"{name}:{lo}", slice(lo, lo + step)


def _round(net: Net, rank: np.ndarray, rows: DataFrame, rate: float) -> None:
    """Each task trains on its own windows (g, data) from ``net``; their moves are averaged into it."""
    shared = rows.sparkSession.sparkContext.broadcast((net, rank))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        own, adam = Net({k: v.copy() for k, v in common.params.items()}, common.cuts), None
        since, data = [], []

        def learn() -> attention.Adam:
            return attention.train(own, _ranked(data, rank), np.array(since), -(-len(data) // ROUND_BATCH), rate, least=0.3, warm=10, batch=ROUND_BATCH, adam=adam)[0]

        for batch in batches:
            for lo in range(0, len(batch), TASK_WINDOWS):
                part = batch.slice(lo, TASK_WINDOWS)
                since += column(part, "g").to_pylist()
                data += column(part, "data").to_pylist()
                if len(data) >= TASK_WINDOWS:
                    adam, since, data = learn(), [], []
        if data:
            adam = learn()
        if adam is None:
            return
        out = []
        for name, x in own.params.items():
            times, moved = adam.moved[name], x - common.params[name]
            moved *= times.reshape(-1, *[1] * (x.ndim - 1))
            out += [(key, times[at].tobytes(), moved[at].tobytes()) for key, at in _pieces(name, x) if times[at].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2))], names=["piece", "times", "moved"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for key, *more in zip(column(batch, "piece").to_pylist(), column(batch, "times").to_pylist(), column(batch, "moved").to_pylist()):
                more = [np.frombuffer(x, np.float32).astype(np.float64) for x in more]
                sums[key] = [a + b for a, b in zip(sums[key], more)] if key in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *(pa.array([x[i].tobytes() for x in sums.values()], pa.binary()) for i in (0, 1))], names=["piece", "times", "moved"])

    schema = "piece string, times binary, moved binary"
    for row in rows.mapInArrow(fit, schema).repartition("piece").mapInArrow(add, schema).collect():  # one set of parameters
        name, lo = row["piece"].split(":")
        times, moved = (np.frombuffer(row[c]) for c in ("times", "moved"))
        x = net.params[name][int(lo) : int(lo) + times.size]
        x += (moved.reshape(x.shape) / np.maximum(times, 1).reshape(-1, *[1] * (x.ndim - 1))).astype(np.float32)


def train(gathered: DataFrame, vocabulary: str = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model from what ``gather`` gives, and all words' counts (h, g, c); written."""
    counts = written(gathered.filter(F.col("kind") == WORD).groupBy("h", "g").agg(F.sum("c").alias("c")), "counts")
    coder = encoder(vocabulary, BYTE)
    size = coder.token_len.size
    often = np.zeros(size + 1, np.int64)
    for row in gathered.filter(F.col("kind") == ID).groupBy("h").agg(F.sum("c").alias("c")).collect():  # at most one for each id
        often[row["h"]] = row["c"]
    order = np.argsort(-often, kind="stable")
    seen = int((often > 0).sum())
    rank = np.full(size + 2, seen, np.int64)
    rank[order[:seen]] = np.arange(seen)
    rank[size + 1] = seen + 1  # the start of a text
    net = Net.start(np.append(often[order[:seen]], 0))
    kept = gathered.filter(F.col("kind") == WINDOW)
    seeds = at_most(kept, "h", SEED_WINDOWS, least=True).select("g", "data", "h").collect()  # at most SEED_WINDOWS rows
    if seeds:
        seeds.sort(key=lambda r: (r["h"], bytes(r["data"])))
        attention.train(net, _ranked([r["data"] for r in seeds], rank), np.array([r["g"] for r in seeds]), SEED_STEPS, SEED_RATE, least=0.2)
        share = kept.filter("c = 1").select("h", "g", "data")
        for turn in range(ROUNDS):
            own = share.filter(F.pmod(F.xxhash64("h", "data"), F.lit(ROUNDS)) == turn)
            _round(net, rank, own.coalesce(own.count() // TASK_WINDOWS + 1), ROUND_RATE * (1 - turn / ROUNDS))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d")).first()
    ends = int(often[size])
    return Model(vocabulary, net, rank, size + 1 - seen, total["n"] + ends, total["d"] + (ends > 0), ends), counts


def at_most(df: DataFrame, number: str, most: int, least: bool = False) -> DataFrame:
    """The rows of ``df`` with the highest (or least) numbers: all from (or up to) the last number that at most ``most`` rows reach.

    Numbers are binned by eighths of a binary order, so the driver sees some hundred counts.
    """
    cell = F.floor(F.log2(F.col(number) + 1.0) * 8).cast("int")
    bins = sorted(df.groupBy(cell.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["b"] if least else -r["b"])
    total, last = 0, None
    for r in bins:
        total += r["n"]
        if total > most:
            break
        last = r["b"]
    return df.filter(F.lit(False) if last is None else cell <= last if least else cell >= last)


# -- scoring ---------------------------------------------------------------------------------------


@dataclass
class Cache:
    """Keys and counts of frequent words."""

    h: np.ndarray
    g: np.ndarray
    c: np.ndarray
    table: tuple | None = None

    def ready(self) -> tuple[wh.Table, np.ndarray, np.ndarray]:
        """A table of first keys, and by its rows second keys and logarithms; made once in each worker.

        Of words that share a first key only one is in the cache; the second key tells which.
        """
        if self.table is None:
            h, first = np.unique(self.h.view(np.uint64), return_index=True)
            known = wh.Table(16)
            known.add(h)
            self.table = known, np.append(self.g[first], 0), np.append(np.log10(self.c[first] + 1.0), 0)
        return self.table


def score(gathered: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, held_out for every text of ``gathered``."""
    often = at_most(counts, "c", WORDS).toArrow()  # at most WORDS rows
    cache = Cache(*(np.ascontiguousarray(often.column(c).to_numpy()) for c in ("h", "g", "c")))
    begins = np.zeros(model.rank.size, bool)
    for token, i in encoder(model.vocabulary, BYTE).full.get_vocab().items():
        begins[i] = token.startswith(encoder(model.vocabulary, BYTE).space)
    begins[model.rank.size - 2] = True  # the end
    shared = gathered.sparkSession.sparkContext.broadcast((model, cache, begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, begins = shared.value
        known, g, logs = cache.ready()
        number = TaskContext.get().partitionId() << 36
        end, end_known, end_log, rest = model.rank.size - 2, int(model.ends > 0), np.log10(model.ends + 1.0), np.log10(max(model.unseen, 1))
        names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "h", "g"]
        none = lambda t, k: pa.nulls(k, t)
        for batch in batches:
            for part, data in slices(batch, "data", 1 << 20):
                cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])])
                ids = np.frombuffer(b"".join(data), np.int32)
                ranks = model.rank[ids]
                scores = model.net.score(ranks, cut)
                doc = np.arange(len(data))
                odd = np.flatnonzero(ranks == model.net.size - 1)
                scores -= rest * np.bincount(np.searchsorted(cut, odd, "right") - 1, minlength=doc.size)
                # Words lie between ids that begin one; a text's end is no word.
                first = np.flatnonzero(begins[ids])
                key, mark = word_keys(ids, first)
                word = ids[first] != end
                key, mark, of = key[word], mark[word], np.repeat(doc, column(part, "c").to_numpy())
                at = known.find(key.view(np.uint64))
                hit = (at >= 0) & (g[at] == mark)
                found = np.bincount(of[hit], minlength=doc.size) + end_known
                base = np.bincount(of[hit], logs[at[hit]], minlength=doc.size) + end_log
                row, miss = number + doc, np.flatnonzero(~hit)
                yield pa.RecordBatch.from_arrays([pa.array(row), column(part, "h"), pa.array(column(part, "g").to_numpy() == 1), pa.array(column(part, "c").to_numpy() + 1), pa.array(found), pa.array(base), pa.array(scores), pa.array(wh.mix(row.astype(np.uint64)).view(np.int64)), none(pa.int64(), doc.size)], names=names)
                if miss.size:
                    yield pa.RecordBatch.from_arrays([pa.array(row[of[miss]]), *(none(t, miss.size) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(key[miss]), pa.array(mark[miss])], names=names)
                number += doc.size

    # One row for each text, with a hash of its own, and one for each occurrence of a word that is not in the cache.
    texts = gathered.filter(F.col("kind") == TEXT).select("h", "g", "c", "data")
    made = texts.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, h long, g long")
    whole = made.join(counts, ["h", "g"], "left").groupBy("row").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "score")),
        (F.max("known") + F.count("c")).alias("n_known"),
        (F.max("logs") + F.sum(F.coalesce(F.log10(F.col("c") + 1.0), F.lit(0.0)))).alias("logs"),
    )
    space = F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * space).alias("base_score"), "score", "held_out")


def gather(docs: DataFrame, held: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """What training and scoring read of ``docs`` (doc_id, text); rows for which ``held`` is true do not train."""
    return _gathered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held")), vocabulary)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    gathered = gather(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
    return score(gathered, *train(gathered))
