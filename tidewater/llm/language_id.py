"""Operator 3: language identification by segmentation-marginalised unigrams.

A language is a unigram model over the pieces of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, computed
by the forward algorithm over UTF-8 bytes (single bytes are pieces too, so every
word has one).  Piece probabilities are fitted by expectation-maximisation with the
forward and backward sums on the words of about ``per_language`` labelled
documents of each language at most, chosen by hash: the one bounded sample here.

A text's languages are scored by the sum over all its words.  Words repeat, so a
worker keeps the language scores of those it has seen; new words of a batch go
through the forward algorithm together.  Words are runs of letters (any byte
outside ASCII counts as one), lower-cased, cut every ``BLOCK`` bytes.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or
where nothing was learned; languages without a sampled word are not predicted;
null or unlabelled rows do not teach; repeated rows are scored each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import wordhash as wh
from .common import column, slices, table

VOCABULARY = "byte_bpe_50k.json"
PER_LANGUAGE, ROUNDS, SMOOTH = 400, 4, 0.1
BLOCK, LONGEST = 24, 12
KEPT_WORDS = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def vocabulary_pieces(name_or_path: str = VOCABULARY) -> list[bytes]:
    """Single bytes, and the vocabulary's pieces that are lower-case letters, without their leading space."""
    import json
    import os

    from .encode import tokenizer_path

    path = name_or_path if os.sep in name_or_path else tokenizer_path(name_or_path)
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = {bytes([b]) for b in range(256)}
    for token in tokens:
        raw = bytes(back[c] for c in token if c in back).removeprefix(b" ")
        if 1 < len(raw) <= LONGEST and _LETTER[np.frombuffer(raw, np.uint8)].all():
            pieces.add(raw)
    return sorted(pieces)


class Lattice:
    """Looks up the pieces of many words at once; row ``len(pieces)`` stands for no piece."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        buf, at = wh.padded(pieces)
        self.table = wh.Table(18)
        h = wh.hash_spans(buf, at[:-1], np.diff(at))
        self.table.add(h)

    def spans(self, buf: np.ndarray, starts: np.ndarray, i: int, j: int) -> np.ndarray:
        rows = self.table.find(wh.hash_spans(buf, starts + i, np.full(starts.size, j - i)))
        return np.where(rows < 0, self.size, rows)

    def forward(self, buf, starts, lens, theta, keep: bool = False):
        """Word probabilities (words x languages); with ``keep`` also all sums and spans.  ``lens`` must descend."""
        alpha = np.zeros((int(lens[0]) + 1 if lens.size else 1, starts.size, theta.shape[1]))
        alpha[0] = 1
        spans = {}
        for j in range(1, alpha.shape[0]):
            n = int(np.searchsorted(-lens, -j, "right"))
            for i in range(max(0, j - LONGEST), j):
                rows = self.spans(buf, starts[:n], i, j)
                if keep:
                    spans[i, j] = rows
                alpha[j, :n] += alpha[i, :n] * theta[rows]
        return alpha[lens, np.arange(starts.size)], alpha, spans

    def fit(self, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS, smooth: float = SMOOTH) -> np.ndarray:
        """theta (pieces + 1 x languages) from distinct words and how often each language has them."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        buf, at = wh.padded([words[k] for k in order])
        starts, lens, weight = at[:-1], np.diff(at), counts[order].astype(np.float64)
        theta = np.full((self.size + 1, counts.shape[1]), 1 / self.size)
        theta[-1] = 0
        for _ in range(rounds):
            expected = np.full(theta.shape, smooth)
            expected[-1] = 0
            for lo in range(0, starts.size, 20_000):
                cut = slice(lo, lo + 20_000)
                self._expect(buf, starts[cut], lens[cut], weight[cut], theta, expected)
            theta = expected / expected.sum(axis=0)
        return theta

    def _expect(self, buf, starts, lens, weight, theta, expected) -> None:
        whole, alpha, spans = self.forward(buf, starts, lens, theta, True)
        beta = np.zeros_like(alpha)
        beta[lens, np.arange(starts.size)] = weight / whole
        for (i, j), rows in sorted(spans.items(), key=lambda x: -x[0][1]):
            n = rows.size
            flow = theta[rows] * beta[j, :n]
            beta[i, :n] += flow
            flow *= alpha[i, :n]
            for c in range(theta.shape[1]):
                expected[:, c] += np.bincount(rows, flow[:, c], minlength=expected.shape[0])
        expected[-1] = 0


def letter_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and lengths of the words of lower-cased texts, and each text's first word with a final end."""
    buf, at = wh.padded(texts, b"\n")
    size = int(at[-1])
    ink = np.zeros(size + 2, np.int8)
    ink[1:-1] = _LETTER[buf[:size]]
    step = np.diff(ink)
    starts = np.flatnonzero(step == 1)
    lens = np.flatnonzero(step == -1) - starts
    blocks = -(-lens // BLOCK)
    if (blocks > 1).any():
        k = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        ends = np.repeat(starts + lens, blocks)
        starts = np.repeat(starts, blocks) + k * BLOCK
        lens = np.minimum(BLOCK, ends - starts)
    return buf, starts, lens, np.searchsorted(starts, at)


def _lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode().lower().encode()


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text of about ``per_language`` documents of each language at most.

    A document is in the sample if its hash, as a share of all hashes, is below what
    the language's number of documents asks for, so no language is sorted.
    """
    rows = docs.filter("lang is not null and doc_id is not null and text is not null").select("lang", "doc_id", "text")
    each = rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 31)) / float(1 << 31)
    chosen = rows.join(F.broadcast(each), F.col("lang") == F.col("of"))  # one row for each language
    # Equal texts once, so that a row which is repeated very often is no larger a sample.
    return chosen.filter(share * F.col("n") < per_language).select("lang", "text").distinct()


def train(docs: DataFrame, pieces: list[bytes], per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from labelled ``docs`` (doc_id, lang, text)."""
    found: dict[bytes, dict[str, int]] = {}
    langs: set[str] = set()
    for lang, text in sample(docs, per_language).toLocalIterator():
        buf, starts, lens, _ = letter_words([_lower(text.encode())])
        data = buf.tobytes()
        for s, n in zip(starts.tolist(), lens.tolist()):
            by = found.setdefault(data[s : s + n], {})
            by[lang] = by.get(lang, 0) + 1
        if starts.size:
            langs.add(lang)
    names = sorted(langs)
    counts = np.array([[by.get(x, 0) for x in names] for by in found.values()]).reshape(len(found), len(names))
    return names, Lattice(pieces).fit(list(found), counts) if names else np.zeros((len(pieces) + 1, 0))


def identify(docs: DataFrame, names: list[str], theta: np.ndarray, pieces: list[bytes]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with lang_pred and score; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast((names, theta, pieces))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, theta, pieces = shared.value
        lattice, seen = Lattice(pieces), wh.Table(16)
        scores = np.zeros((1 << 12, len(names)))
        for whole in batches:
            for batch, texts in slices(whole, most=2 << 20):
                if seen.size > KEPT_WORDS:
                    seen = wh.Table(16)
                buf, starts, lens, first = letter_words([_lower(t) for t in texts])
                h = wh.hash_spans(buf, starts, lens)
                rows = seen.find(h)
                miss = np.flatnonzero(rows < 0)
                if miss.size:
                    new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
                    at = miss[at]
                    order = np.argsort(-lens[at], kind="stable")
                    got = seen.add(new)
                    rows[miss] = got[back]
                    if seen.size > scores.shape[0]:
                        scores = np.concatenate([scores, np.zeros((seen.size, len(names)))])
                    for lo in range(0, order.size, 50_000):
                        part = order[lo : lo + 50_000]
                        scores[got[part]] = np.log(lattice.forward(buf, starts[at[part]], lens[at[part]], theta)[0])
                doc = np.repeat(np.arange(len(texts)), np.diff(first))  # sums by text: equal texts get equal ones
                total = np.stack([np.bincount(doc, scores[rows, k], len(texts)) for k in range(len(names))], axis=1) if names else np.zeros((len(texts), 0))
                pred, score = [], []
                for k, text in enumerate(texts):
                    if not names or not (text.upper() != text.lower() if text.isascii() else any(map(str.isalpha, text.decode()))):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    p = np.exp(total[k] - total[k].max())
                    pred.append(names[int(p.argmax())])
                    score.append(float(p.max() / p.sum()))
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = StructType([f for f in docs.schema if f.name in kept])
    return docs.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    pieces = vocabulary_pieces()
    names, theta = train(docs.filter(~held_out), pieces)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), names, theta, pieces).drop("text")
