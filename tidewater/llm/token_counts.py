"""Operator 5: how many tokens each section of a document has.

A document is encoded once, as a whole.  Its tokens' spans are joined with its
sections' spans (both sorted, so the interval join is one binary search of all
token ends), and a token that lies in several sections goes to one by rule:

``largest``  the section with most of its bytes, the earlier one of equals;
``first``    the section that holds its first byte;
``last``     the section that holds its last byte.

Spans are of bytes: a token may hold a part of a character, which no span of characters
has.  Sections are the lines, each with its newline.  All tokens go to some section, so
the sections' counts add up to the document's.

Defined cases: a null or empty text is one empty section without tokens; a
trailing newline opens a last, empty section; repeated rows are counted each for
itself; null ``doc_id`` is kept; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, slices, table
from .encode import BYTE, encoder

VOCABULARY = "byte_bpe_50k.json"
RULES = ("largest", "first", "last")


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section and whether it crosses a boundary.

    Both arrays hold ascending ends, counted from 0, of spans that follow one
    another without gaps.
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = first < last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    for t in np.flatnonzero(crossing).tolist():
        ends = np.minimum(section_ends[first[t] : last[t] + 1], token_ends[t])
        chosen[t] = first[t] + int(np.argmax(np.diff(np.concatenate([[starts[t]], ends]))))
    return chosen, crossing


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "largest") -> DataFrame:
    """(doc_id, n_tokens, n_crossing, section_chars, section_tokens) for ``docs`` (doc_id, text)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, BYTE)
        for batch in batches:
            for part, texts in slices(batch):
                ids, at = coder.encode(texts)
                data = np.frombuffer(b"".join(texts), np.uint8)
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                of = np.concatenate([[0], np.cumsum(size)])
                # A section ends after each newline and at each text's end.  All texts lie in one row of bytes; a text's
                # last, empty section has the same end as the one before and so gets no token.
                ends = np.concatenate([np.flatnonzero(data == 10) + 1, of[1:]])
                owner = np.concatenate([np.searchsorted(of, np.flatnonzero(data == 10), "right") - 1, np.arange(len(texts))])
                order = np.lexsort((ends, owner))
                ends, owner = ends[order], owner[order]
                token_ends = np.cumsum(coder.token_len[ids])
                chosen, crossing = allocate(token_ends, ends, rule)
                per = np.bincount(chosen, minlength=ends.size)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                lens = np.diff(np.concatenate([[0], chars[ends]]))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), pa.int32())
                cross = np.concatenate([[0], np.cumsum(crossing)])
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(np.diff(at)), pa.array(cross[at[1:]] - cross[at[:-1]]), pa.ListArray.from_arrays(offsets, pa.array(lens, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(per, pa.int64()))],
                    names=["doc_id", "n_tokens", "n_crossing", "section_chars", "section_tokens"],
                )

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return typed.mapInArrow(count, "doc_id long, n_tokens long, n_crossing long, section_chars array<long>, section_tokens array<long>")


def sections(counted: DataFrame) -> DataFrame:
    """One row for each section: doc_id, section (from 0), chars, tokens."""
    both = F.posexplode(F.arrays_zip(F.col("section_chars").alias("chars"), F.col("section_tokens").alias("tokens")))
    return counted.select("doc_id", both.alias("section", "s")).select("doc_id", "section", "s.chars", "s.tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.col("section_tokens")
    return token_counts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", "n_crossing",
        F.size(tokens).cast("long").alias("n_sections"),
        F.array_max(tokens).alias("max_section_tokens"),
        F.element_at(tokens, 1).alias("first_section_tokens"),
        F.crc32(F.concat_ws(",", F.transform(tokens, lambda x: x.cast("string")))).alias("section_tokens_crc32"),
    )
