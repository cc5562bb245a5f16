"""Operator 4: token ids as a compact binary file.

Each text is encoded, an end id appended, and the ids of all documents, in
ascending ``doc_id`` order, are written as blocks.  In a block, ids are replaced
by their frequency rank there (0 for the most frequent; ties by id) and coded
with one to four bytes each; two-bit lengths stand apart in control bytes, four
to a byte.  Decoding is numpy table lookup.  Every block stands alone.

Block (little-endian): ``TWT1``, u32 documents, u64 ids, u32 ranked ids, u64 data
bytes; then i64 doc ids, u8 doc-id-is-null flags, u64 ids per document, u32 ids by
rank, control bytes, data bytes; last, u32 crc32 of all that stands before.

Blocks are rows of a Parquet table in the shared folder, so Spark's committer
makes retried and speculative tasks safe and any store that Spark reaches will do.

Defined cases: a null or empty text has the end id alone; documents with null
``doc_id`` come first; repeated rows are documents of their own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, partitions, slices, table, written
from .encode import WORD, encoder

MAGIC = b"TWT1"
HEAD = struct.Struct("<4sIQIQ")
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
VOCABULARY, END_ID = "word_bpe_49k.json", 2

#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block; ``ids`` holds the documents' ids one after another."""
    ids = np.ascontiguousarray(ids, np.uint32)
    distinct, back, often = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -often))
    rank = np.empty(distinct.size, np.uint32)
    rank[order] = np.arange(distinct.size, dtype=np.uint32)
    values = rank[back]
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-ids.size // 4) * 4, np.uint8)
    padded[: ids.size] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) <= code[:, None]]
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join(
        (
            HEAD.pack(MAGIC, len(doc_ids), ids.size, distinct.size, data.size),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            nulls.tobytes(),
            np.asarray(counts, "<u8").tobytes(),
            distinct[order].astype("<u4").tobytes(),
            control.astype(np.uint8).tobytes(),
            data.tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes | memoryview) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, ids per document and all ids; ValueError if the block is damaged."""
    block = memoryview(block)
    magic, docs, n, ranked, size = HEAD.unpack_from(block)
    if magic != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("not a whole token block")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, counts = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
    by_rank, control, data = take("<u4", ranked), take("u1", -(-n // 4)), take("u1", size)
    lens = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lens, dtype=np.int64)
    starts -= lens
    values = data[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lens > k)
        values[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist())], counts, by_rank[values]


def write_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and returns the written table (shard, block, before, n_docs, n_tokens, payload).

    ``before`` counts the shard's ids in earlier blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(vocabulary, WORD), TaskContext.get().partitionId()
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []
        held = number = before = 0

        def close() -> pa.RecordBatch:
            nonlocal held, number, before
            doc_ids = [d for part in kept for d in part[0]]
            counts = np.concatenate([part[1] for part in kept])
            payload = encode_block(doc_ids, counts, np.concatenate([part[2] for part in kept]))
            n = int(counts.sum())
            row = [[shard], [number], [before], [len(doc_ids)], [n], [payload]]
            kept.clear()
            held, number, before = 0, number + 1, before + n
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "block", "before", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for part, texts in slices(batch, most=1 << 20):
                ids, at = coder.encode(texts)
                ids = np.insert(ids, at[1:], end_id)
                kept.append((column(part, "doc_id").to_pylist(), np.diff(at) + 1, ids))
                held += ids.size
                if held >= block_ids:
                    yield close()
        if kept:
            yield close()

    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(blocks, "shard int, block long, before long, n_docs long, n_tokens long, payload binary"), "token-ids", texts=True, compression="uncompressed")


def read_blocks(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """Decodes written blocks: doc_id, start, n_tokens, ids_crc32 and, if ``ids``, the ids themselves, in blocks' order.

    The prefix sum has two levels: blocks know their place in their shard, and the
    totals of shards (as many as partitions) are summed on the driver.
    """
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, base = 0, {}
    for row in totals:
        base[row["shard"]] = before
        before += row["n"]
    start = F.lit(0).cast("long")
    if base:
        start = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in base.items()) + "}"), "map<string,bigint>"), F.col("shard").cast("string"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in zip(column(batch, "start").to_pylist(), column(batch, "payload")):
                doc_ids, counts, decoded = decode_block(block.as_buffer())
                ends = np.cumsum(counts)
                raw = memoryview(decoded.astype("<u4", copy=False)).cast("B")
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                if ids:
                    cols.append(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(decoded.view(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return blocks.select((start + F.col("before")).alias("start"), "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(write_blocks(table(spark, sf_dir, "documents")), ids=False)
