"""Operator 7: media columns, typed by what their bytes are.

Signature sniffing: an Aho-Corasick automaton finds every magic number of a
column's bytes in one pass; for each hit a validator walks the format's own
structure (chunks, segments, boxes, checksums) and either returns the length of
a whole object or rejects the hit.  A whole object at byte 0 gives the true type,
whatever the declared one says; whole objects further in are carved, outermost
only.  Bytes without one are ``application/octet-stream``.

``store`` wraps any payload losslessly as a WAVE file of 8-bit samples, so that
each byte is one sample; ``stored_payload`` reads it back from the file's chunks.

Defined cases: null bytes have type null and nothing embedded; a cut-off object is
no object; repeated rows are sniffed each; an empty table gives no rows; further
columns are ignored.  In the query a null text is the empty text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import column, slices, table, written

UNKNOWN = "application/octet-stream"
RATE, UNIT = 8000, 64

# -- validators: the length of the whole object that begins at ``at``, 0 if there is none -------------------
# ``memo`` is empty when a new ``b`` begins; what one hit has found out about the data it keeps for the next ones.


def _png(b: bytes, at: int, memo: dict) -> int:
    p, seen = at + 8, False
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        if not seen and (kind != b"IHDR" or size != 13):
            return 0
        seen = True
        p += 12 + size
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: bytes, at: int, memo: dict) -> int:
    p = at + 2
    while p + 2 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return p + 2 - at
        if kind in (0x01, *range(0xD0, 0xD8)):
            p += 2
            continue
        if kind < 0xC0 or p + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return 0
        p += 2 + size
        if kind == 0xDA:  # compressed data: up to the next marker that is neither stuffing nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return 0


def _gif(b: bytes, at: int, memo: dict) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _bmp(b: bytes, at: int, memo: dict) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, first, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    whole = first + ((width * bits + 31) // 32 * 4) * abs(height)
    return size if 14 + head <= first and whole <= size <= len(b) - at else 0


def _riff(kind: bytes):
    def check(b: bytes, at: int, memo: dict) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        p, found = at + 12, set()
        while p + 8 <= min(end, len(b)):
            name, size = struct.unpack_from("<4sI", b, p)
            found.add(name)
            p += 8 + size + (size & 1)
        need = {b"fmt ", b"data"} if kind == b"WAVE" else {b"VP8 ", b"VP8L", b"VP8X"}
        whole = need <= found if kind == b"WAVE" else bool(need & found)
        return end - at if whole and p == end <= len(b) else 0

    return check


def _gzip(b: bytes, at: int, memo: dict) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    reader = zlib.decompressobj(31)
    p, step = at, 1 << 16
    try:
        while p < len(b) and not reader.eof:
            chunk = reader.decompress(b[p : p + step], 1 << 20)
            while reader.unconsumed_tail and not reader.eof:
                chunk = reader.decompress(reader.unconsumed_tail, 1 << 20)
            p += step
        del chunk
    except zlib.error:
        return 0
    return min(p, len(b)) - len(reader.unused_data) - at if reader.eof else 0


def _zip(b: bytes, at: int, memo: dict) -> int:
    if "zip" not in memo:  # by where an archive begins: where its end record lies
        memo["zip"], p = {}, b.find(b"PK\x05\x06")
        while 0 <= p <= len(b) - 22:
            size, first = struct.unpack_from("<II", b, p + 12)
            memo["zip"].setdefault(p - first - size, []).append(p)
            p = b.find(b"PK\x05\x06", p + 4)
    for p in memo["zip"].get(at, ()):
        first, note = struct.unpack_from("<IH", b, p + 16)
        if p > at and b[at + first : at + first + 4] in (b"PK\x01\x02", b"PK\x05\x06") and p + 22 + note <= len(b):
            return p + 22 + note - at
    return 0


def _ogg(b: bytes, at: int, memo: dict) -> int:
    broken, bare = memo.setdefault("ogg", (set(), set()))  # pages after which one is cut off, or none is a stream's last
    p, last, pages = at, 0, []
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0" and p not in bare:
        kind, n = b[p + 5], b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b) or p + 27 + n > len(b) or p in broken:
            broken.update(pages)
            return 0
        pages.append(p)
        p = end
        if kind & 4:
            last = p
    if not last:
        bare.update(pages)
    return last - at if last else 0


def _pdf(b: bytes, at: int, memo: dict) -> int:
    if memo.get("pdf", at) < 0:
        return 0
    end = memo["pdf"] = b.find(b"%%EOF", at)
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return 0
    return end + 5 - at


#: Boxes at the top of an MP4: what claims to be one and runs past the data is cut off, anything else is what follows the object.
_BOXES = frozenset(b"ftyp styp moov moof mdat meta free skip wide uuid sidx ssix mfra pdin prft emsg imda".split())


def _mp4(b: bytes, at: int, memo: dict) -> int:
    p, moov = at, False
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        head = 8
        if kind in _BOXES and size == 1:  # a 64-bit length follows
            if p + 16 > len(b):
                return 0
            (size,), head = struct.unpack_from(">Q", b, p + 8), 16
        elif kind in _BOXES and size == 0:  # up to the end
            size = len(b) - p
        if size < head or not kind.isalnum():
            break
        if p + size > len(b):
            if kind in _BOXES:
                return 0
            break
        moov |= kind in (b"moov", b"moof", b"meta")
        p += size
    return p - at if moov else 0


#: Magic bytes, how far into the object they stand, type and validator.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "audio/wav", _riff(b"WAVE")),
    (b"RIFF", 0, "image/webp", _riff(b"WEBP")),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"ftyp", 4, "video/mp4", _mp4),
)


def _automaton():
    import ahocorasick

    out, by_magic = ahocorasick.Automaton(), {}
    for magic, back, kind, check in SIGNATURES:
        by_magic.setdefault(magic, []).append((back, kind, check))
    for magic, found in by_magic.items():
        out.add_word(magic.decode("latin-1"), (len(magic), found))
    out.make_automaton()
    return out


class Sniffer:
    """Finds whole objects in bytes; one for each Python worker."""

    def __init__(self) -> None:
        self.automaton = _automaton()

    def hits(self, data: bytes) -> list[tuple[int, list]]:
        """Where objects may begin, ascending, with the types and validators of each place."""
        out: dict[int, list] = {}
        for end, (size, found) in self.automaton.iter(data.decode("latin-1")):
            for back, kind, check in found:
                if (at := end + 1 - size - back) >= 0:
                    out.setdefault(at, []).append((kind, check))
        return sorted(out.items())

    def sniff(self, data: bytes | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The type of ``data`` and the outermost objects embedded in it: (start, length, type).

        At one place the longest object counts; hits inside a carved object are not looked at.
        """
        if data is None:
            return None, []
        whole, carved, end, memo = UNKNOWN, [], 0, {}
        for at, checks in self.hits(data):
            if at and at < end:
                continue
            n, kind = min(((-check(data, at, memo), kind) for kind, check in checks), default=(0, ""))
            if n and not at:
                whole = kind
            elif n:
                carved.append((at, -n, kind))
                end = at - n
        return whole, carved


def store(payload: bytes) -> bytes:
    """``payload`` as the samples of a mono 8-bit WAVE file."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def stored_payload(media: bytes) -> bytes:
    """The samples of a WAVE file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def sniffed(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """``df`` with media_type (true type), corrected (declared type was wrong) and embedded (start, length, type).

    Columns of ``df`` with these names, whatever their case, are replaced.
    """
    added = {"media_type": pa.string(), "corrected": pa.bool_(), "embedded": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))}
    kept = [c for c in df.columns if c.lower() not in added]
    said = df[declared].cast("string") if declared else F.lit(None).cast("string")
    typed = df.select(*kept, said.alias("corrected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            kinds, wrong, found = [], [], []
            for data, claim in zip(column(batch, media), column(batch, "corrected").to_pylist()):
                kind, carved = sniffer.sniff(data.as_py())
                kinds.append(kind)
                wrong.append(None if kind is None or claim is None else kind != claim)
                found.append([{"start": a, "length": n, "type": k} for a, n, k in carved])
            new = [pa.array(v, t) for v, t in zip((kinds, wrong, found), added.values())]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), *new], names=[*kept, *added])

    schema = StructType([f for f in df.schema if f.name in kept])
    return typed.mapInArrow(run, schema.add("media_type", "string").add("corrected", "boolean").add("embedded", ArrayType(StructType().add("start", "long").add("length", "long").add("type", "string"))))


def _feature(payload: bytes, kind: str, carved: list[tuple[int, int, str]]) -> str:
    samples = np.frombuffer(payload, np.uint8)
    parts = [kind, f"{RATE}Hz", f"{samples.size}samples", f"sum={int(samples.sum(dtype=np.int64))}", f"distinct={int((np.bincount(samples, minlength=256) > 0).sum())}"]
    return ";".join(parts + [f"{k}@{a}+{n}" for a, n, k in carved])


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared and media of ``docs`` (doc_id, text), written to the shared folder.

    The declared type is deliberately vague, as in crawled columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, most=8 << 20):
                media = [store(t + b"\0" * (UNIT - len(t) % UNIT if len(t) % UNIT or not t else 0)) for t in texts]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([UNKNOWN] * len(texts)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(typed.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary"), "media", texts=True, compression="zstd")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sniffed(stored_texts(table(spark, sf_dir, "documents")), declared="declared")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected"]
        for batch in batches:
            rows = []
            for media, kind, carved in zip(column(batch, "media"), column(batch, "media_type").to_pylist(), column(batch, "embedded").to_pylist()):
                data = media.as_py()
                payload = stored_payload(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), _feature(payload, kind, [(x["start"], x["length"], x["type"]) for x in carved])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *made, column(batch, "corrected")], names=names)

    return found.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean")
