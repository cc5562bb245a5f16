"""Vectorised splitting and hashing of UTF-8 text with numpy.

Words here are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as no such
byte occurs inside a multi-byte UTF-8 sequence, they equal the code-point
definition.  A hash is 64 bits wide and reads every byte of its span.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PAD = 16

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def padded(parts: list[bytes], sep: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all parts (each followed by ``sep``) and the parts' starts, with a final end."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + len(sep)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    buf = np.frombuffer(sep.join(parts) + sep + b"\0" * PAD, np.uint8)
    return buf, at


def first8(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each span as a little-endian number."""
    view = np.ndarray((buf.size - 7,), "<u8", buf, 0, (1,))
    return view[starts] & _LOW[np.minimum(lens, 8)]


def hash_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; ``buf`` needs PAD bytes after the last span."""
    view = np.ndarray((buf.size - 7,), "<u8", buf, 0, (1,))
    h = mix((view[starts] & _LOW[np.minimum(lens, 8)]) + (lens.astype(np.uint64) + np.uint64(seed)) * _M1)
    left = np.flatnonzero(lens > 8)
    k = 8
    while left.size:
        more = lens[left] - k
        chunk = view[starts[left] + k] & _LOW[np.minimum(more, 8)]
        h[left] = mix(h[left] * _M2 + chunk + _M1)
        left = left[more > 8]
        k += 8
    return h


def words(buf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in the first ``size`` bytes."""
    ink = np.zeros(size + 2, np.int8)
    np.logical_not(SPACE[buf[:size]], out=ink[1:-1].view(bool))
    step = np.diff(ink)
    starts = np.flatnonzero(step == 1)
    return starts, np.flatnonzero(step == -1) - starts


class Table:
    """An open-addressing map from 64-bit hashes to consecutive row numbers, looked up in bulk."""

    def __init__(self, bits: int = 12):
        self.size = 0
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits = bits
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if it is not there."""
        out = np.full(h.size, -1, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = self.rows[slot]
        hit = (self.keys[slot] == h) & (rows >= 0)
        out[hit] = rows[hit]
        left = np.flatnonzero(~hit & (rows >= 0))
        slot = slot[left]
        while left.size:
            slot = (slot + 1) & self.mask
            rows = self.rows[slot]
            hit = (self.keys[slot] == h[left]) & (rows >= 0)
            out[left[hit]] = rows[hit]
            on = ~hit & (rows >= 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Adds hashes that are distinct and not there yet; their rows."""
        new = np.arange(self.size, self.size + h.size, dtype=np.int32)
        if (self.size + h.size) * 2 > self.mask:
            live = self.rows >= 0
            old_keys, old_rows = self.keys[live], self.rows[live]
            self._reset(max(self.bits, int(self.size + h.size).bit_length() + 1))
            self._put(old_keys, old_rows)
        self._put(h, new)
        self.size += h.size
        return new

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(h.size)
        while left.size:
            free = self.rows[slot[left]] < 0
            at = left[free]
            self.rows[slot[at]] = rows[at]
            self.keys[slot[at]] = h[at]
            done = self.rows[slot[left]] == rows[left]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i]+lens[i]-1 of all i, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep], lens[keep]
    step = np.ones(total, np.int64)
    ends = np.cumsum(lens)
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - starts[:-1] - lens[:-1] + 1
    return np.cumsum(step)
