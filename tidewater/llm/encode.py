"""Token ids of many texts with the tokenizers library, each distinct piece encoded once.

A text is cut into pieces at places where the tokenizer's own pre-tokenizer
always cuts, so a text's ids are the ids of its pieces, one after another.  A
worker remembers pieces by hash, first bytes and length; only new ones reach
the library.  ``tests/llm`` holds the result against the library's own.

Cuts, with letters meaning A-Z, a-z and the letters of Latin-1:
between a letter and an ASCII mark or digit other than the apostrophe; before
a space or newline that follows another character; after a newline that a
letter follows; and, for a tokenizer that drops white space, around it.
Everything else stays in one piece and is cut by the library itself.
"""

from __future__ import annotations

import numpy as np

from . import wordhash as wh

WORD, BYTE = "word", "byte"

_WS, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[10, 32]] = _WS
_CLASS[33:127] = _MARK
_CLASS[ord("'")] = _OTHER
_CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("a") : ord("z") + 1] = _LETTER


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(buf: np.ndarray, size: int) -> np.ndarray:
    c = _CLASS[buf[:size]]
    lead = np.flatnonzero(buf[: size - 1] == 0xC3) if size else np.zeros(0, np.int64)
    if lead.size:
        low = buf[lead + 1]
        lead = lead[(low >= 0x80) & (low <= 0xBF) & (low != 0x97) & (low != 0xB7)]
        c[lead] = _LETTER
        c[lead + 1] = _LETTER
    return c


class PieceEncoder:
    """``mode``: WORD for a tokenizer that drops white space, BYTE for one that keeps every byte."""

    def __init__(self, path: str, mode: str, most: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.mode, self.most = mode, most
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if mode == WORD:
            from tokenizers.normalizers import Sequence

            self.bare.normalizer = Sequence([])
        size = self.full.get_vocab_size()
        self.token_len = np.zeros(size, np.int64)
        for token, i in self.full.get_vocab().items():
            self.token_len[i] = len(token.removesuffix("</w>") if mode == WORD else token)
        codes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(codes)]
        self.code_points = np.arange(256, dtype="<u4")
        self.code_points[rest] = 256 + np.arange(len(rest))
        self.space = chr(self.code_points[32])  # what a space is in the vocabulary
        self.code_points[10] = 32  # a newline parts pieces that hold none
        self.clear()

    def clear(self) -> None:
        self.table = wh.Table(16)
        self.check = np.zeros(1 << 12, np.uint64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lens = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)
        self.used = 0

    # -- pieces ---------------------------------------------------------------

    def pieces(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of all pieces, and each text's first piece with a final end."""
        size = int(at[-1])
        c = _classes(buf, size)
        cut = np.zeros(size + 1, bool)
        if size > 1:
            a, b = c[:-1], c[1:]
            both = a.astype(np.int8) - b.astype(np.int8)
            cut[1:size] = ((np.abs(both) == 1) & (a != _WS) & (b != _WS) & (a != _OTHER) & (b != _OTHER)) | ((b == _WS) & (a != _WS))
            if self.mode == WORD:
                cut[1:size] |= (a == _WS) & (b != _WS)
            else:
                cut[1:size] |= (buf[: size - 1] == 10) & (b == _LETTER)
            # A cut next to white space that only the library knows would split one run of it.
            odd = np.flatnonzero((buf[:size] <= 31) & (buf[:size] != 10) | (buf[:size] >= 0xC2) & (buf[:size] != 0xC3) & (buf[:size] < 0xF5))
            if odd.size and self.mode == BYTE:
                after = np.searchsorted(at, odd, "right") - 1
                for t in np.unique(after):
                    cut[at[t] : at[t + 1]] = False
        cut[at[:-1][at[:-1] < at[1:]]] = True
        cut[size] = False
        starts = np.flatnonzero(cut)
        lens = np.diff(np.append(starts, size))
        if self.mode == WORD and size:
            keep = c[starts] != _WS
            starts, lens = starts[keep], lens[keep]
        return starts, lens, np.searchsorted(starts, at)

    # -- encoding ------------------------------------------------------------------

    def rows(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The memo's row of each piece; new pieces are encoded first."""
        if self.table.size > self.most:
            self.clear()
        h = wh.hash_spans(buf, starts, lens)
        check = wh.first8(buf, starts, lens) * np.uint64(31) + lens.astype(np.uint64)
        rows = self._find(h, check)
        while (miss := np.flatnonzero(rows < 0)).size:  # again only for pieces that share a hash
            got, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            taken = self.table.find(got) >= 0
            self._learn(buf, starts[at], lens[at], check[at], np.where(taken, wh.mix(got ^ check[at]), got))
            rows[miss] = self._find(h[miss], check[miss])
        return rows

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The memo's row of each piece, -1 if it is not there; a piece whose hash another one has is kept under a second hash."""
        rows = self.table.find(h)
        other = np.flatnonzero((rows >= 0) & (self.check[rows] != check))
        if other.size:
            again = self.table.find(wh.mix(h[other] ^ check[other]))
            again[(again >= 0) & (self.check[again] != check[other])] = -1
            rows[other] = again
        return rows

    def _learn(self, buf, starts, lens, check, h) -> None:
        rows = self.table.add(h)
        for name in ("check", "starts", "lens"):
            setattr(self, name, _grown(getattr(self, name), self.table.size))
        self.check[rows] = check
        data = buf.tobytes()
        plain = _classes(buf, buf.size - wh.PAD)
        body = starts + ((buf[starts] == 32) & (lens > 1) if self.mode == BYTE else 0)
        ends = starts + lens
        odd = np.concatenate([[0], np.cumsum(plain != _LETTER)])
        easy = (odd[ends] - odd[body] == 0) & (ends > body) & (lens < 64)
        fast, slow = np.flatnonzero(easy), np.flatnonzero(~easy)
        if fast.size:
            self._keep(rows[fast], *self._fast([data[s:e] for s, e in zip(starts[fast].tolist(), ends[fast].tolist())], lens[fast]))
        if slow.size:
            texts = [data[s:e].decode() for s, e in zip(starts[slow].tolist(), ends[slow].tolist())]
            found = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(rows[slow], np.array([i for x in found for i in x], np.int32), np.fromiter(map(len, found), np.int64, len(found)))

    def _keep(self, rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = _grown(self.ids, self.used + ids.size)
        self.ids[self.used : self.used + ids.size] = ids
        self.lens[rows] = counts
        self.starts[rows] = self.used + np.cumsum(counts) - counts
        self.used += ids.size

    def _fast(self, parts: list[bytes], lens: np.ndarray, step: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each part has, of parts of letters only (after one space at most): the library's model without its patterns."""
        joined = [b"\n".join(parts[i : i + step]) for i in range(0, len(parts), step)]
        if self.mode == WORD:  # letters of Latin-1 keep their length
            joined = [x.decode().lower().encode() for x in joined]
        found, counts = [], []
        texts = [self.code_points[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in joined]
        for k, e in enumerate(self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.token_len[ids]), np.cumsum(lens[k * step : k * step + step])) + 1
            found.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(found), np.concatenate(counts)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's first place with a final end."""
        buf, at = wh.padded(texts)
        starts, lens, of = self.pieces(buf, at)
        rows = self.rows(buf, starts, lens)
        n = self.lens[rows].astype(np.int64)
        cum = np.concatenate([[0], np.cumsum(n)])
        return self.ids[wh.spread(self.starts[rows], n)], cum[of]


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    if size <= x.size:
        return x
    out = np.zeros(max(size, 2 * x.size), x.dtype)
    out[: x.size] = x
    return out


_KEPT: dict = {}


def encoder(name_or_path: str, mode: str) -> PieceEncoder:
    """One encoder for each Python worker, as loading a vocabulary takes a while."""
    import os

    key = name_or_path, mode
    if key not in _KEPT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = name_or_path if os.sep in name_or_path else tokenizer_path(name_or_path)
        _KEPT[key] = PieceEncoder(path, mode)
    return _KEPT[key]
