"""Byte-level BPE of whole texts with the tokenizers library.

The pre-tokeniser of this vocabulary starts a new token at certain places whatever surrounds them: before a space that
stands before a visible character, before white space that follows a visible character, between a letter or digit and a
punctuation mark other than the apostrophe, and after a single line feed between visible characters. Texts are cut there
only (and around added tokens, such as an end-of-text mark, whose string in a text is one id), so encoding the pieces is encoding the text. Each worker encodes a piece once and looks it up afterwards.
"""

from __future__ import annotations

import os
import re

import numpy as np

from brooklet.llm._text import BASE2, Hasher, gather

#: Pieces remembered by one worker before it starts afresh.
REMEMBERED = 1 << 20
#: Pieces looked up at once.
SLICE = 1 << 19

_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_PUNCT = _VISIBLE & ~_ALNUM
_PUNCT[39] = False


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; every non-empty text starts a piece."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        before, here = data[:-1], data[1:]
        latin = np.zeros(n, dtype=bool)  # last byte of a letter from U+00C0 to U+00FF
        latin[1:] = (before == 0xC3) & (here != 0x97) & (here != 0xB7) & (here >= 0x80)
        letter = _ALNUM[data] | latin
        solid = _VISIBLE[data] | latin
        opens = _VISIBLE[data] | (data == 0xC3)  # first byte of a visible character
        space = _SPACE[data]
        cut[1:n] |= solid[:-1] & space[1:]
        cut[1:n] |= letter[:-1] & _PUNCT[here]
        cut[0 : n - 1] |= (data[:-1] == 32) & opens[1:]
        if n > 2:
            cut[2:n] |= solid[:-2] & (data[1:-1] == 10) & opens[2:]
    first = off[:-1]
    cut[first[first < n]] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n) if len(starts) else starts


class Table:
    """Open-addressing table from 64-bit hashes to small integers, read and filled in whole arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, or -1."""
        at = (h & self.mask).astype(np.int64)
        seen = self.keys[at]
        hit = seen == h
        out = np.where(hit, self.values[at], -1)
        left = np.flatnonzero(~hit & (seen != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            seen = self.keys[at[left]]
            hit = seen == h[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct hashes that are not there yet."""
        at = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]  # of two that want one slot the last stays
            won = free[self.keys[at[free]] == h[free]]
            self.values[at[won]] = values[won]
            lost = np.ones(len(h), dtype=bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & int(self.mask)


class Encoder:
    """Token ids of whole texts; keeps what it has encoded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.forget()

    def forget(self) -> None:
        self.table, self.known = Table(REMEMBERED.bit_length()), 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.length, self.check = (np.zeros(1 << 14, dtype=t) for t in (np.int32, np.int32, np.uint64))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n, m = self.known, len(ids)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=m)
        new = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(lengths.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.length, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.check))
        self.flat[self.used : self.used + len(new)] = new
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.check[n : n + m] = check
        self.table.put(h, np.arange(n, n + m, dtype=np.int32))
        self.known, self.used = n + m, self.used + len(new)

    def _look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces end to end and the number of each; None where two different pieces have one hash."""
        where = self.table.find(h)
        if len(missing := np.flatnonzero(where < 0)):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            if self.known + len(new) > REMEMBERED:
                self.forget()
                new, at = np.unique(h, return_index=True)
            self._learn(data, starts[at], ends[at], new, check[at])
            where = self.table.find(h)
        if (self.check[where] != check).any():
            return None
        lengths = self.length[where]
        return gather(self.flat, self.start[where], lengths), lengths

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text.

        An added token in a text is one id, and what is before and after it is encoded as if it were a text of its own.
        """
        found = [m.span() for m in self.added.finditer(data.tobytes())] if self.added else []
        if found := [x for x in found if np.searchsorted(off, x[0], "right") == np.searchsorted(off, x[1], "left")]:
            edges = np.union1d(off, np.array(found).ravel())
            flat, lengths = self._encode(data, edges, np.array(found))
            total = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(edges, off)]
            return flat, np.diff(total)
        return self._encode(data, off)

    def _encode(self, data: np.ndarray, off: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``whole``: the spans that no piece begins in."""
        n = len(off) - 1
        starts, ends = cuts(data, off)
        if whole is not None:
            inside = np.searchsorted(whole[:, 0], starts, "left") > np.searchsorted(whole[:, 1], starts, "right")
            starts = starts[~inside]
            ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        h, check = Hasher(data).spans(starts, ends), Hasher(data, BASE2).spans(starts, ends)
        h[h == 0] = 1
        parts = [self._look(data, starts[i : i + SLICE], ends[i : i + SLICE], h[i : i + SLICE], check[i : i + SLICE]) for i in range(0, len(starts), SLICE)]
        if any(p is None for p in parts):  # two pieces share a hash: encode this batch without memory
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64)
        flat, lengths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        edges = np.searchsorted(starts, off)
        return flat, total[edges[1:]] - total[edges[:-1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
