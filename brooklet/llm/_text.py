"""Columnar text helpers: spans and hashes over the bytes of many texts at once.

All functions work on one byte array that holds the texts of a batch end to end, plus the offset of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, a-z (after LOWER) and all bytes of non-ASCII characters.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: ASCII white space and control characters.
BLANK = np.zeros(256, dtype=bool)
BLANK[:33] = BLANK[127] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int, base: int = BASE) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) <= n:
        p = np.full(max(n + 1, 1 << 16), base, dtype=U)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if n <= 1 << 22:
            _powers[base] = p
    return p


class Hasher:
    """Polynomial prefix hash modulo 2**64: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.n, self.pow = n, powers(n, base)
        self.prefix = np.zeros(n + 1, dtype=U)
        part = data.astype(U)
        part += U(1)
        part *= self.pow[:n]
        np.cumsum(part, out=self.prefix[1:])
        self.scale = U(pow(pow(base, -1, 1 << 64), n, 1 << 64))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.prefix[ends] - self.prefix[starts]
        h *= self.pow[self.n - starts]
        h *= self.scale
        h += (ends - starts).astype(U)
        return mix(h)


def batches(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, row after the last, bytes, offsets) of a string column; a null is an empty text.

    A piece holds about ``max_bytes``; a longer text makes a piece of its own.
    """
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run never crosses from one text into the next."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    first = off[:-1]
    before[first[first < n]] = False
    last = off[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owners(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each byte position belongs to."""
    return np.searchsorted(off, at, "right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts, ends and owning texts of their words."""
    low = LOWER[data]
    starts, ends = runs(WORD[low], off)
    return low, starts, ends, owners(off, starts)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive elements, order-sensitive."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out *= U(BASE2)
        out += h[j : j + n]
    return mix(out + U(k))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for each (s, n), end to end."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n) if len(values) else np.zeros(n)
