"""Words of many texts at once: borders, hashes and shingles in numpy, from the bytes of an Arrow column.

A text's words are runs of bytes that a 256-entry table maps to something other than 0; the table also folds case.
UTF-8 bytes above 0x7F belong to words in every table here, so runs of bytes are the runs of code points asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = [0x20, *range(0x09, 0x0E)]


def _table(lower: bool, alnum_only: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[ord("A"):ord("Z") + 1] += 32
    if alnum_only:
        keep = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
        t[[b for b in range(256) if b not in keep]] = 0
        if not lower:
            raise ValueError("letters and digits go with lower case")
    else:
        t[0] = 0x0B  # a NUL is part of a word; 0 is taken by the separators
        t[_WHITE] = 0
    return t


#: Words between white space; the same in lower case (A-Z only); letters, digits and non-ASCII in lower case.
PLAIN, FOLDED, ALNUM = _table(False, False), _table(True, False), _table(True, True)

#: For bytes.translate: lower case, and everything that is no letter or digit to a space.
TO_ALNUM = bytes(0x20 if v == 0 else int(v) for v in ALNUM)

_RANDOM = np.random.default_rng(20240117)
_OF_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets of the rows' borders, bytes) of runs of whole rows with about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, off[row:end + 1] - off[row], data[off[row]:off[end]]
        row = end


class Words:
    """The words of one run of rows. ``first[i]:first[i + 1]`` are the words of row i."""

    def __init__(self, off: np.ndarray, data: np.ndarray, table: np.ndarray):
        self.code = table[data]
        inside = self.code != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Hasher:
    """64-bit word hashes from prefix sums, so that the cost is a few passes over the bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, w: Words) -> np.ndarray:
        n = len(w.code)
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                power = np.full(size, base, np.uint64)
                power[0] = 1
                setattr(self, name, np.multiply.accumulate(power))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_OF_BYTE[w.code] * self.up[:n], out=total[1:])
        return mix((total[w.end] - total[w.start]) * self.down[w.start])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive words from each word on, and which of them stay within one row."""
    n = max(0, len(h) - k + 1)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _STEP
        g += h[j:j + n]
    ok = np.ones(n, bool)
    if n and k > 1:
        cut = (first[1:-1, None] - np.arange(1, k)).ravel()
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return mix(g), ok
