"""Vectorised word and shingle hashing over Arrow string columns.

A batch is cut into slices of a bounded number of bytes (a longer text is a slice of its own); within a slice all words
of all texts are found and hashed with a handful of numpy passes over the UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are maximal runs of ASCII letters and digits and of any non-ASCII byte.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of a slice of texts: byte ranges, 64-bit hashes, and the first word of each text in ``of``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_SPACE) -> None:
        n = len(data)
        data = _lower[data]
        self.data, self.offsets = data, offsets
        inside = table[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, offsets)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mix(h ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(56)))

    def __len__(self) -> int:
        return len(self.starts)


def _odd(i: int) -> np.uint64:
    return np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1) ^ (i << 33)) & ((1 << 64) - 1) | 1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that start at each word (the last k - 1 are missing)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _odd(i)
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a shingle; its length is part of it, so it never equals a shingle's."""
    total = sum(int(h) * int(_odd(i)) for i, h in enumerate(hashes)) + 0x5851F42D4C957F2D * len(hashes)
    return mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0]


def sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; the whole sequence for fewer than k words, none for no word."""
    every = shingles(words.hashes, k)
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield np.array([whole(words.hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
