"""Vectorised words and word hashes over Arrow string batches.

A batch of texts is one buffer of UTF-8 bytes.  Words are found with a byte table
(every separator is ASCII, so bytes of 0x80 and over always belong to words), and each
word gets a 64-bit hash from prefix sums of a polynomial, so that no Python code runs
per word or per byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: white space of the contracts: space and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: separators between letters and digits, ASCII control characters and signs
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = False


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Words:
    """Words of a run of rows; ``row`` counts from the run's first row."""

    rows: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, with one more entry at the end
    sums: np.ndarray  # of the polynomial, up to each byte

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, which depend on their bytes only."""
        return mix((self.sums[end] - self.sums[start]) * _tables(len(self.buf) + 1)[1][start] + (end - start).astype(_U))

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def runs(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = True) -> Words:
    n_rows, n = len(offsets) - 1, len(buf)
    if lower:
        buf = LOWER[buf]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[buf]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    power, _ = _tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    first = np.searchsorted(start, offsets).astype(np.int64)
    out = Words(n_rows, buf, start, end, np.repeat(np.arange(n_rows), np.diff(first)), sums[:0], first, sums)
    out.hash = out.span(start, end)
    return out


_libc: list = []


def release() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and from stage to stage."""
    if not _libc:
        try:
            _libc.append(ctypes.CDLL(None).malloc_trim)
        except (OSError, AttributeError):  # not glibc
            _libc.append(lambda _: 0)
    if len(_powers[0]) > 1 << 20:  # a long text has made them as long
        _powers[:] = np.ones(1, _U), np.ones(1, _U)
    pa.default_memory_pool().release_unused()
    _libc[0](0)


def word_runs(column: pa.Array, separator: np.ndarray = SPACE, lower: bool = True, most: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    buf, offsets = raw(column)
    for lo, hi in runs(offsets, most):
        yield lo, hi, words_of(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separator, lower)
    release()


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``size`` words that stand in a row, and the index of the first of them."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    h = np.full(len(at), size, _U)
    for k in range(size):
        h = (h ^ w.hash[at + k]) * _U(0x9FB21C651E98DF25)
        h ^= h >> _U(29)
    return mix(h), at


def hash_of(words: list[str]) -> np.ndarray:
    """The hash of each word, as ``words_of`` gives it (the words hold no separators)."""
    data = [x.encode() for x in words]
    buf = np.frombuffer(b" ".join(data), np.uint8)
    return words_of(buf, np.array([0, len(buf)]), SPACE, lower=False).hash


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
