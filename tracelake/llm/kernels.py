"""Vectorised text kernels on numpy, shared by the operators of this subpackage.

They work on the data buffer of an Arrow string column, so no Python string is
made per word.  Hashes are 64-bit polynomial hashes over a random byte table,
finished by a mixing step; equal inputs always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63 - 1, 256).astype(U64) * U64(2) + U64(1)
#: Bytes hashed at a time; bounds the temporary arrays whatever a text's length.
SLICE = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, SLICE + 64)
        inverse = U64(pow(int(_BASE), -1, 2**64))
        for i, b in enumerate((_BASE, inverse)):
            p = np.full(n, b, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of the values in [start, end), from their prefix sums."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (empty if there are fewer)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if len(values) > 2 * SLICE:
        return np.concatenate([rolling(values[i : i + SLICE + k - 1], k) for i in range(0, n, SLICE)])
    pre = prefix(values)
    _, inv = powers(n)
    return mix((pre[k:] - pre[:-k]) * inv[:n] + U64(k))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes of text (a longer text is a run of its own)."""
    _, at = text_buffer(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(out):  # slices that end between spans
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        s = start[i]
        pre = prefix(_TABLE[data[s : end[j - 1]]])
        out[i:j] = spans_hash(pre, start[i:j] - s, end[i:j] - s)
        i = j
    return out


class Words:
    """The words of some texts: where each starts and ends, its hash, and the first of each text."""

    __slots__ = ("data", "at", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray = WHITE, hashes: bool = True):
        self.data, self.at = data, at
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[edge] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[edge] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = hash_spans(data, self.start, self.end) if hashes else np.zeros(0, U64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())

    def window_starts(self, k: int) -> np.ndarray:
        """True for each word at which k words of its own text start."""
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self.start)) + k <= last


def covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """True at each of n places inside any of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + length, -1)
    return np.cumsum(delta[:n]) > 0


def binary(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: rows[cuts[i]:cuts[i+1]] as bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = (np.asarray(cuts, np.int64) * rows.itemsize).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return out.cast(pa.binary())


def ids(column: pa.Array) -> np.ndarray:
    """Integer ids; null counts as the smallest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
