"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on the UTF-8 buffers of an Arrow string column, so no Python string is made
for a document: a block of texts is one byte array plus offsets, and words, word hashes and window
hashes are found with whole-array numpy operations. Blocks are cut at document bounds so that the
scratch arrays stay small; one document is never split.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * _U(pow(base, filled, 1 << 64))
        filled += take
    return out


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, 1 << 10)
        self.down = _powers(_INVERSE, 1 << 10)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary column; a null has length 0 and valid False."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    body, offsets = body[offsets[0] : offsets[-1]], offsets - offsets[0]
    if not valid.all() and (np.diff(offsets)[~valid] > 0).any():
        column = pa.array(column.to_pylist(), column.type).fill_null("" if pa.types.is_string(column.type) else b"")
        return *buffers(column)[:2], valid
    return body, offsets, valid


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents of about ``size`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def class_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``space``: all but ASCII white space; ``alnum``: ASCII letters,
    digits and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[:] = True
        table[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
    else:
        for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
            table[lo:hi] = True
    return table


SPACE, ALNUM = class_table("space"), class_table("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of one block: ``start`` and ``end`` bytes, ``doc`` index, ``hash`` and ``first`` (of each
    document's words; one more than documents)."""

    powers = _Powers()

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE, hashed: bool = True) -> None:
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = table[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = ~inside
        stop[1:] &= inside[:-1]
        stop[0] = False
        edges = np.unique(offsets[1:-1])
        edges = edges[(edges > 0) & (edges < n)]
        cut = edges[inside[edges] & inside[edges - 1]]
        begin[cut] = True
        stop[cut] = True
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets, "left")
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.data = data
        if hashed:
            self.hash = self.hashes(data)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """64-bit hash of each word's bytes, the same wherever the word stands."""
        p = Words.powers
        p.reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * p.up[: len(data)], out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * p.down[self.start] + (self.end - self.start).astype(_U))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` hashes, by one prefix sum; empty if there are fewer."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U)
    p = Words.powers
    p.reach(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * p.up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * p.down[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if have < w else out


def per_document(values: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(len(first) - 1):
        yield i, values[first[i] : first[i + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def release() -> None:
    """Gives freed memory back to the system, which malloc and Arrow else keep for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` of a task's batches, with its memory given back at the end: the worker stays, idle or for another function."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run
