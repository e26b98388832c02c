"""Vectorised text primitives over Arrow string columns.

Everything here works on the concatenated UTF-8 bytes of a slice of documents,
so the cost per character is a handful of numpy passes instead of Python calls.
Hashes are 64-bit polynomial sums over random byte values, mixed at the end;
they are equal for equal byte strings at any position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters, digits, underscore and every byte of a multi-byte character.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_WORD[95] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown on demand, kept per process)."""
    if len(_powers[0]) < n:
        size = n + 65536
        for k, b in enumerate((_BASE, _BASE_INV)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


class Text:
    """Bytes of some documents one after another; doc i is buf[ptr[i]:ptr[i+1]]."""

    def __init__(self, buf: np.ndarray, ptr: np.ndarray):
        self.buf, self.ptr = buf, ptr
        self._sum: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return len(self.ptr) - 1

    def lowered(self) -> Text:
        return Text(_LOWER[self.buf], self.ptr)

    def prefix(self) -> np.ndarray:
        if self._sum is None:
            p, _ = powers(len(self.buf) + 1)
            out = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_BYTE[self.buf] * p[: len(self.buf)], out=out[1:])
            self._sum = out
        return self._sum

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s = self.prefix()
        _, inv = powers(len(self.buf) + 1)
        return mix((s[stop] - s[start]) * inv[start] + (stop - start).astype(np.uint64))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and doc pointers of maximal runs where inside[byte], never across documents."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n_docs + 1, np.int64)
        m = inside[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.ptr] = True
        first = m.copy()
        first[1:] &= ~m[:-1] | cut[1:-1]
        last = m.copy()
        last[:-1] &= ~m[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.ptr)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Counts of true bytes by document."""
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return np.diff(c[self.ptr])


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """(first row, end row, Text) of row ranges of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, Text(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def doc_of(ptr: np.ndarray) -> np.ndarray:
    """Document number of each item, given pointers."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def shingles(word_hash: np.ndarray, wptr: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their doc pointers.

    A document of 1 to width-1 words has one shingle, of all its words.
    """
    n = len(word_hash)
    counts = np.diff(wptr)
    acc = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        part = word_hash[k:] * U((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        acc[: n - k] += part ^ (part >> U(31))
    keep = np.zeros(n, bool)
    place = np.arange(n) - np.repeat(wptr[:-1], counts)
    keep[place <= np.repeat(counts, counts) - width] = True
    short = np.flatnonzero((counts > 0) & (counts < width))
    for d in short:
        lo, hi = wptr[d], wptr[d + 1]
        keep[lo] = True
        acc[lo] = sum(int(h) * (2 * k + 1) for k, h in enumerate(word_hash[lo:hi])) + int(hi - lo) & (1 << 64) - 1
    c = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=c[1:])
    return mix(acc[keep]), c[wptr]


def unique_by_doc(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and new pointers."""
    doc = doc_of(ptr)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    c = np.zeros(len(v) + 1, np.int64)
    np.cumsum(keep, out=c[1:])
    return v[keep], c[ptr]


def segment_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[ptr[1:]] - c[ptr[:-1]]
