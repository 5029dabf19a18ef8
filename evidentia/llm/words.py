"""Words of whole texts as numpy arrays: boundaries and 64-bit hashes without a Python loop over words.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which in UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+`` on code points. Hashes are polynomials modulo 2**64 over random byte values,
mixed at the end; equal words have equal hashes on every executor.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U64)
_R = U64(0x9E3779B97F4A7C15 | 1)
_R_INV = U64(pow(int(_R), -1, 2**64))
WINDOW_R = U64(0xD6E8FEB86659FD93)
#: For a second, independent hash of the same windows.
WINDOW_Q = U64(0xA0761D6478BD642F)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text worked on at once: numpy needs about 60 times as much memory for a moment.
SLICE_BYTES = 1 << 20

_powers: list[np.ndarray] = []
_name = ctypes.util.find_library("c")
_libc = ctypes.CDLL(_name) if _name else None
if _libc is not None and not hasattr(_libc, "malloc_trim"):
    _libc = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n at least, kept for the life of the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[U64(1), np.full(size - 1, r, U64)]) for r in (_R, _R_INV)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Words:
    """Words of a list of texts (bytes; None counts as empty). ``first[d]:first[d+1]`` are those of text d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, space: np.ndarray = SPACE):
        parts = [t or b"" for t in texts]
        lengths = np.fromiter((len(t) for t in parts), np.int64, len(parts))
        #: Where each text begins in ``buf``; the texts are held apart by one space.
        self.begin = np.r_[0, np.cumsum(lengths + 1)]
        self.buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        inside = ~space[self.buf]
        edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        self.n = np.diff(self.first)
        self._sums = None

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any spans of bytes, none of them empty."""
        if not len(start):
            return np.zeros(0, U64)
        up, down = _power_tables(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], dtype=U64)
        before = np.where(start > 0, self._sums[start - 1], U64(0))
        return mix((self._sums[end - 1] - before) * down[start] + (end - start).astype(U64))

    def windows(self, k: int, hashes: np.ndarray | None = None, base: np.uint64 = WINDOW_R) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all windows of k words inside one text: (index of the first word, hash)."""
        _power = lambda n: U64(pow(int(base), n, 2**64))
        h = self.hashes() if hashes is None else hashes
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        out, have, width, block = None, 0, 1, h
        while width <= k:  # a window of k words out of blocks of 1, 2, 4, ... words
            if k & width:
                out = block if out is None else block[: len(h) - have - width + 1] * _power(have) + out[width:][: len(h) - have - width + 1]
                have += width
            if 2 * width <= k:
                block = block[:-width] * _power(width) + block[width:]
            width *= 2
        last = np.repeat(self.first[1:], self.n) - np.arange(len(h))
        at = np.flatnonzero(last >= k)
        return at, mix(out[at])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def release() -> None:
    """Give memory that numpy and Arrow no longer use back to the system; Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(sizes: list[int], most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[slice]:
    """Runs of at most ``rows`` rows of about ``most`` bytes; a longer row is a run of its own."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most or i - begin == rows:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def text_slices(column: pa.Array) -> Iterator[tuple[slice, list[bytes | None]]]:
    """A column's texts in runs of about SLICE_BYTES, with the rows that they are of; only one run is copied at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for part in slices(sizes):
        yield part, as_bytes(column.slice(part.start, part.stop - part.start))
