"""Vectorised text work inside tasks: flat byte views of Arrow columns, words, and rolling hashes.

Everything here is a small numpy helper that runs on one chunk of one Arrow batch. Chunks hold whole
documents and about ``CHUNK_BYTES`` of text (a longer document makes a chunk of its own), so the memory of
a task is bounded by its largest document, not by its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_SEED = np.random.default_rng(20_240_229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on the whole value."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows and the end) for whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def release() -> None:
    """Give unused Arrow memory back at the end of a task; workers are kept for later tasks, of other operators too."""
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (and one past the last)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = word[begin]
    last[end] = word[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; spans() turns them into hashes of byte spans."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that start at each word (also across rows; callers cut those off)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _U(_BASE) + words[i : i + n]
    return mixed(out)
