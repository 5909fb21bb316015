"""Words of Arrow string columns as 64-bit hashes, in numpy, without a Python object per word.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z read as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = 0xD1342543DE82EF95
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(bounds: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows, and where each row's words begin (rows + 1 offsets)."""
    lo = int(bounds[0])
    buf, own = data[lo : int(bounds[-1])], bounds - lo
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(own), np.int64)
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = own[:-1][own[:-1] < len(buf)]
    first[inner] = word[inner]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(own), np.int64)
    which = np.cumsum(first) - 1
    place = np.arange(len(buf)) - begins[which]
    place[~word] = 0
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = _P
    np.multiply.accumulate(powers, out=powers)
    values = _BYTE[buf] * powers[place]
    values[~word] = 0
    return mix(np.add.reduceat(values, begins)), np.searchsorted(begins, own)


def _power(j: int) -> np.uint64:
    return np.uint64(pow(_Q, j, 1 << 64))


def windows(h: np.ndarray, at: np.ndarray, width: int, picks: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words inside each row (of the words at `picks` only), and their row offsets."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(n)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    start = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], n)
    total = np.zeros(len(start), np.uint64)
    for j in range(width):
        if picks is None or j in picks:
            total += h[start + j] * _power(j)
    return mix(total + np.uint64(width)), out_at


def shingle_sets(h: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, and their row offsets. Under `width` words: the whole sequence as one."""
    sh, sh_at = windows(h, at, width)
    n = np.diff(at)
    short = {}
    for k in range(1, width):
        rows = np.flatnonzero(n == k)
        if len(rows):
            total = np.zeros(len(rows), np.uint64)
            for j in range(k):
                total += h[at[rows] + j] * _power(j)
            short.update(zip(rows.tolist(), mix(total + np.uint64(1000 + k)), strict=True))
    sets = []
    for i in range(len(n)):
        sets.append(np.unique(sh[sh_at[i] : sh_at[i + 1]]) if i not in short else np.array([short[i]], np.uint64))
    out_at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), out_at
