"""Vectorised work on Arrow string columns inside tasks: whole texts as one byte array.

A batch of texts is a byte array and an offset array, as Arrow stores it, so words, lines, shingles
and their hashes are numpy operations over all texts of a slice at once. Null texts read as empty.
Slices hold whole texts and about ``SLICE`` bytes (one longer text is a slice of its own), which
bounds the memory of a task whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TAIL = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most ``limit`` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a string column."""
    raw, off = text_bytes(column)
    for i, j in slices(off, limit):
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags; a run never crosses an offset."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = flag.copy()
    start[1:] &= ~flag[:-1] | edge[1:n]
    end = flag.copy()
    end[:-1] &= ~flag[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags in each text."""
    kind = np.int32 if len(flag) < 1 << 31 else np.int64
    return np.diff(np.concatenate([np.zeros(1, kind), np.cumsum(flag, dtype=kind)])[offsets]).astype(np.int64)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the first word of each text."""
    starts, ends = runs(~SPACE[raw], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step; spans that are done drop out."""
    size = ends - starts
    h = size.astype(np.uint64) * _M1 + np.uint64(seed)
    if not len(size):
        return h
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(16, np.uint8)]), 8)
    left, at, idx = size, starts, None
    while True:
        v = window[at].view("<u8").ravel() & _TAIL[np.minimum(left, 8)]
        if idx is None:
            h = (h ^ v) * _M2
            h ^= h >> np.uint64(32)
        else:
            x = (h[idx] ^ v) * _M2
            h[idx] = x ^ (x >> np.uint64(32))
        more = left > 8
        if not more.any():
            return mix(h)
        idx = np.flatnonzero(more) if idx is None else idx[more]
        left, at = left[more] - 8, at[more] + 8


def shingle_hashes(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window that lies inside one text, and the text it is in."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word[:m].copy()
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * _M1 + word[k:k + m]
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    inside = text[:m] == text[n - 1:]
    return mix(h[inside]), text[:m][inside]


