"""Shared text kernels: Arrow buffers in, numpy arrays out.

Words are runs of bytes outside the ASCII white-space class
``[\\x20\\x09-\\x0D]``; A-Z are folded to a-z, nothing else is.  Every
function works on whole texts in chunks of about a megabyte, so memory does
not depend on the batch.  A null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_POS = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (rows + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges (lo, hi) of about ``size`` bytes each; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (rows + 1)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = ~inside[:-1]
    last = np.ones(len(data), dtype=bool)
    last[:-1] = ~inside[1:]
    first = offsets[:-1]
    fresh[first[first < len(data)]] = True
    edge = offsets[1:]
    last[edge[edge > 0] - 1] = True
    starts = np.flatnonzero(inside & fresh)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, A-Z folded."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    picked = data[within + np.repeat(starts, size)]
    h = np.add.reduceat(_BYTE[picked] * _POS[within & 0xFFFF], first)
    return mix64(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each row's first word (rows + 1)."""
    starts, ends, at = word_spans(data, offsets)
    return hash_spans(data, starts, ends), at


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each row.

    A row of fewer words has its whole sequence as one shingle; a row without
    words has the empty set.
    """
    n = len(words)
    out = []
    grams = np.zeros(0, np.uint64)
    if n >= size:
        grams = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            grams += words[j : n - size + 1 + j] * _GRAM[j]
        grams = mix64(grams)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            k = hi - lo
            out.append(mix64(np.array([(words[lo:hi] * _GRAM[:k]).sum(dtype=np.uint64) + np.uint64(k)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(column, size: int):
    """Yield (row, shingle set) for every row of a string column, in order."""
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        base = offsets[lo]
        words, at = word_hashes(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        for i, s in enumerate(shingle_sets(words, at, size)):
            yield lo + i, s
