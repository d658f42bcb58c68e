"""Word shingles of whole texts, vectorised over Arrow buffers.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a
shingle is ``k`` consecutive words.  A word is hashed by a polynomial over
random byte values modulo 2**64, a shingle by mixing its words' hashes, so one
pass of numpy over a slice of many texts replaces a Python loop over words.
Texts with 1..k-1 words form one shingle of all their words; empty texts none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed) * _U(0xD1342543DE82EF95))


_BYTE = stream(256, 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls."""
    if len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for slot, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, _U(base & 0xFFFFFFFFFFFFFFFF), _U)
            steps[0] = 1
            _POWERS[slot] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of whole texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_in(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of all words in order, and each text's first index among them (plus the end).

    space says of each byte whether it separates words.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    gap = np.ones(n + 1, bool)
    gap[:n] = space[data]
    begin = ~gap
    begin[1:] &= gap[:-1] | text_start[1:]
    end = ~gap[:-1]
    end &= gap[1:] | text_start[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_LOWER[data] * up, out=total[1:])
    return mix((total[last] - total[first]) * down[first]), first, last, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first index among them (plus the end)."""
    hashes, _, _, at = words_in(data, offsets)
    return hashes, at


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each text) for runs of texts."""
    steps, length = stream(k, 7) | _U(1), stream(k + 1, 10)
    for i, _, data, offsets in text_slices(column):
        words, at = word_hashes(data, offsets)
        n = len(words)
        full = np.zeros(max(0, n - k + 1), _U)
        for j in range(k if len(full) else 0):
            full += words[j : j + len(full)] * steps[j]
        full = mix(full + length[k])
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.sort(full[a : b - k + 1])
                if len(own) > 1:
                    keep = np.empty(len(own), bool)
                    keep[0] = True
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    own = own[keep]
            elif b > a:
                m = b - a
                own = mix((words[a:b] * steps[:m]).sum(dtype=_U, keepdims=True) + length[m])
            else:
                own = np.zeros(0, _U)
            sets.append(own)
        yield i, sets


def signature(own: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    a, b = mix(own ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U), mix(own + _U(0x5851F42D4C957F2D)).sum(dtype=_U)
    return np.array([a, b], _U).tobytes()
