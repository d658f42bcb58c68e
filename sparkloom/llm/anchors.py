"""Anchors of a text: the places whose suffixes must be sorted to find every common string of SPAN bytes.

Each window of SPAN bytes picks, of the K-byte strings that start in it, the one
with the smallest hash (the leftmost of equals).  Equal windows pick the same
place in them, so two equal windows meet at equal suffixes of their anchors;
only one suffix in about fourteen has to be sorted.
"""

from __future__ import annotations

import numpy as np

from sparkloom.llm.shingles import _BYTE, mix, powers

SPAN, K = 50, 24
WIDTH = SPAN - K + 1
LEFT = WIDTH - 1
_U = np.uint64


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k bytes from each place on."""
    n = len(data)
    if n < k:
        return np.zeros(0, _U)
    up, down = powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


class Anchors:
    """Anchors of a run of texts: text, place, and the first and last offset (place - window start) of the windows that picked it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        counts = np.maximum(0, sizes - SPAN + 1)
        text = np.repeat(np.arange(len(sizes)), counts)
        start = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))
        if not len(start):
            self.text = self.place = self.low = self.high = np.zeros(0, np.int32)
            self.key = np.zeros(0, _U)
            return
        own = gram_hashes(data)
        # whole hashes are compared, and of equal ones the left is taken, so a window's choice depends on its bytes alone
        least, at, reach = own, np.arange(len(own), dtype=np.int32 if len(own) < 1 << 31 else np.int64), 1

        def wider(by: int) -> tuple[np.ndarray, np.ndarray]:
            """Least hash and its place for windows that reach further by so many places."""
            left, right = least[: len(least) - by], least[by:]
            return np.minimum(left, right), np.where(left <= right, at[: len(at) - by], at[by:])

        while 2 * reach <= WIDTH:
            least, at = wider(reach)
            reach *= 2
        if reach < WIDTH:
            least, at = wider(WIDTH - reach)
        picked = at[start].astype(np.int64)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1
        self.text, self.place = text[first].astype(np.int32), picked[first].astype(np.int32)
        self.low, self.high = ((picked[first] - start[x]).astype(np.int32) for x in (last, first))
        self.key = own[picked[first]]

    def contexts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chosen anchors, the SPAN bytes from the place on and the LEFT bytes before it, backwards; zero outside the windows."""
        place, low, high = self.place[some][:, None], self.low[some][:, None], self.high[some][:, None]
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.data, np.zeros(SPAN, np.uint8)])
        i, j = np.arange(SPAN)[None, :], np.arange(1, LEFT + 1)[None, :]
        right = padded[LEFT + place + i] * (i < SPAN - low)
        left = padded[LEFT + place - j] * (j <= high)
        return right, left


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian 64-bit words, so that comparing words compares bytes."""
    words = []
    for j in range(0, rows.shape[1], 8):
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, : rows.shape[1] - j] = rows[:, j : j + 8]
        words.append(wide.view(">u8").ravel().astype(_U))
    return words


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words: multikey sorting, each level going only into the runs that are still equal."""
    n = len(words[0])
    order = np.argsort(words[0], kind="stable")
    run = np.zeros(n, np.int64)
    current = words[0][order]
    for level in range(1, len(words) + 1):
        fresh = np.ones(n, bool)
        fresh[1:] = (current[1:] != current[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(fresh)
        if level == len(words):
            break
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        sub = np.lexsort((words[level][order[at]], run[at]))
        order[at] = order[at][sub]
        current = np.zeros(n, _U)
        current[at] = words[level][order[at]]
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):
        own = rows[order[a - 1 : a + (1 << 14)]]
        differ = own[1:] != own[:-1]
        out[a : a + len(differ)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def least_ids(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each row, a mask with bit o set if a row with a smaller id has the same window at offset o.

    right and left are contexts, low and high the offsets of each row's windows.
    A sparse suffix array (right) and an array of reversed prefixes (left) give
    the runs that share SPAN - o bytes after the anchors and o bytes before them.
    """
    n = len(ids)
    out = np.zeros(n, np.uint32)
    if n < 2:
        return out
    runs = []
    for rows in (right, left):
        order = multikey_order(as_words(rows))
        runs.append((order.astype(np.int32), common_prefix(rows, order).astype(np.uint8)))
    for o in range(LEFT + 1):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        pair = []
        for (order, same), least in zip(runs, (SPAN - o, o), strict=True):
            of = np.empty(n, np.int32)
            of[order] = np.cumsum(same < least, dtype=np.int32) if least else 0
            pair.append(of[some])
        key = pair[0].astype(np.int64) * (n + 1) + pair[1]
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        first = np.flatnonzero(fresh)
        least_id = np.minimum.reduceat(ids[some][order], first)
        smaller = ids[some][order] > least_id[np.cumsum(fresh) - 1]
        out[some[order[smaller]]] |= np.uint32(1 << o)
    return out
