"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a step is a word: a vector for its class of evidence (how much more
often toxic texts hold the word, as the signed root of the log likelihood ratio,
cut at CLASSES), a vector for the word itself (one of BUCKETS, by hash), and the
last states of two gated recurrent chains over its characters, one in each
direction.  Words of more than CHARS bytes are several steps.  Two gated
recurrent chains read a window of WINDOW words, an attention layer pools their
states, and a logistic unit gives the window's score.  A text is scored by all
its windows, STRIDE words apart and so overlapping; the largest score is
calibrated to a probability.

Training: at most MAX_TOXIC and MAX_CLEAN labelled rows (those with the smallest
hash of their id, so a fixed sample) of at most MAX_BYTES together, outside the
held-out third, come to one task; equal texts count once.  While a text is
learned from, its words' classes come from the other FOLDS - 1 parts of the
texts, so chance words of few texts carry no more weight than they deserve; for
the same reason vectors of single words are left out half of the time, and the
calibration uses a part that the network hasn't seen.  Only windows are learned
from, those with the largest evidence of each text and, for clean texts, some
others, since a label says nothing of where a text is toxic.  The model has a
bounded size and is sent to the executors, which score whole texts in slices.

Defined cases: null and empty texts, and texts without words, have the score of
no evidence, below any window's; null ids and repeated rows are scored like
others; rows with a null label or without text aren't learned from; of rows that
repeat a labelled id the text with the smallest hash is; with no toxic or no
clean row every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, tidy
from sparkloom.llm.shingles import _LOWER, mix, text_slices, words_in

HIDDEN, CLASS_DIM, WORD_DIM, CHAR_DIM, CHAR_HIDDEN, ATTENTION = 8, 6, 4, 6, 4, 8
WINDOW, STRIDE, CHARS = 24, 8, 16
VOCABULARY, BUCKETS, WORDS = 1 << 16, 1 << 12, 1 << 17
CLASSES = (-8.0, -4.0, -2.5, -1.5, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 11.0, 16.0)
NEUTRAL = 4
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 3000, 32 << 20
EPOCHS, BATCH, RATE, FOLDS, DECAY = 8, 256, 0.01, 5, 1e-4
#: The part of the labelled texts that only calibrates, if it has so many toxic ones.
TEST_FOLD, TEST_TOXIC = 0, 30
REJECT = 0.7
NO_EVIDENCE = -8.0
_H2, _C2 = 2 * HIDDEN, 2 * CHAR_HIDDEN
_D = CLASS_DIM + WORD_DIM + _C2

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
for _span in (b"az", b"AZ", b"09"):
    _SEPARATOR[_span[0] : _span[1] + 1] = False


def _chains(hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Gates z, r, n, each with ``hidden`` columns of the forward and of the backward chain: which weights there are, as the chains don't mix, and which columns are forward."""
    own = np.zeros((2 * hidden, 6 * hidden), np.float32)
    for g in range(3):
        own[:hidden, 2 * g * hidden : (2 * g + 1) * hidden] = 1
        own[hidden:, (2 * g + 1) * hidden : (2 * g + 2) * hidden] = 1
    return own, np.tile(np.repeat([True, False], hidden), 3)


_CHAINS, _FORWARD = _chains(HIDDEN)
_CHAR_CHAINS, _CHAR_FORWARD = _chains(CHAR_HIDDEN)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # 1 / (1 + infinity) is the 0 that is meant
        return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 2 / (1 + np.exp(-2 * x)) - 1


class Texts:
    """Words of a run of texts: hashes, bytes, and the windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        self.hashes, self.first, self.last, self.at = words_in(data, offsets, _SEPARATOR)
        pieces = -(-(self.last - self.first) // CHARS)
        if len(pieces) and pieces.max() > 1:
            upto = np.concatenate([[0], np.cumsum(pieces)])
            turn = np.arange(upto[-1]) - np.repeat(upto[:-1], pieces)
            word = np.repeat(np.arange(len(pieces)), pieces)
            self.hashes = np.where(turn > 0, mix(self.hashes[word] + turn.astype(np.uint64)), self.hashes[word])
            self.first, end = self.first[word] + turn * CHARS, self.last[word]
            self.last = np.minimum(self.first + CHARS, end)
            self.at = upto[self.at]

    def characters(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters (word, CHARS), zero after the end, and lengths of words."""
        first, size = self.first[words], (self.last - self.first)[words]
        at = np.minimum(first[:, None] + np.arange(CHARS), max(0, len(self.data) - 1))
        return np.where(np.arange(CHARS) < size[:, None], self.data[at], 0).astype(np.uint8), size

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and length of each window; every word is in one, most in three, and so is every span of WINDOW - STRIDE + 1 words."""
        n = np.diff(self.at)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        return text, self.at[text] + start, np.minimum(WINDOW, n[text] - start)


def evidence(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Signed root of the log likelihood ratio of words held by bad of n_bad toxic and good of n_good clean texts."""
    share = n_bad / (n_bad + n_good)
    n = np.maximum(bad + good, 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(bad > 0, bad * np.log(bad / (n * share)), 0) + np.where(good > 0, good * np.log(good / (n * (1 - share))), 0))
    return np.sign(bad / n - share) * np.sqrt(np.maximum(g, 0)) * (bad + good > 0)


def _classes(vocabulary: np.ndarray, classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The class of each word; other words are neutral."""
    if not len(vocabulary):
        return np.full(len(hashes), NEUTRAL)
    i = np.searchsorted(vocabulary, hashes)
    i[i == len(vocabulary)] = 0
    return np.where(vocabulary[i] == hashes, classes[i], NEUTRAL)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _steps(gates: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: bool):
    """Runs both chains over gates (step, row, 3 * width), the backward one with its steps reversed already."""
    w = u.shape[0]
    h = np.zeros((gates.shape[1], w), np.float32)
    states, kept = np.empty((len(gates), *h.shape), np.float32), []
    for t in range(len(gates)):
        hu = h @ u
        zr = _sigmoid(gates[t, :, : 2 * w] + hu[:, : 2 * w])
        z, r = zr[:, :w], zr[:, w:]
        c = _tanh(gates[t, :, 2 * w :] + r * hu[:, 2 * w :])
        new = c + z * (h - c)
        if keep:
            kept.append((h, hu, z, r, c))
        h = new if mask is None else h + mask[t] * (new - h)
        states[t] = h
    return states, kept


def _steps_back(d_states: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of gates and u from those of the states."""
    steps, rows, w = d_states.shape
    d_gates, d_u, carry = np.empty((steps, rows, 3 * w), d_states.dtype), np.zeros_like(u), np.zeros((rows, w), d_states.dtype)
    for t in reversed(range(steps)):
        h, hu, z, r, c = kept[t]
        total = d_states[t] + carry
        d_new = total * mask[t]
        carry = total - d_new + d_new * z
        d_c = d_new * (1 - z) * (1 - c**2)
        d_hu = np.concatenate([d_new * (h - c) * z * (1 - z), d_c * hu[:, 2 * w :] * r * (1 - r), d_c * r], axis=1)
        d_gates[t, :, : 2 * w], d_gates[t, :, 2 * w :] = d_hu[:, : 2 * w], d_c
        d_u += h.T @ d_hu
        carry = carry + d_hu @ u.T
    return d_gates, d_u


def _spelled(chars: np.ndarray, size: np.ndarray, m: dict, keep: bool = False):
    """The last states of both chains over the characters of words (word, CHARS); with keep, also what their gradients need."""
    place = np.arange(CHARS)[:, None]
    back = np.take_along_axis(chars, np.maximum(size[None, :] - 1 - place, 0).T, 1).T
    table = m["C"] @ m["Wc"] + m["bc"]
    gates = np.where(_CHAR_FORWARD, table[chars.T], table[back])
    mask = (place < size[None, :]).astype(np.float32)[:, :, None]
    states, kept = _steps(gates, mask, m["Uc"], keep)
    return states[-1], (chars.T, back, mask, kept)


def _spelled_at_once(chars: np.ndarray, size: np.ndarray, m: dict) -> np.ndarray:
    """What _spelled gives for words of descending size: a step of the chains has the words that are long enough, which stand in front."""
    table = (m["C"] @ m["Wc"] + m["bc"]).astype(np.float32).reshape(256, 3, 2, CHAR_HIDDEN)
    ahead, back = (np.ascontiguousarray(table[:, :, k]) for k in (0, 1))
    u, w, rows = m["Uc"], _C2, np.arange(len(size))
    h = np.zeros((len(size), w), np.float32)
    for t in range(CHARS):
        k = int(np.searchsorted(-size, -t, "left"))
        if not k:
            break
        gates = np.empty((k, 3, 2, CHAR_HIDDEN), np.float32)
        gates[:, :, 0], gates[:, :, 1] = ahead[chars[:k, t]], back[chars[rows[:k], size[:k] - 1 - t]]
        gates, old = gates.reshape(k, 3 * w), h[:k]
        hu = old @ u
        zr = _sigmoid(gates[:, : 2 * w] + hu[:, : 2 * w])
        c = _tanh(gates[:, 2 * w :] + zr[:, w:] * hu[:, 2 * w :])
        h[:k] = c + zr[:, :w] * (old - c)
    return h


class Spelling:
    """What the characters of words add to their gates; a word is spelled once, as long as there are no more than WORDS of them."""

    def __init__(self, m: dict):
        self.m, self.n = m, 0
        self.gates = np.empty((1 << 12, 3 * _H2), np.float32)
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, texts: Texts) -> np.ndarray:
        m = self.m
        own, one, which = np.unique(texts.hashes, return_index=True, return_inverse=True)
        if self.n + len(own) > WORDS:
            self.__init__(m)
        place = np.minimum(np.searchsorted(self.hashes, own), max(0, self.n - 1))
        new = self.hashes[place] != own if self.n else np.ones(len(own), bool)
        if new.any():
            words = one[new][np.argsort(-(texts.last - texts.first)[one[new]], kind="stable")]
            added = _spelled_at_once(*texts.characters(words), m) @ m["W"][CLASS_DIM + WORD_DIM :] + m["b"]
            end = self.n + len(words)
            while end > len(self.gates):
                self.gates = np.concatenate([self.gates, np.empty_like(self.gates)])
            self.gates[self.n : end] = added
            hashes, at = np.concatenate([self.hashes, texts.hashes[words]]), np.concatenate([self.at, np.arange(self.n, end)])
            order = np.argsort(hashes)
            self.hashes, self.at, self.n = hashes[order], at[order], end
            place = np.searchsorted(self.hashes, own)
        return self.gates[self.at[place][which]]


def _aligned(x: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Turns the backward chain's columns round in time (its own inverse)."""
    return np.where(forward, x, x[::-1])


def _pooled(states: np.ndarray, mask: np.ndarray | None, m: dict):
    own = _aligned(states, _FORWARD[:_H2])
    inner = _tanh(own @ m["A"] + m["c"])
    score = inner @ m["v"]
    if mask is not None:
        score = np.where(mask > 0, score, -1e9)
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    context = (weight[:, :, None] * own).sum(0)
    return context @ m["o"] + m["p"][0], (own, inner, weight, context)


def _masks(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By word and window, and by step and chain."""
    by_word = (np.arange(WINDOW)[:, None] < length[None, :]).astype(np.float32)
    return by_word, np.where(_FORWARD[:_H2], by_word[:, :, None], by_word[::-1, :, None])


class Trainer:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        small = lambda *shape: (g.standard_normal(shape) * 0.25).astype(np.float32)
        classes = small(len(CLASSES) + 1, CLASS_DIM)
        classes[:, 0] = (np.arange(len(classes)) - NEUTRAL) / 4
        none = lambda *shape: np.zeros(shape, np.float32)
        self.m = {"E": classes, "H": none(BUCKETS, WORD_DIM), "C": small(256, CHAR_DIM), "Wc": small(CHAR_DIM, 3 * _C2), "bc": none(3 * _C2), "Uc": small(_C2, 3 * _C2) * _CHAR_CHAINS}
        self.m |= {"W": small(_D, 3 * _H2), "b": none(3 * _H2), "U": small(_H2, 3 * _H2) * _CHAINS, "A": small(_H2, ATTENTION), "c": none(ATTENTION), "v": small(ATTENTION), "o": small(_H2), "p": np.full(1, -1.0, np.float32)}
        self.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.m.items()}
        self.t = 0

    def step(self, number: np.ndarray, bucket: np.ndarray, shown: np.ndarray, word: np.ndarray, chars: np.ndarray, size: np.ndarray, length: np.ndarray, y: np.ndarray) -> float:
        """One step of Adam on windows: classes, buckets, whether the bucket's vector is shown, and numbers of words (word, window); characters and sizes of the words."""
        m, B = self.m, number.shape[1]
        spelled, (ahead, back, char_mask, char_kept) = _spelled(chars, size, m, True)
        x = np.concatenate([m["E"][number], m["H"][bucket] * shown[:, :, None], spelled[word]], axis=2)
        mask, chain_mask = _masks(length)
        gates = _aligned(x @ m["W"] + m["b"], _FORWARD)
        states, kept = _steps(gates, chain_mask, m["U"], True)
        logit, (own, inner, weight, context) = _pooled(states, mask, m)
        p = _sigmoid(logit)
        d = ((p - y) / B).astype(np.float32)
        g = {"o": context.T @ d, "p": d.sum(keepdims=True)}
        d_context = d[:, None] * m["o"]
        d_own = weight[:, :, None] * d_context[None]
        d_weight = (own * d_context[None]).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = (inner * d_score[:, :, None]).sum((0, 1))
        d_inner = d_score[:, :, None] * m["v"] * (1 - inner**2)
        g["A"], g["c"] = np.einsum("tbi,tbj->ij", own, d_inner), d_inner.sum((0, 1))
        d_states = _aligned(d_own + d_inner @ m["A"].T, _FORWARD[:_H2])
        d_gates, g["U"] = _steps_back(d_states, kept, chain_mask, m["U"])
        d_gates = _aligned(d_gates, _FORWARD)
        g["U"] *= _CHAINS
        g["W"], g["b"] = np.einsum("tbi,tbj->ij", x, d_gates), d_gates.sum((0, 1))
        d_x = d_gates @ m["W"].T
        g["E"], g["H"] = np.zeros_like(m["E"]), DECAY * m["H"]
        np.add.at(g["E"], number, d_x[:, :, :CLASS_DIM])
        np.add.at(g["H"], bucket, d_x[:, :, CLASS_DIM : CLASS_DIM + WORD_DIM] * shown[:, :, None])
        d_end = np.zeros((CHARS, *spelled.shape), spelled.dtype)
        np.add.at(d_end[-1], word, d_x[:, :, CLASS_DIM + WORD_DIM :])
        d_chars, g["Uc"] = _steps_back(d_end, char_kept, char_mask, m["Uc"])
        g["Uc"] *= _CHAR_CHAINS
        # the gates are looked up in a table of one row for each byte, so its gradient comes first
        d_table = np.zeros((256, 3 * _C2), d_chars.dtype)
        for own, columns in ((ahead, _CHAR_FORWARD), (back, ~_CHAR_FORWARD)):
            np.add.at(d_table, own, d_chars * columns)
        g["Wc"], g["bc"], g["C"] = m["C"].T @ d_table, d_table.sum(0), d_table @ m["Wc"].T
        self.t += 1
        for k, own in g.items():
            a, b = self.moments[k]
            a += 0.1 * (own - a)
            b += 0.001 * (own**2 - b)
            m[k] -= (RATE * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        return float(-np.log(np.where(y > 0, p, 1 - p) + 1e-9).mean())


def scores(texts: Texts, m: dict, spelling: Spelling, number: np.ndarray | None = None) -> np.ndarray:
    """The largest window logit of each text, NO_EVIDENCE without windows; number: classes of the words, if not the model's."""
    out = np.full(len(texts.at) - 1, NO_EVIDENCE)
    text, start, length = texts.windows()
    if not len(text):
        return out
    if number is None:
        number = _classes(m["vocabulary"], m["classes"], texts.hashes)
    gates = np.concatenate([m["E"][number], m["H"][bucket_of(texts.hashes)]], axis=1) @ m["W"][: CLASS_DIM + WORD_DIM] + spelling.of(texts)
    forward, backward = (np.ascontiguousarray(gates.reshape(-1, 3, 2, HIDDEN)[:, :, k]) for k in (0, 1))
    parts = np.empty(len(text), np.float32)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), 1024):
        some = order[i : i + 1024]
        size = length[some]
        full = size[-1] == WINDOW
        word = start[some][None, :] + np.minimum(np.arange(WINDOW)[:, None], size[None, :] - 1)
        own = np.empty((WINDOW, len(some), 3, 2, HIDDEN), np.float32)
        own[:, :, :, 0], own[:, :, :, 1] = forward[word], backward[word[::-1]]
        own = own.reshape(WINDOW, len(some), 3 * _H2)
        mask, chain_mask = (None, None) if full else _masks(size)
        states, _ = _steps(own, chain_mask, m["U"], False)
        parts[some] = _pooled(states, mask, m)[0]
    np.maximum.at(out, text, parts)
    return out


def fit(column: pa.Array, toxic: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), seed: int = 7) -> dict | None:
    """Trains on texts with labels; None if there is only one class.

    weight says for how many clean and toxic labelled rows one of the sample stands, for the calibration.
    """
    seen: dict[bytes, int] = {}
    raw = column.to_pylist()
    chosen = [i for i, t in enumerate(raw) if t and seen.setdefault(t, i) == i]
    column, toxic = pa.array([raw[i] for i in chosen], pa.large_string()), toxic[chosen]
    del raw, seen
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    runs = [(i, Texts(data, offsets)) for i, _, data, offsets in text_slices(column)]
    docs, words = [], []
    for i, t in runs:
        doc = i + np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))
        order = np.lexsort((t.hashes, doc))
        d, h = doc[order], t.hashes[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        docs.append(d[fresh])
        words.append(h[fresh])
    docs, words = np.concatenate(docs), np.concatenate(words)
    vocabulary, place = np.unique(words, return_inverse=True)
    fold = np.arange(len(toxic)) % FOLDS
    parts = [np.bincount(place * FOLDS + fold[docs], y[docs], len(vocabulary) * FOLDS).reshape(-1, FOLDS) for y in (toxic, 1 - toxic)]
    totals = [np.bincount(fold, y, FOLDS) for y in (toxic, 1 - toxic)]
    found = evidence(parts[0].sum(1), parts[1].sum(1), totals[0].sum(), totals[1].sum())
    best = np.flatnonzero(np.abs(found) >= 1.5)
    best = np.sort(best[np.lexsort((vocabulary[best], -np.abs(found[best])))][:VOCABULARY])
    vocabulary, classes = vocabulary[best], np.digitize(found[best], CLASSES)
    bad, good = (x[best].sum(1, keepdims=True) - x[best] for x in parts)
    n_bad, n_good = (t.sum() - t for t in totals)
    others = np.digitize(evidence(bad, good, n_bad, n_good), CLASSES)
    del docs, words, place, parts, bad, good, found
    tidy()

    def left_out(i: int, t: Texts) -> np.ndarray:
        """Classes of a run's words from the folds that don't hold the text."""
        own = np.repeat(fold[i : i + len(t.at) - 1], np.diff(t.at))
        out = np.full(len(own), NEUTRAL)
        for f in range(FOLDS):
            out[own == f] = _classes(vocabulary, others[:, f], t.hashes[own == f])
        return out

    g, trainer = np.random.default_rng(seed), Trainer(seed)
    plus = np.maximum(np.arange(len(CLASSES) + 1) - NEUTRAL, 0) ** 2
    number, hashes, words, length, y, seen_part = [], [], [], [], [], []
    for i, t in runs:
        own = left_out(i, t)
        upto = np.concatenate([[0], np.cumsum(plus[own])])
        text, start, size = t.windows()
        rank = np.lexsort((upto[start] - upto[start + size], text))
        place = np.arange(len(rank)) - np.searchsorted(text[rank], text[rank])
        label = toxic[i + text[rank]]
        # of toxic texts the two windows with the largest evidence, of clean ones also a few others
        pick = rank[(place < 2) & (label == 1) | (place < 1) & (label == 0) | (label == 0) & (g.random(len(rank)) < 2 / (1 + np.bincount(text)[text[rank]]))]
        span = np.minimum(start[pick][:, None] + np.arange(WINDOW), (start + size)[pick][:, None] - 1)
        number.append(own[span])
        hashes.append(t.hashes[span])
        words.append(t.characters(span.ravel())[0].reshape(*span.shape, CHARS))
        length.append(size[pick])
        y.append(toxic[i + text[pick]])
        seen_part.append(fold[i + text[pick]] != TEST_FOLD)
    number, hashes, words, length, y = (np.concatenate(x) for x in (number, hashes, words, length, y))
    learned = np.flatnonzero(np.concatenate(seen_part))
    if not len(learned) or y[learned].min() == y[learned].max():
        learned = np.arange(len(y))
    y = y.astype(np.float32)
    for _ in range(EPOCHS):
        order = g.permutation(learned)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            _, one, which = np.unique(hashes[some], return_index=True, return_inverse=True)
            chars = words[some].reshape(-1, CHARS)[one]
            shown = (g.random((WINDOW, len(some))) < 0.5).astype(np.float32)
            trainer.step(number[some].T, bucket_of(hashes[some]).T, shown, which.reshape(len(some), WINDOW).T, chars, (chars > 0).sum(1), length[some], y[some])
    m = trainer.m | {"vocabulary": vocabulary, "classes": classes}
    # calibration: a logistic fit of the label on the largest window logit
    spelling = Spelling(m)
    x = np.concatenate([scores(t, m, spelling, left_out(i, t)) for i, t in runs])
    apart = fold == TEST_FOLD
    if toxic[apart].sum() < TEST_TOXIC:
        apart[:] = True
    x, toxic = x[apart], toxic[apart]
    a, b, each = 1.0, 0.0, np.where(toxic == 1, weight[1], weight[0])
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = each * p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(each * (toxic - p) * x).sum() + (1 - a), (each * (toxic - p)).sum()])
        a, b = a + 0.5 * da, b + 0.5 * db
    return m | {"scale": (float(a), float(b))}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> dict | None:
    """The model from labels (doc_id, toxic) of rows outside the held-out third; one executor task fits it, and only the model comes to the driver.

    Of at most MAX_TOXIC + MAX_CLEAN labelled texts, those are left out that don't fit
    into what is left of max_bytes.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = durable(known.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").alias("toxic")), "labels")
    n = dict(known.groupBy("toxic").count().collect())
    parts = [known.filter(f"toxic = {v}").orderBy(F.xxhash64("id"), "id").limit(n) for v, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    # at most MAX_TOXIC + MAX_CLEAN rows
    chosen = parts[0].union(parts[1])
    found = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text").alias("text"))
    found = durable(found, "learned")
    # in the order of hashes, each row that still fits; at most MAX_TOXIC + MAX_CLEAN numbers
    sizes = found.agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("id").alias("hash"), "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")))).alias("rows"))
    none = F.struct(F.lit(0).cast("bigint").alias("bytes"), F.lit([]).cast("array<bigint>").alias("ids"))
    take = lambda a, x: F.when(a["bytes"] + x["bytes"] <= max_bytes, F.struct((a["bytes"] + x["bytes"]).alias("bytes"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    fitting = sizes.select(F.explode(F.reduce("rows", none, take)["ids"]).alias("id"))
    weight = tuple(max(1.0, n.get(v, 0) / most) for v, most in ((0, MAX_CLEAN), (1, MAX_TOXIC)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows).sort_by("id")
            model = fit(table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(np.int64), weight)
            del rows, table
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # a bounded number of rows and bytes, so one task can hold them
    made = found.join(F.broadcast(fitting), "id").select("id", "toxic", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """(id, score) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(model) if model else None
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                if model is None:
                    p = np.zeros(j - i)
                else:
                    a, b = model["scale"]
                    p = _sigmoid(a * scores(Texts(data, offsets), model, spelling) + b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p, pa.float64())], ["id", "score"])
        del spelling
        tidy()

    return rows.mapInArrow(run, "id bigint, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(id_text(docs), model)
    return out.select(
        F.col("id").alias("doc_id"),
        (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("None"))) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text the model rejects; same columns."""
    model = train(docs, labels, id_col, text_col)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(model) if model else None
        for batch in batches:
            if model is None:
                yield batch
                continue
            keep = []
            a, b = model["scale"]
            for _, _, data, offsets in text_slices(batch.column(at)):
                keep.append(_sigmoid(a * scores(Texts(data, offsets), model, spelling) + b) < REJECT)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))
        del spelling
        tidy()

    return docs.mapInArrow(run, schema)


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
