"""Tokenizer ids of whole texts, through the tokenizers library, with words remembered per Python worker.

The vocabulary drops white space and never joins across it, so the ids of a
text are those of its words one after another.  Each distinct lower-cased word
is encoded by the library once per worker; an ASCII letter followed by closing
ASCII punctuation (no apostrophe) is a sure cut, so such words are put together
from the two parts.  Words of letters alone end in just one token that closes a
word, so many of them are encoded as one text and cut at those.  Texts that hold
``<|``, with which special tokens begin, are encoded whole.

Known words lie in a table of their 64-bit hashes, 12 bytes for each place, and are
looked up by whole slices of text.  WORDS bounds the memory of the table, not the
result; a text longer than a slice is taken in parts that end at white space.
"""

from __future__ import annotations

from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from sparkloom.llm.common import tidy
from sparkloom.llm.shingles import text_slices, words_in

WORDS, SLICE = 500_000, 1 << 18
_SPACES = b"\x20\t\n\x0b\x0c\r"
_U = np.uint64
_CLOSING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = frozenset(range(97, 123))
_ENCODERS: dict[str, Encoder] = {}


class Table:
    """Numbers of 64-bit hashes, by open addressing; -1 for unknown ones."""

    def __init__(self, places: int):
        self.mask = _U(places - 1)
        self.hashes, self.numbers, self.n = np.zeros(places, _U), np.full(places, -1, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            number = self.numbers[slot]
            found = self.hashes[slot] == hashes[left]
            out[left] = np.where(found, number, -1)
            # an empty place ends the search
            on = np.flatnonzero(~found & (number >= 0))
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        self.n += len(hashes)
        if 2 * self.n > len(self.hashes):
            before = np.flatnonzero(self.numbers >= 0)
            hashes, numbers = np.concatenate([self.hashes[before], hashes]), np.concatenate([self.numbers[before], numbers])
            self.__init__(2 * len(self.hashes))
            self.n = len(hashes)
        left, slot = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(left):
            # of several that want an empty place, the first gets it
            free = np.flatnonzero(self.numbers[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.hashes[at], self.numbers[at] = hashes[left[put]], numbers[left[put]]
            on = np.ones(len(left), bool)
            on[put] = False
            left, slot = left[on], slot[on]
            slot = np.where(self.hashes[slot] != hashes[left], (slot + 1) & int(self.mask), slot)


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Of words without white space."""
    sizes = np.array([len(w) for w in words], np.int64)
    return words_in(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))[0]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.narrow = self.library.get_vocab_size() <= 1 << 16
        self.closes = np.zeros(self.library.get_vocab_size(), bool)
        self.closes[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words = Table(1 << 16)
        self.n, self.used = 0, 0
        self.at, self.size, self.then = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.pool = np.zeros(1 << 18, np.uint32)

    def add(self, at: np.ndarray | int, size: np.ndarray | int, then: np.ndarray | int, n: int) -> range:
        """n entries: their ids' place in the pool and number, and the entry that follows them (-1: none)."""
        while self.n + n > len(self.at):
            self.at, self.size, self.then = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.then))
        own = slice(self.n, self.n + n)
        self.at[own], self.size[own], self.then[own] = at, size, then
        self.n += n
        return range(self.n - n, self.n)

    def put(self, ids, sizes) -> range:
        """Puts ids into the pool, as entries of these sizes."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        sizes = np.asarray(sizes, np.int64)
        self.used += len(ids)
        return self.add(self.used - len(ids) + np.cumsum(sizes) - sizes, sizes, -1, len(sizes))

    def learn(self, words: list[bytes]) -> None:
        """Encodes distinct words that aren't known yet."""
        todo: dict[bytes, None] = {}
        joined = []
        for w in words:
            core = w.rstrip(_CLOSING)
            if core and len(core) < len(w) and core[-1] in _LETTERS:
                joined.append((w, core, closing := w[len(core) :]))
                todo[core] = todo[closing] = None
            else:
                todo[w] = None
        todo = list(todo)
        hashes = hashes_of(todo)
        new = np.flatnonzero(self.words.find(hashes) < 0)
        hashes, todo = hashes[new], [todo[k] for k in new.tolist()]
        texts = [w.decode() for w in todo]
        plain = [t.isalpha() and (t.isascii() or t.lower().isalpha() and is_normalized("NFC", t)) for t in texts]
        other = [k for k, p in enumerate(plain) if not p]
        plain = [k for k, p in enumerate(plain) if p]
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            ids = np.array(self.library.encode_batch_fast([" ".join([texts[k] for k in some])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self.words.add(hashes[some], np.array(self.put(ids, np.diff(ends, prepend=0)), np.int32))
            else:
                other += some
        if other:
            found = [e.ids for e in self.library.encode_batch_fast([texts[k] for k in other], add_special_tokens=False)]
            self.words.add(hashes[other], np.array(self.put([x for ids in found for x in ids], [len(ids) for ids in found]), np.int32))
        if joined:
            core, then = (self.words.find(hashes_of([x[j] for x in joined])) for j in (1, 2))
            self.words.add(hashes_of([w for w, _, _ in joined]), np.array(self.add(self.at[core], self.size[core], then, len(core)), np.int32))

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all words in order, and each text's first index among them (plus the end)."""
        raw = data.tobytes()
        hashes, first, last, at = words_in(data, offsets)
        special = []
        if b"<|" in raw:
            cuts = offsets.tolist()
            special = [k for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if raw.find(b"<|", a, b) >= 0]
        if special:
            keep = np.ones(len(hashes), bool)
            for k in special:
                keep[at[k] : at[k + 1]] = False
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            hashes, first, last = hashes[keep], first[keep], last[keep]
        numbers = self.words.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            _, one = np.unique(hashes[missing], return_index=True)
            some = missing[one]
            self.learn([raw[a:b].lower() for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)])
            numbers[missing] = self.words.find(hashes[missing])
        if special:
            ids = [self.library.encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids for k in special]
            whole = [self.put(x, [len(x)])[0] for x in ids]
            numbers = np.insert(numbers, at[special], whole)
            more = np.zeros(len(at), np.int64)
            more[np.array(special) + 1] = 1
            at = at + np.cumsum(more)
        return numbers, at

    def flat(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, and where each text's begin (plus the end)."""
        then = self.then[numbers]
        two = np.flatnonzero(then >= 0)
        size = self.size[numbers].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size + np.where(then >= 0, self.size[then], 0))])
        numbers = np.insert(numbers, two + 1, then[two])
        size = self.size[numbers].astype(np.int64)
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[numbers] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        return ids, upto[at]

    def encode(self, column: pa.Array, end_id: int):
        """(first row, ids, offsets) for runs of texts; each text's ids end with end_id."""
        for i, j, data, offsets in text_slices(column, SLICE):
            if self.words.n > WORDS:
                self.clear()
            end = self.put([end_id], [1])[0]
            if j == i + 1 and len(data) > 2 * SLICE and b"<|" not in data.tobytes():
                ids = [self.flat(*self.numbers(part, np.array([0, len(part)])))[0] for part in parts_of(data)]
                ids.append(np.array([end_id], np.uint32))
                flat = np.concatenate(ids)
                yield i, flat, np.array([0, len(flat)])
                continue
            numbers, at = self.numbers(data, offsets)
            numbers = np.insert(numbers, at[1:], end)
            flat, cuts = self.flat(numbers, at + np.arange(len(at)))
            yield i, flat, cuts


def parts_of(data: np.ndarray):
    """data cut after white space into parts of about SLICE bytes."""
    raw, a = data.tobytes(), 0
    while a < len(raw):
        b = a + SLICE
        if b < len(raw):
            ends = [e for e in (raw.find(bytes([c]), b, b + SLICE) for c in _SPACES) if e >= 0]
            # a word longer than a slice ends at the next white space of any kind
            b = min(ends or [e for e in (raw.find(bytes([c]), b) for c in _SPACES) if e >= 0] or [len(raw) - 1]) + 1
        yield data[a:b]
        a = b


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; by default the public one of 49 thousand words."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        # what reading the vocabulary took
        tidy()
    return _ENCODERS[path]
