"""A two-level n-gram trie of Elias-Fano sequences, in a memory-mapped file."""

from __future__ import annotations

import os
import tempfile

import numpy as np


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Place of the i-th set bit; ``before``: set bits ahead of each word."""
    at = np.searchsorted(before, i, side="right") - 1
    left, word, place = i - before[at], words[at], np.zeros(len(i), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << half) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        right = left >= n
        left = left - np.where(right, n, 0)
        word = np.where(right, word >> np.uint64(half), low)
        place += np.where(right, half, 0)
    return at * 64 + place


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        values = values.astype(np.uint64)
        self.n, self.low_bits = n, max(0, min(48, (universe // max(1, n)).bit_length() - 1))
        low_bits = np.uint64(self.low_bits)
        bit = np.arange(n, dtype=np.uint64) * low_bits
        low = values & np.uint64((1 << self.low_bits) - 1)
        packed = np.zeros(n * self.low_bits // 64 + 2, np.uint64)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        np.bitwise_or.at(packed, word, low << shift)
        spill = shift + low_bits > 64
        np.bitwise_or.at(packed, word[spill] + 1, low[spill] >> (np.uint64(64) - shift[spill]))
        high = (values >> low_bits).astype(np.int64)
        self.buckets = int(universe >> self.low_bits) + 1
        bits = np.zeros(-(-(n + self.buckets + 1) // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        self.parts = {"low": packed, "high": np.packbits(bits, bitorder="little").view(np.uint64)}
        self._count()

    def _count(self) -> None:
        ones = np.bitwise_count(self.parts["high"]).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)[:-1]])
        self.zeros = np.arange(len(ones)) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.parts["low"][word] >> shift
        value |= np.where(shift > 0, self.parts["low"][word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.parts["high"], self.ones, i) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``h``."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        out[some] = _select(~self.parts["high"], self.zeros, h[some] - 1) - (h[some] - 1)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is ``x`` or more (``n`` if none): its bucket, then its low bits."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        x = x.astype(np.uint64)
        h = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), self.buckets - 1)
        low, below, above = x & np.uint64((1 << self.low_bits) - 1), self._bucket(h), self._bucket(h + 1)
        while (open_ := below < above).any():
            middle = (below + above) // 2
            less = np.zeros(len(x), bool)
            less[open_] = self._low(middle[open_]) < low[open_]
            below = np.where(open_ & less, middle + 1, below)
            above = np.where(open_ & ~less, middle, above)
        return below


#: Bits of a context's key below its word's number.
KEY_BITS = 40


class Trie:
    """Words, and under each word the contexts it was seen in.

    Level 1 holds the words' 62-bit keys; monotone pointers give each word's range in level 2,
    which holds the contexts' keys relative to the word: word number x 2**40 + key, so the whole
    level is one rising sequence and a context is found by a successor search from its word's
    base. Each entry has a quantised value in 16 bits. All arrays lie in one memory-mapped file,
    which is removed as soon as it is mapped: it goes with the process.
    """

    def __init__(self, words: np.ndarray, word_values: np.ndarray, owner: np.ndarray, contexts: np.ndarray, values: np.ndarray):
        self.words = EliasFano(words, 1 << 62)
        starts = np.searchsorted(owner, np.arange(len(words) + 1))
        self.pointers = EliasFano(starts, len(contexts) + 1)
        self.contexts = EliasFano((owner.astype(np.uint64) << np.uint64(KEY_BITS)) | contexts, max(1, len(words)) << KEY_BITS)
        both = np.concatenate([word_values, values])
        self.least, top = (float(both.min()), float(both.max())) if len(both) else (0.0, 0.0)
        self.step = (top - self.least) / 65535 or 1.0
        self.word_codes, self.codes = self._code(word_values), self._code(values)
        self._map()

    def _code(self, values: np.ndarray) -> np.ndarray:
        return np.rint((values - self.least) / self.step).astype(np.uint16)

    def _map(self) -> None:
        places = [(s.parts, k) for s in (self.words, self.pointers, self.contexts) for k in s.parts] + [(self.__dict__, "word_codes"), (self.__dict__, "codes")]
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(handle, "wb") as f:
                spans = []
                for holder, k in places:
                    f.write(b"\0" * (-f.tell() % 8))
                    spans.append((holder, k, f.tell(), holder[k].dtype, len(holder[k])))
                    holder[k].tofile(f)
                f.write(b"\0" * 8)
            self.bytes = os.path.getsize(path)
            for holder, k, at, kind, n in spans:
                holder[k] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
        finally:
            os.unlink(path)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.least + self.step * codes

    def find(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The value of each context under its word, else the word's own; every word must be there."""
        number = self.words.successor(words)
        at = self.contexts.successor((number.astype(np.uint64) << np.uint64(KEY_BITS)) | contexts)
        hit = at < self.pointers.get(number + 1).astype(np.int64)
        seen = np.flatnonzero(hit)
        hit[seen] = (self.contexts.get(at[seen]) & np.uint64((1 << KEY_BITS) - 1)) == contexts[seen]
        out = self.value(self.word_codes[number])
        out[hit] = self.value(self.codes[at[hit]])
        return out
