"""Elias-Fano sequences and a two-level n-gram trie on them, over arrays.

A non-decreasing sequence of n numbers below u keeps its low bits packed and
its high bits in unary: about 2 + log2(u / n) bits a number, and stays so in
memory; a directory of 4 bytes for every 64 high bits finds a number's place.
All lookups take arrays of queries.  Levels live in one memory map per trie,
which is anonymous: a task has no folder of its own that it may count on.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        first = np.r_[0, np.flatnonzero(np.diff(word)) + 1]
        out[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + width > 64)
        out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


class EliasFano:
    """A sequence of ``size`` numbers; ``low``, ``high`` are views of a map."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray):
        self.size, self.width, self.low, self.high = size, width, low, high
        ones = np.bitwise_count(high).astype(np.uint32)
        self.before = np.cumsum(ones, dtype=np.uint32) - ones

    def _place(self, i: np.ndarray) -> np.ndarray:
        """Bit that stands for number ``i``: its word, then halves of the word."""
        at = np.searchsorted(self.before, i.astype(np.uint32), "right") - 1
        rest, word = i - self.before[at], self.high[at]
        bit = at * 64
        for half in (32, 16, 8, 4, 2, 1):
            side = word & _U((1 << half) - 1)
            ones = np.bitwise_count(side)
            up = rest >= ones
            rest = rest - np.where(up, ones, 0)
            word = np.where(up, word >> _U(half), side)
            bit = bit + half * up
        return bit

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        values = values.astype(_U)
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = _pack(values & _U((1 << width) - 1), width)
        high = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) if n else 0) // 64 + 1, _U)
        word = high >> 6
        first = np.r_[0, np.flatnonzero(np.diff(word)) + 1] if n else np.zeros(0, np.int64)
        if n:
            bits[word[first]] = np.bitwise_or.reduceat(_U(1) << (high & 63).astype(_U), first)
        return width, low, bits

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at positions ``i``."""
        i = i.astype(np.int64)
        high = (self._place(i) - i).astype(_U)
        if not self.width:
            return high
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        low = self.low[word] >> shift
        over = (at & 63) + self.width > 64
        low = np.where(over, low | (self.low[word + 1] << ((_U(64) - shift) & _U(63))), low)
        return (high << _U(self.width)) | (low & _U((1 << self.width) - 1))

    def successor(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Position of the first number from ``low`` on that is at least ``x``
        (``high`` if none before it is)."""
        low, high = low.astype(np.int64), high.astype(np.int64)
        while True:
            go = np.flatnonzero(low < high)
            if not len(go):
                return low
            mid = (low[go] + high[go]) >> 1
            less = self.get(mid) < x[go]
            low[go[less]] = mid[less] + 1
            high[go[~less]] = mid[~less]


#: Log probabilities are kept in steps of this many log10 units, 16 bits each.
STEP = 1 / 2048


def quantise(log10_p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10_p / STEP), 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return -STEP * code.astype(np.float64)


class Trie:
    """Contexts, pointers into their successors, and quantised probabilities.

    Successors are numbered within their context: number w after the i-th
    context is stored as ``i * words + w``, so one monotone sequence holds all
    of them and a search stays between two pointers.
    """

    def __init__(self, blob):
        self.map = mmap.mmap(-1, max(len(blob), 1))
        self.map[:len(blob)] = bytes(blob)
        head = np.frombuffer(self.map, np.int64, 8)
        self.words = int(head[0])
        self.levels, at = [], 64
        for size, width in head[1:7].reshape(3, 2):
            n_low, n_high = np.frombuffer(self.map, np.int64, 2, at)
            low = np.frombuffer(self.map, _U, int(n_low), at + 16)
            at += 16 + 8 * int(n_low)
            high = np.frombuffer(self.map, _U, int(n_high), at)
            at += 8 * int(n_high)
            self.levels.append(EliasFano(int(size), int(width), low, high))
        self.contexts, self.pointers, self.successors = self.levels
        self.codes = np.frombuffer(self.map, np.uint16, self.successors.size, at)
        at += (2 * self.successors.size + 7) // 8 * 8
        self.backoff = np.frombuffer(self.map, np.uint16, self.contexts.size, at)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, log10_p: np.ndarray, backoff, words: int) -> bytes:
        """From sorted distinct (context, word); ``backoff(contexts)`` gives
        the log10 weight of what a context has not seen."""
        first = np.flatnonzero(np.r_[True, np.diff(context) != 0]) if len(context) else np.zeros(0, np.int64)
        contexts = context[first]
        number = np.zeros(len(context), np.int64)
        number[first] = 1
        number = np.cumsum(number) - 1
        pointers = np.append(first, len(context))
        levels = [(contexts, words), (pointers, len(context) + 1),
                  (number.astype(_U) * _U(words) + word.astype(_U), max(1, len(contexts)) * words)]
        head, body = [words], []
        for values, universe in levels:
            width, low, high = EliasFano.parts(values, universe)
            head += [len(values), width]
            body += [np.array([len(low), len(high)], np.int64).tobytes(), low.tobytes(), high.tobytes()]
        codes, weights = quantise(log10_p).tobytes(), quantise(backoff(contexts)).tobytes()
        return b"".join([np.array([*head, 0], np.int64).tobytes(), *body,
                         codes.ljust((len(codes) + 7) // 8 * 8, b"\0"), weights])

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each pair: is the context known, its backoff, is the pair
        known, its log10 probability (0 where unknown)."""
        n = self.contexts.size
        known = np.zeros(len(context), bool)
        hit = np.zeros(len(context), bool)
        weight, p = np.zeros(len(context)), np.zeros(len(context))
        if not n:
            return known, weight, hit, p
        # contexts repeat in runs: each is looked up once
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        asked = context[first].astype(_U)
        i = self.contexts.successor(asked, np.zeros(len(first)), np.full(len(first), n))
        i = np.minimum(i, n - 1)
        there = self.contexts.get(i) == asked
        # the successors of a context stand between two pointers
        begin, end = self.pointers.get(i), self.pointers.get(i + 1)
        of = np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1
        known = there[of]
        weight = np.where(known, restore(self.backoff[i])[of], 0.0)
        at = np.flatnonzero(known)
        of = of[at]
        key = i[of].astype(_U) * _U(self.words) + word[at].astype(_U)
        j = self.successors.successor(key, begin[of], end[of])
        inside = j < end[of].astype(np.int64)
        j = np.minimum(j, self.successors.size - 1)
        inside &= self.successors.get(j) == key
        hit[at[inside]] = True
        p[at[inside]] = restore(self.codes[j[inside]])
        return known, weight, hit, p
