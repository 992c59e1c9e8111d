"""Canonical length-limited Huffman codes over token ids, on arrays.

Lengths come from the package-merge method, codes are canonical (by length,
then id).  ``pack`` writes a bit stream with the bit offset of every
``STEP``-th id; ``unpack`` decodes all these stretches side by side through
one table of ``LIMIT`` bits.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20
STEP = 256


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of every symbol (0 where the count is 0), at most ``limit``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weight = np.concatenate([leaves, packages])
        merged = np.argsort(weight, kind="stable")
        levels.append(merged < n)
        weight = weight[merged]
        pairs = len(weight) // 2
        packages = weight[0:2 * pairs:2] + weight[1:2 * pairs:2]
    take = 2 * (n - 1)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        out[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """Canonical codes for ``length``."""
    used = np.flatnonzero(length)
    order = used[np.argsort(length[used], kind="stable")]
    out = np.zeros(len(length), np.uint32)
    width = length[order].astype(np.int64)
    # a code is the sum of the shares of the code space before it
    share = (1 << (LIMIT - width)).astype(np.int64)
    out[order] = ((np.cumsum(share) - share) >> (LIMIT - width)).astype(np.uint32)
    return out


def decode_table(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for every ``LIMIT``-bit prefix."""
    used = np.flatnonzero(length)
    order = used[np.argsort(length[used], kind="stable")]
    share = 1 << (LIMIT - length[order].astype(np.int64))
    symbol = np.zeros(1 << LIMIT, np.uint32)
    size = np.ones(1 << LIMIT, np.uint8)
    filled = np.repeat(order, share)
    symbol[:len(filled)] = filled
    size[:len(filled)] = length[filled]
    return symbol, size


def pack(ids: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of ``ids`` and the bit offsets of every ``STEP``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = length[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, shift = starts >> 5, starts & 31
    value = code[ids].astype(np.uint64) << (64 - size - shift).astype(np.uint64)
    out = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
    first = np.r_[0, np.flatnonzero(np.diff(word)) + 1]
    # bits are disjoint, so sums are unions
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[:(int(ends[-1]) + 7) // 8], starts[::STEP]


def unpack(stream: bytes, n: int, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a stream, every stretch between offsets side by side."""
    if not n:
        return np.zeros(0, np.uint32)
    symbol, size = table
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    last = 8 * len(stream)
    at = np.asarray(offsets).astype(np.int32 if last < 1 << 31 else np.int64)
    out = np.empty((STEP, len(at)), np.uint32)
    for i in range(STEP):
        prefix = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[i] = symbol[prefix]
        at += size[prefix]
        np.minimum(at, last, out=at)
    return out.T.reshape(-1)[:n]
