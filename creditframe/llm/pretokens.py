"""Byte-level BPE encoding of many texts through the ``tokenizers`` library.

A byte-level BPE merges only inside pre-tokens, so every distinct pre-token
is encoded once per worker (by the library's model) and its ids are reused.  Pre-tokens are cut for a
whole batch at a time with array operations.  A text goes through the library
as it stands when it holds a code point whose letter/number class is newer
than Unicode 3.2, or the string of a special token.
"""

from __future__ import annotations

import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Cuts between texts of a batch; UTF-8 text cannot hold it.
_CUT = 0xD800
_OTHER, _LETTER, _NUMBER, _SPACE, _END, _RARE = range(6)
#: The code points with the White_Space property.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the pattern parts after an apostrophe.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")

CACHE = 1 << 20
GROUP_CHARS = 4 << 20


def code_point_classes() -> np.ndarray:
    """Class of every code point; ``_RARE`` where old and new Unicode differ."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x110000, _RARE, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        now = unicodedata.category(ch)
        if now != "Cn" and kinds.get(now[0]) == kinds.get(old(ch)[0]) and old(ch) != "Cn":
            out[c] = kinds.get(now[0], _OTHER)
    out[_WHITE] = _SPACE
    out[0x180E] = _RARE
    out[_CUT] = _END
    return out


def cut(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of texts that each end with ``_CUT``."""
    n = len(points)
    kind = classes[points]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _END, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = _END, kind[1:]
    blank = points == 0x20
    blank_before = np.empty(n, bool)
    blank_before[0], blank_before[1:] = False, blank[:-1]
    space = kind == _SPACE
    end = kind == _END
    # a run starts a pre-token unless the blank before it belongs to it; of a
    # white-space run before other text the last character stands apart
    start = ((kind != before) & (space | ~blank_before)) | end | (space & (after != _SPACE) & (after != _END))
    quote = np.flatnonzero((points == 0x27) & start & (after == _LETTER))
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        size = np.where(np.isin(one, [ord(c) for c in _SHORT]), 2, 0)
        for a, b in _LONG:
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        more = hit + size
        start[more[kind[more] == _LETTER]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself
    where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes lists of texts; keeps the ids of the pre-tokens it has seen."""

    def __init__(self, file: str, end_id: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.end_id = end_id
        self.classes = code_point_classes()
        self._forget()

    def _forget(self):
        self.seen: dict[bytes, int] = {chr(_CUT).encode("utf-8", "surrogatepass"): 0}
        self.ids = np.array([self.end_id], np.uint32)
        self.first = np.array([0], np.int32)
        self.size = np.array([1], np.int32)

    def _slots(self, tokens: list[bytes]) -> np.ndarray:
        """Where the ids of each token stand; unknown tokens are encoded."""
        slots = np.fromiter(map(self.seen.get, tokens, repeat(-1)), np.int32, len(tokens))
        unknown = np.flatnonzero(slots < 0)
        if not len(unknown):
            return slots
        if len(self.seen) + len(unknown) > CACHE:
            self._forget()
            slots = np.fromiter(map(self.seen.get, tokens, repeat(-1)), np.int32, len(tokens))
            unknown = np.flatnonzero(slots < 0)
        return self._learn(tokens, slots, unknown)

    def _learn(self, tokens: list[bytes], slots: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        new = [tokens[i] for i in unknown.tolist()]
        letters, tokenize = self.letters, self.model.tokenize
        got = [[x.id for x in tokenize(t.decode("latin-1").translate(letters))] for t in new]
        counts = np.fromiter(map(len, got), np.int32, len(got))
        base = len(self.size)
        self.seen.update(zip(new, range(base, base + len(new))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts, dtype=np.int32) - counts])
        self.size = np.concatenate([self.size, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        slots[unknown] = np.arange(base, base + len(new), dtype=np.int32)
        return slots

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        joined = chr(_CUT).join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = joined.encode("utf-8", "surrogatepass")
        starts = cut(points, self.classes)
        if len(data) == len(points):
            offsets = np.append(starts, len(data)).astype(np.int32)
        else:
            width = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
            offsets = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(np.add.reduceat(width, starts, dtype=np.int32), out=offsets[1:])
        tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found = tokens.dictionary_encode()
        slot = self._slots(found.dictionary.to_pylist())[found.indices.to_numpy()]
        size = self.size[slot]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.first[slot] - (ends - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return np.split(self.ids[at], ends[np.flatnonzero(points[starts] == _CUT)])[:-1]

    def _whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array([*ids, self.end_id], np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text, its end id included; null is the empty text."""
        out: list[np.ndarray] = []
        group: list[str] = []
        held = 0
        for text in texts:
            text = text or ""
            if any(s in text for s in self.special) or not text.isascii() and (
                    self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == _RARE).any():
                out += self._group(group) if group else []
                out.append(self._whole(text))
                group, held = [], 0
                continue
            group.append(text)
            held += len(text)
            if held >= GROUP_CHARS:
                out += self._group(group)
                group, held = [], 0
        return out + (self._group(group) if group else [])
