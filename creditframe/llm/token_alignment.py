"""Cross-tokenizer alignment by an associative monoid of text fragments.

Two tokenizers cut the bytes of a text (a space in front) differently.  Where
tokens of both end, a group of aligned tokens ends.  A byte range of a text
gives a *fragment*: an open prefix (tokens up to its first common end), closed
groups, and an open suffix (tokens after its last common end).  Fragments
compose associatively: a suffix and the prefix that follows it close one more
group, a fragment without a common end lengthens its neighbour.

Texts of up to ``CHUNK`` bytes are one fragment.  Longer ones are cut into
byte ranges that are tokenised in tasks of their own - from the last place
before the range to the first place behind it where neither tokenizer joins
the sides (a blank after other text) - and the fragments are composed by a
tree reduction, ``FAN`` at a time, in which only open ends travel.

Links: every elementary stretch between neighbouring ends (of either
tokenizer) is the overlap of exactly one token of each, so links are counted
by one pass over the marked ends.  How often a pair of ids is linked in the
corpus is summed from packs (distinct pairs of about ``PACK`` links), and the
totals go back to the packs by a join on the pair; a pair that is linked in
every text crosses a shuffle once per pack.

Memory: one group of texts (``GROUP`` bytes), one pack, one chunk.  A text
without any blank cannot be cut and is one chunk.  The pair totals are never
broadcast by hint and never collected.

Edge cases: null and empty texts, and texts that a tokenizer does not give
back byte by byte, have no tokens: all counts 0 and an empty digest; strings
of special tokens inside texts are plain text; repeated rows and null ids are
aligned one by one; an empty table gives an empty result; other columns do not
matter, the result has its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import per_worker, tokenizer_file, written
from .lm import _unz, _z
from .pretokens import Encoder, byte_letters

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 16
GROUP = 1 << 20
PACK = 2 << 20
FAN = 64
#: Pre-tokens and words whose ids a worker keeps, per tokenizer.
CACHE = 1 << 18


# ------------------------------------------------------------- the tokenizers
class _Table:
    """Bytes of every id, in one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ``ids``, size of each)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size)
        return self.data[at + np.arange(len(at))], size


class ByteLevel:
    """The byte-level vocabulary; texts arrive with their space in front."""

    def __init__(self, file: str):
        self.encoder = Encoder(file, 0)
        self.encoder.special = []
        self.encoder.tokenizer.encode_special_tokens = True
        vocabulary = self.encoder.tokenizer.get_vocab()
        byte = {v: k for k, v in byte_letters().items()}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.table = _Table(tokens)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.encoder.seen) > CACHE:
            self.encoder._forget()
        return [x[:-1].astype(np.int64) for x in self.encoder.encode([t.decode() for t in texts])]


class Pieces:
    """The piece vocabulary, which puts the space in front itself.

    No piece joins other text to a blank behind it, so every stretch of
    blanks and what follows is encoded once per worker and its ids are reused
    (a vocabulary that does join them is asked for whole texts)."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_words = not any(re.search("[^▁]▁", p) for p in pieces)
        self.blank = np.array([self.model.piece_to_id("▁")], np.int64)
        self.table = _Table([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in enumerate(pieces)])
        self._forget()

    def _forget(self):
        self.seen: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        got = self.model.encode([w.decode()[1:] for w in new], num_threads=1)
        got = [g or ([int(self.blank[0])] if w == b" " else []) for g, w in zip(got, new)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        self.seen.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.size = np.concatenate([self.size, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.int64)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(x, np.int64) for x in self.model.encode([t.decode()[1:] for t in texts], num_threads=1)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        blank = data == 32
        start = blank & ~np.r_[False, blank[:-1]]
        begins = np.cumsum([0, *map(len, texts)])
        start[begins[:-1]] = True
        at = np.flatnonzero(start).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(data)))),
                                                             pa.py_buffer(data)]).dictionary_encode()
        tokens = words.dictionary.to_pylist()
        if len(self.seen) + len(tokens) > CACHE:
            self._forget()
        new = [w for w in tokens if w not in self.seen]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.seen.get, tokens, repeat(-1)), np.int64, len(tokens))[words.indices.to_numpy()]
        size = self.size[slot]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[slot] - (ends - size), size) + np.arange(ends[-1])]
        last = np.searchsorted(at, begins[1:], "left") - 1
        return np.split(ids, ends[last])[:-1]


class Tokenizers:
    """Both vocabularies, and the strings of a group's digest."""

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.n_a, self.n_b = len(self.a.table.size), len(self.b.table.size)
        self.text = [f"{i}{sep}" for n in (self.n_a, self.n_b) for i in range(n) for sep in (",", "|", ";", "")]

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both per text, and which texts both give back."""
        whole = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        fine = np.ones(len(texts), bool)
        found = []
        for tokenizer in (self.a, self.b):
            ids = tokenizer.encode(texts)
            found.append(ids)
            total = np.array([int(tokenizer.table.size[x].sum()) for x in ids], np.int64)
            same = np.flatnonzero(total == sizes)
            fine &= total == sizes
            spelled, _ = tokenizer.table.spelled(np.concatenate([*(ids[i] for i in same), np.zeros(0, np.int64)]))
            there = whole if len(same) == len(texts) else np.concatenate(
                [*(whole[ends[i] - sizes[i]:ends[i]] for i in same), whole[:0]])
            wrong = np.flatnonzero(spelled != there)
            if len(wrong):
                fine[same[np.searchsorted(np.cumsum(sizes[same]), wrong, "right")]] = False
        return *found, fine


def _tokenizers(files: tuple[str, str]) -> Tokenizers:
    return per_worker(("token-alignment", *files), lambda: Tokenizers(*files))


# ----------------------------------------------------------------- alignment
class Aligned:
    """Links and groups of some units (closed runs of groups), side by side.

    ``a_ends``, ``b_ends``: where tokens end, counted through all units; the
    last token of a unit ends where the unit does in both."""

    def __init__(self, both: Tokenizers, a_ids, a_ends, b_ids, b_ends, unit_ends):
        n = int(unit_ends[-1]) if len(unit_ends) else 0
        mark = np.zeros(n + 1, np.uint8)
        mark[a_ends] = 1
        mark[b_ends] |= 2
        at = np.flatnonzero(mark)
        kind = mark[at]
        is_a, is_b = kind & 1, kind >> 1
        common = kind == 3
        self.links = a_ids[np.cumsum(is_a) - is_a] * both.n_b + b_ids[np.cumsum(is_b) - is_b]
        self.unit_ends = unit_ends
        upto = np.searchsorted(at, unit_ends, "right")
        self.n_links = np.diff(np.r_[0, upto])
        sums = np.r_[0, np.cumsum(common)]
        self.n_groups = np.diff(np.r_[0, sums[upto]])
        self.n_a = np.diff(np.r_[0, np.searchsorted(a_ends, unit_ends, "right")])
        self.n_b = np.diff(np.r_[0, np.searchsorted(b_ends, unit_ends, "right")])
        group = np.cumsum(common) - common
        self._order(both, a_ids, b_ids, group[is_a == 1], group[is_b == 1], int(sums[-1]))

    def _order(self, both, a_ids, b_ids, a_group, b_group, groups):
        """Ids of each group, those of the first tokenizer before the others,
        as codes of the strings in ``both.text``."""
        after_a = np.r_[0, np.cumsum(np.bincount(a_group, minlength=groups))]
        after_b = np.r_[0, np.cumsum(np.bincount(b_group, minlength=groups))]
        place_a = np.arange(len(a_ids)) + after_b[a_group]
        place_b = np.arange(len(b_ids)) + after_a[b_group + 1]
        n = len(a_ids) + len(b_ids)
        code, second, group = np.empty(n, np.int64), np.zeros(n, bool), np.empty(n, np.int64)
        code[place_a], code[place_b] = a_ids, b_ids + both.n_a
        second[place_b] = True
        group[place_a], group[place_b] = a_group, b_group
        sep = np.where(group[1:] != group[:-1], 2, np.where(second[1:] != second[:-1], 1, 0))
        code *= 4
        code[:-1] += sep
        cut = np.cumsum(self.n_a + self.n_b)
        last = cut[self.n_a + self.n_b > 0] - 1
        code[last] = code[last] // 4 * 4 + 3
        self._codes, self._cut, self._text = code, cut, both.text

    def digests(self) -> Iterator[str]:
        """``a1,a2|b1;a3|b2`` of every unit."""
        get = self._text.__getitem__
        for i, j in zip(np.r_[0, self._cut[:-1]], self._cut):
            yield "".join(map(get, self._codes[i:j].tolist()))


class _Packer:
    """Units gathered until they hold ``PACK`` links."""

    def __init__(self, id_type, space: int):
        self.schema = pa.schema([
            ("pack", pa.int64()), ("ids", pa.list_(id_type)), ("keys", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64())),
            *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")], ("digests", pa.list_(pa.binary())),
            ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()), ("links", pa.binary())])
        self.next = (space << 62) + (TaskContext.get().partitionId() << 32)
        self._empty()

    def _empty(self):
        self.rows = {c: [] for c in ("ids", "keys", "orders", "n_a", "n_b", "n_groups", "n_links", "digests")}
        self.links, self.held = [], 0

    def add(self, links: np.ndarray, **columns):
        for k, v in columns.items():
            self.rows[k] += v
        self.links.append(links)
        self.held += len(links)
        if self.held >= PACK:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        links = np.concatenate([*self.links, np.zeros(0, np.int64)])
        pairs, where, times = np.unique(links, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")       # small numbers for frequent pairs
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        out = {"pack": [self.next], **{k: [v] for k, v in self.rows.items()}, "n_pairs": [len(pairs)],
               "pairs": [_z(pairs[order])], "times": [_z(times[order].astype(np.int64))], "links": [_z(rank[where])]}
        self.next += 1
        self._empty()
        return pa.RecordBatch.from_pydict(out, self.schema)

    def rest(self):
        if self.rows["n_a"]:
            yield self.flush()


def _pack_shape(id_type: str) -> str:
    longs = ", ".join(f"{c} array<long>" for c in ("keys", "orders", "n_a", "n_b", "n_groups", "n_links"))
    return f"pack long, ids array<{id_type}>, {longs}, digests array<binary>, n_pairs long, pairs binary, times binary, links binary"


def _short_texts(rows: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Packs of texts that are one fragment (id, text)."""
    arrow_id = to_arrow_type(rows.schema["id"].dataType)

    def run(batches):
        both, packer = _tokenizers(files), _Packer(arrow_id, 0)

        def group(ids, texts):
            filled = [t for t in texts if t]
            a, b, fine = both.encode(filled) if filled else ([], [], np.zeros(0, bool))
            keep = np.flatnonzero(fine)
            a_ids, b_ids = (np.concatenate([*(x[i] for i in keep), np.zeros(0, np.int64)]) for x in (a, b))
            sizes = np.array([len(filled[i]) for i in keep], np.int64)
            found = Aligned(both, a_ids, np.cumsum(both.a.table.size[a_ids]), b_ids, np.cumsum(both.b.table.size[b_ids]), np.cumsum(sizes))
            counted = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            where = np.flatnonzero([bool(t) for t in texts])[keep]
            for c, v in counted.items():
                v[where] = getattr(found, c)
            digests = [b""] * len(texts)
            for i, d in zip(where.tolist(), found.digests()):
                digests[i] = hashlib.sha256(d.encode()).digest()
            yield from packer.add(found.links, ids=ids, keys=[None] * len(ids), orders=[0] * len(ids), digests=digests,
                                  **{c: v.tolist() for c, v in counted.items()})

        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                t = t.as_py()
                ids.append(i.as_py())
                texts.append(b" " + t if t else b"")
                held += len(texts[-1])
                if held >= GROUP:
                    yield from group(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield from group(ids, texts)
        yield from packer.rest()

    return rows.mapInArrow(run, _pack_shape(rows.schema["id"].dataType.simpleString()))


# ------------------------------------------------------------- long documents
def safe_cut(data: bytes, at: int, step: int) -> int:
    """Nearest place from ``at`` (forwards or backwards) where neither
    tokenizer joins the sides: a blank behind a character that is none."""
    while 0 < at < len(data):
        at = data.find(b" ", at) if step > 0 else data.rfind(b" ", 0, at + 1)
        if at <= 0:
            break
        before = data[max(0, at - 4):at].decode("utf-8", "ignore")[-1:]
        if before and not before.isspace():
            return at
        at += step
    return len(data) if step > 0 else 0


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """(id, key, k, n, lo, hi, start, data): byte ranges (lo, hi] of long texts
    with the bytes around them that their tokens need."""
    id_type = rows.schema["id"].dataType.simpleString()
    arrow_id = to_arrow_type(rows.schema["id"].dataType)
    schema = pa.schema([("id", arrow_id), *[(c, pa.int64()) for c in ("key", "k", "n", "lo", "hi", "start")], ("data", pa.binary())])

    def run(batches):
        key = TaskContext.get().partitionId() << 32
        for b in batches:
            for id, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                data = b" " + text.as_py()
                n = -(-len(data) // chunk)
                for k in range(n):
                    lo, hi = k * chunk, min(len(data), (k + 1) * chunk)
                    start, end = safe_cut(data, lo, -1), safe_cut(data, hi, 1)
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array([id.as_py()], arrow_id), "key": [key], "k": [k], "n": [n], "lo": [lo], "hi": [hi],
                        "start": [start], "data": [data[start:end]]}, schema)
                key += 1

    return rows.mapInArrow(run, f"id {id_type}, key long, k long, n long, lo long, hi long, start long, data binary")


#: Tokens as (ids, ends) of both tokenizers, little-endian 64-bit numbers.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_PARTS = ("a_ids", "a_ends", "b_ids", "b_ends")


def _clip(run: Run, lo: int, hi: int) -> Run:
    """Tokens that end in (lo, hi]."""
    a, b = (slice(*np.searchsorted(run[i], [lo, hi], "right")) for i in (1, 3))
    return run[0][a], run[1][a], run[2][b], run[3][b]


def _joined(x: Run, y: Run) -> Run:
    return tuple(np.concatenate([p, q]) for p, q in zip(x, y))


def _bytes(run: Run) -> list[bytes]:
    return [x.astype("<i8").tobytes() for x in run]


def _run(parts: list[bytes]) -> Run:
    return tuple(np.frombuffer(p, "<i8").astype(np.int64) for p in parts)


class Fragment:
    """Open prefix, whether any group end follows, open suffix; ``last`` is the
    chunk with the last common end.  Closed groups stay where they are."""

    def __init__(self, prefix: Run, closes: bool, suffix: Run | None, last: int):
        self.prefix, self.closes, self.suffix, self.last = prefix, closes, suffix, last

    @staticmethod
    def of(run: Run, k: int) -> tuple["Fragment", Run | None]:
        """The fragment of chunk ``k`` and its closed groups."""
        common = np.intersect1d(run[1], run[3], assume_unique=True)
        if not len(common):
            return Fragment(run, False, None, -1), None
        top = np.iinfo(np.int64).max
        return (Fragment(_clip(run, -1, common[0]), True, _clip(run, common[-1], top), k),
                _clip(run, common[0], common[-1]))

    def then(self, other: "Fragment") -> tuple["Fragment", tuple[int, Run] | None]:
        """This fragment and the one behind it; the group that closes between
        them and the chunk it follows, if there is one."""
        if not self.closes:
            return Fragment(_joined(self.prefix, other.prefix), other.closes, other.suffix, other.last), None
        middle = _joined(self.suffix, other.prefix)
        if not other.closes:
            return Fragment(self.prefix, True, middle, self.last), None
        return Fragment(self.prefix, True, other.suffix, other.last), (self.last, middle)


_FRAGMENT = ("key long, block long, closes boolean, last long, prefix array<binary>, suffix array<binary>, seam boolean, "
             "middle array<binary>")
_FRAGMENT_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("closes", pa.bool_()), ("last", pa.int64()),
                             ("prefix", pa.list_(pa.binary())), ("suffix", pa.list_(pa.binary())), ("seam", pa.bool_()),
                             ("middle", pa.list_(pa.binary()))])


def _fragment_row(key: int, block: int, f: Fragment) -> dict:
    return {"key": key, "block": block, "closes": f.closes, "last": f.last, "prefix": _bytes(f.prefix),
            "suffix": None if f.suffix is None else _bytes(f.suffix), "seam": False, "middle": None}


def _compose(key, table):
    """Fragments of up to ``FAN`` neighbours as one, and the groups that close
    between them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    out, whole = [], None
    for r in rows:
        f = Fragment(_run(r["prefix"]), r["closes"], r["suffix"] and _run(r["suffix"]), r["last"])
        whole, seam = (f, None) if whole is None else whole.then(f)
        if seam:
            out.append({"key": r["key"], "last": seam[0], "seam": True, "middle": _bytes(seam[1])})
    out.append(_fragment_row(rows[0]["key"], rows[0]["block"] // FAN, whole))
    return pa.Table.from_pylist(out, _FRAGMENT_ARROW)


def _units_of_chunks(chunks: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Per chunk its fragment, closed groups and whether its bytes came back."""
    def run(batches):
        both = _tokenizers(files)
        for b in batches:
            for r in b.to_pylist():
                a, c, fine = both.encode([r["data"]])
                ends = [r["start"] + np.cumsum(t.table.size[x[0]]) for t, x in ((both.a, a), (both.b, c))]
                f, closed = Fragment.of(_clip((a[0], ends[0], c[0], ends[1]), r["lo"], r["hi"]), r["k"])
                row = _fragment_row(r["key"], r["k"], f) | {"middle": closed and _bytes(closed), "fine": bool(fine[0])}
                yield pa.RecordBatch.from_pylist([row], _FRAGMENT_ARROW.append(pa.field("fine", pa.bool_())))

    return chunks.mapInArrow(run, _FRAGMENT + ", fine boolean")


def _long_texts(rows: DataFrame, files: tuple[str, str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """(packs of the units of long texts; their keys: id, key, fine)."""
    chunks = written(_chunks(rows, chunk), "alignment-chunks")
    pieces = written(_units_of_chunks(chunks.repartition("key", "k"), files), "alignment-fragments")
    keys = chunks.filter("k = 0").select("id", "key", "n").join(
        pieces.groupBy("key").agg(F.bool_and("fine").alias("fine")), "key")
    keys = written(keys, "alignment-keys")
    fine = keys.filter("fine").select("key")
    pieces = pieces.join(fine, "key", "left_semi")
    most = keys.agg(F.max("n")).first()[0] or 0
    plain = [c for c in pieces.columns if c not in ("fine", "middle")]
    level = pieces.select(*plain).withColumn("middle", F.lit(None).cast("array<binary>"))
    seams = []
    while True:
        level = written(level.groupBy("key", F.expr(f"block div {FAN}").alias("next")).applyInArrow(_compose, _FRAGMENT),
                        "alignment-composed")
        seams.append(level.filter("seam").select("key", (2 * F.col("last") + 1).alias("order"), "middle"))
        level = level.filter("not seam")
        most = -(-most // FAN)
        if most <= 1:
            break
    # the first prefix begins with the text, so it is a whole group; the last suffix is empty
    units = pieces.filter("middle is not null").select("key", (2 * F.col("block")).alias("order"), "middle")
    units = units.unionByName(level.select("key", F.lit(-1).cast("long").alias("order"), F.col("prefix").alias("middle")))
    for s in seams:
        units = units.unionByName(s)
    id_type = rows.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        both, packer = _tokenizers(files), _Packer(arrow_id, 1)
        for b in batches:
            for r in b.to_pylist():
                a_ids, a_ends, b_ids, b_ends = _run(r["middle"])
                if not len(a_ids):
                    continue
                first = a_ends[0] - both.a.table.size[a_ids[0]]
                found = Aligned(both, a_ids, a_ends - first, b_ids, b_ends - first, a_ends[-1:] - first)
                yield from packer.add(found.links, ids=[None], keys=[r["key"]], orders=[r["order"]],
                                      digests=[next(found.digests()).encode()],
                                      **{c: getattr(found, c).tolist() for c in ("n_a", "n_b", "n_groups", "n_links")})
        yield from packer.rest()

    return units.mapInArrow(run, _pack_shape(id_type.simpleString())), keys


# ------------------------------------------------------------------ the whole
def pair_totals(packs: DataFrame, n_second: int) -> tuple[DataFrame, DataFrame]:
    """(pack, at, pair) of the packs' distinct pairs and (pair, total, best):
    links of each pair in the corpus, and whether no other pair of its second
    id has more.  ``pair`` is first id times ``n_second`` plus second id."""
    def flat(batches):
        for b in batches:
            for r in b.to_pylist():
                n = r["n_pairs"]
                pairs, times = _unz(r["pairs"], n, np.int64), _unz(r["times"], n, np.int64)
                for i in range(0, n, 65536):
                    m = len(pairs[i:i + 65536])
                    yield pa.RecordBatch.from_pydict({
                        "pack": np.full(m, r["pack"], np.int64), "at": np.arange(i, i + m, dtype=np.int32),
                        "pair": pairs[i:i + m], "times": times[i:i + m]})

    pairs = packs.select("pack", "n_pairs", "pairs", "times").mapInArrow(flat, "pack long, at int, pair long, times long")
    totals = written(pairs.groupBy("pair").agg(F.sum("times").alias("total")), "alignment-totals")
    second = F.pmod("pair", F.lit(n_second))
    most = totals.groupBy(second.alias("second")).agg(F.max("total").alias("most"))
    judged = totals.withColumn("second", second).join(most, "second").select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    return pairs.select("pack", "at", "pair"), judged


def _answered(packs: DataFrame, pairs: DataFrame, judged: DataFrame, id_type) -> DataFrame:
    """One row a unit with the sums over its links."""
    arrow_id = to_arrow_type(id_type)
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def finish(key, left, right):
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("at").to_numpy()
        total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy()
        r = left.to_pylist()[0]
        n = np.array(r["n_links"], np.int64)
        links = _unz(r["links"], int(n.sum()), np.uint32)
        ends = np.cumsum(n)
        sums = [np.r_[0, np.cumsum(x[links].astype(np.int64))] for x in (best, total)]
        out = [pa.array(r["ids"], arrow_id), pa.array(r["keys"], pa.int64()), pa.array(r["orders"], pa.int64()),
               *[pa.array(r[c], pa.int64()) for c in counts], *[pa.array(s[ends] - s[ends - n]) for s in sums],
               pa.array(r["digests"], pa.binary())]
        return pa.Table.from_arrays(out, ["id", "key", "order", *counts, "n_best", "count_sum", "digest"])

    longs = ", ".join(f"{c} long" for c in ("key", "`order`", *counts, "n_best", "count_sum"))
    answers = pairs.join(judged, "pair").select("pack", "at", "total", "best")
    return packs.select("pack", "ids", "keys", "orders", *counts, "digests", "links").groupBy("pack").cogroup(
        answers.groupBy("pack")).applyInArrow(finish, f"id {id_type.simpleString()}, {longs}, digest binary")


def _long_digests(units: DataFrame) -> DataFrame:
    """(key, groups_sha256): the units' texts in order, hashed as a stream."""
    def run(batches):
        key, sha, keys, done = None, None, [], []
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if sha is not None:
                        keys.append(key)
                        done.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(text)
                else:
                    sha.update(b";" + text)
        if sha is not None:
            keys.append(key)
            done.append(sha.hexdigest())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "groups_sha256": pa.array(done, pa.string())})

    return units.select("key", "order", "digest").repartition("key").sortWithinPartitions("key", "order").mapInArrow(
        run, "key long, groups_sha256 string")


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None,
          chunk: int = CHUNK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per
    row; ``first``, ``second``: files of a byte-level and a piece vocabulary."""
    files = (first or tokenizer_file(FIRST), second or tokenizer_file(SECOND))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    is_long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    long_packs, keys = _long_texts(rows.filter(is_long), files, chunk)
    packs = written(_short_texts(rows.filter(~is_long), files).unionByName(long_packs), "alignment-packs")
    pairs, judged = pair_totals(packs, Pieces(files[1]).model.get_piece_size())
    units = written(_answered(packs, pairs, judged, id_type), "alignment-units")
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    short = units.filter("key is null").select("id", *sums, F.lower(F.hex("digest")).alias("groups_sha256"))
    of_long = units.filter("key is not null")
    total = of_long.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])
    long = keys.join(total, "key", "left").join(_long_digests(of_long), "key", "left").select(
        "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return written(short.unionByName(long), "alignment").withColumnRenamed("id", id)
