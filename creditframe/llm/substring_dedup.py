"""Exact substring deduplication across documents, by sharded suffix arrays.

Every byte covered by a ``SPAN``-byte string that also starts earlier is
removed.  A single suffix array of the corpus would need one machine, so the
windows (strings of ``SPAN`` bytes) are first brought together by content:

* the *anchor* of a window is its ``GRAM``-byte substring of the smallest
  hash (the first of equals), so equal windows have equal anchors at equal
  places; neighbouring windows with one anchor form a *context*;
* packs of documents ask anchor shards which of their anchors occur in other
  packs too; only those, and anchors with several contexts in the pack, go on;
* the contexts of an anchor meet in its shard, equal ones of a pack and then
  of all packs collapsed to the earliest.  The suffix arrays of the contexts
  of every anchor, made by linear grouping (``suffix_groups``), bring equal
  windows side by side; the earliest of a run stays, the others are reported
  as ranges of their document;
* packs tell the shards how many different contexts an anchor has.  Those of
  a *hot* anchor (more than ``HOT``, as of a line that many documents share)
  never meet in one task: they are written as a table of units, which is halved by
  the place of the anchor in the window; the halves go on under the hash of the bytes
  that all such windows share, which is another shard for each text around the
  anchor.  What is still hot is halved again until a unit is one window (``ROUNDS``
  at most).  Equal units of a pack collapse each time, so units of one window are one
  row a pack.  Without hot anchors there is no such table;
* what one task holds of an anchor is halved in the same way in memory where
  it is too much for one string.

Ranges return to the packs, which cut the texts.

Order is that of (id, start); rows that share an id are ordered by their place
in a pack, packs by a hash of their ids and texts.  Ids are integers.
Edge cases: null text is empty; texts below ``SPAN`` bytes keep everything;
null ids come first; of equal rows one keeps its text; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_worker, written
from .lm import _mix, _unz, _z
from .suffix_groups import _edges, _ranges, suffix_arrays

SPAN = 100
GRAM = 40
PACK = 8 << 20
#: Texts are hashed in stretches of about this many bytes.
STRETCH = 1 << 20
#: Contexts of one anchor beyond this many bytes are halved.
STRING = 4096
#: Symbols of strings that are sorted side by side.
BATCH = 2 << 20
SHARD_BYTES = 48 << 20
#: Different contexts of one anchor, summed over packs, beyond which they are halved before they are sent.
HOT = 200_000
#: Halvings after which a unit is one window.
ROUNDS = (SPAN - GRAM).bit_length()

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.ones(n, _U)
        done = 1
        while done < n:
            more = min(done, n - done)
            p[done:done + more] = p[:more] * _U(pow(b, done, 1 << 64))
            done += more
        out.append(p)
    return out[0], out[1]


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, windows, anchor place, hash of the bytes) of every
    context of the documents ``data[starts:ends]``; places are positions in ``data``."""
    parts = []
    for a, b, docs in _stretches(starts, ends):
        piece = data[a:b]
        n = len(piece)
        power, inverse = per_worker(("powers", STRETCH + SPAN), lambda: _powers(STRETCH + SPAN)) \
            if n <= STRETCH + SPAN else _powers(n)
        total = np.zeros(n + 1, _U)
        np.cumsum((piece.astype(_U) + _U(1)) * power[:n], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * inverse[:n - GRAM + 1]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        places = _U((1 << 24) - 1)
        least = (h & ~places) | np.arange(len(h), dtype=_U)
        wide, span = SPAN - GRAM + 1, 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[:-(wide - span)], least[wide - span:])
        # windows that lie within one document
        window = _ranges(docs[:, 0] - a, docs[:, 1] - docs[:, 0] - SPAN + 1)
        owner = np.repeat(np.arange(len(docs)), docs[:, 1] - docs[:, 0] - SPAN + 1)
        anchor = (least[window] & places).astype(np.int64)
        e = _edges(anchor, owner)
        first = window[e]
        windows = np.diff(np.append(e, len(window)))
        held = (total[first + windows + SPAN - 1] - total[first]) * inverse[first]
        parts.append((h[anchor[e]], first + a, windows, anchor[e] + a, held))
    if not parts:
        return np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _stretches(starts, ends):
    """(from, to, documents as rows of start and end): long documents are cut
    into stretches that overlap by a window less one byte."""
    rows = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        while e - s > STRETCH:
            rows.append((s, s + STRETCH))
            s += STRETCH - SPAN + 1
        if e - s >= SPAN:
            rows.append((s, e))
    held = []
    for r in rows:
        if held and r[1] - held[0][0] > STRETCH:
            yield held[0][0], held[-1][1], np.array(held)
            held = []
        held.append(r)
    if held:
        yield held[0][0], held[-1][1], np.array(held)


def earliest(strings: list[bytes], windows: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every window of every context: the lowest number of a context of
    its group that holds an equal window.  ``strings`` are distinct within a
    group and numbered in order of their first occurrence; ``place`` is where
    the anchor stands in the string; ``group`` is sorted."""
    at = np.cumsum(windows) - windows
    out = np.repeat(np.arange(len(strings)), windows)
    # (strings, windows, targets): targets are lists of (number, first window in out)
    todo = []
    e = _edges(group) if len(group) else np.zeros(0, np.int64)
    for i, j in zip(e.tolist(), np.append(e[1:], len(group)).tolist()):
        if j - i > 1:
            todo.append([(strings[k], int(windows[k]), int(place[k]), [(k, int(at[k]))]) for k in range(i, j)])
    small, symbols = [], 0
    while todo:
        units = todo.pop()
        if len(units) == 1 or sum(len(u[0]) + 1 for u in units) <= STRING:
            if len(units) > 1 or len(units[0][3]) > 1:
                small.append(units)
                symbols += sum(len(u[0]) + 1 for u in units) + 1
        else:
            todo += _halves(units)
        if symbols >= BATCH or not todo and small:
            _settle(small, out)
            small, symbols = [], 0
    return out


def _halves(units):
    """The windows of ``units`` with the anchor far from their start, and the
    others, each regrouped by the bytes that all of them share."""
    # the place of the anchor within window w of a unit is place - w
    low = min(p - n + 1 for _, n, p, _ in units)
    high = max(p for _, _, p, _ in units)
    out = []
    middle = (low + high) // 2 + 1
    for a, b in ((low, middle - 1), (middle, high)):
        cores: dict[bytes, dict[bytes, tuple]] = {}
        for s, n, p, targets in units:
            # windows w with a <= p - w <= b
            w0, w1 = max(0, p - b), min(n - 1, p - a)
            if w0 > w1:
                continue
            part = s[w0:w1 + SPAN]
            # all windows of the half hold these bytes
            core = s[p - a:p - b + SPAN]
            mine = cores.setdefault(core, {})
            known = mine.get((part, p - w0))
            moved = [(k, t + w0) for k, t in targets]
            if known:
                known[3].extend(moved)
            else:
                mine[(part, p - w0)] = (part, w1 - w0 + 1, p - w0, moved)
        for mine in cores.values():
            out.append(list(mine.values()))
    return out


def _settle(groups, out: np.ndarray) -> None:
    """Suffix arrays of the groups' strings; writes the earliest owners."""
    units = [u for g in groups for u in g]
    # a group is one string: its contexts, each ended by 1, and a last 0
    text = b"".join(u[0] for u in units)
    size = np.array([len(u[0]) for u in units])
    n_units = np.array([len(g) for g in groups])
    last = np.cumsum(n_units) - 1
    step = size + 1
    step[last] += 1
    begin = np.cumsum(step) - step
    symbols = np.ones(int(step.sum()), np.int64)
    inside = _ranges(begin, size)
    symbols[inside] = np.frombuffer(text, np.uint8).astype(np.int64) + 2
    end = begin + step
    symbols[end[last] - 1] = 0
    first = begin[last - n_units + 1]
    order = suffix_arrays(symbols, first, end[last] - first)
    windows = np.array([u[1] for u in units])
    unit_of = np.full(len(symbols), -1, np.int64)
    unit_of[_ranges(begin, windows)] = np.repeat(np.arange(len(units)), windows)
    order = order[unit_of[order] >= 0]          # window starts, in suffix order
    offsets = np.arange(SPAN)
    same = np.zeros(len(order), bool)
    narrow = symbols.astype(np.uint16)
    for i in range(1, len(order), 1 << 15):
        a, b = order[i - 1:i - 1 + (1 << 15)], order[i:i + (1 << 15)]
        a = a[:len(b)]
        same[i:i + len(b)] = (narrow[a[:, None] + offsets] == narrow[b[:, None] + offsets]).all(axis=1)
    run = np.cumsum(~same) - 1
    number = np.array([min(k for k, _ in u[3]) for u in units])
    low = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, run, number[unit_of[order]])
    owner = np.empty(len(symbols), np.int64)
    owner[order] = low[run]
    for u, b in zip(units, begin.tolist()):
        for _, t in u[3]:
            out[t:t + u[1]] = owner[b:b + u[1]]


def _pack_name(ids: list, data: bytes) -> str:
    """Packs sort by what they hold; equal packs stay apart."""
    return hashlib.md5(repr(ids).encode() + data).hexdigest() + uuid.uuid4().hex


def _pack_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            size = np.cumsum([len(t or b"") for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(size // PACK)) + 1), len(texts)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    data = b"".join(t or b"" for t in texts[i:j])
                    yield pa.RecordBatch.from_pydict({
                        "pack": [_pack_name(ids[i:j], data)], "ids": pa.array([ids[i:j]], pa.list_(pa.int64())),
                        "sizes": pa.array([[len(t or b"") for t in texts[i:j]]], pa.list_(pa.int64())),
                        "n": pa.array([len(data)], pa.int64()),
                        "data": [pa.compress(data, "zstd", asbytes=True)]})

    return rows.mapInArrow(run, "pack string, ids array<long>, sizes array<long>, n long, data binary")


def _open(r: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = pa.decompress(r["data"], r["n"], "zstd", asbytes=True) if r["n"] else b""
    ends = np.cumsum(np.array(r["sizes"], np.int64))
    return data, ends - np.array(r["sizes"], np.int64), ends


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(anchor) % _U(shards)).astype(np.int64)


def _dealt(keys: np.ndarray, shards: int) -> dict[int, np.ndarray]:
    """Sorted distinct keys by shard."""
    to = _shard(keys, shards)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(shards + 1))
    return {s: keys[order[edges[s]:edges[s + 1]]] for s in range(shards) if edges[s] < edges[s + 1]}


def _replies(packed: DataFrame, shards: int, hot: int) -> DataFrame:
    """(pack, shard, n, hits, hot, n_hot): of the pack's distinct anchors in the
    shard, in order, which occur in another pack, and which are hot."""
    asks = pa.schema([("shard", pa.int32()), ("pack", pa.string()), ("n", pa.int64()), ("anchors", pa.binary()),
                      ("times", pa.binary())])

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                data, starts, ends = _open(r)
                anchor, _, _, _, held = contexts(np.frombuffer(data, np.uint8), starts, ends)
                by = np.lexsort((held, anchor))
                anchor = anchor[by][_edges(anchor[by], held[by])] if len(by) else anchor
                anchors, times = np.unique(anchor, return_counts=True)
                for s, mine in _dealt(anchors, shards).items():
                    yield pa.RecordBatch.from_pylist([{
                        "shard": s, "pack": r["pack"], "n": len(mine), "anchors": _z(np.diff(mine, prepend=_U(0))),
                        "times": _z(times[np.searchsorted(anchors, mine)].astype(np.uint32))}], asks)

    def answer(key, table):
        rows = table.to_pylist()
        each = [np.cumsum(_unz(r["anchors"], r["n"], _U)) for r in rows]
        times = np.concatenate([_unz(r["times"], r["n"], np.uint32) for r in rows])
        _, where, packs = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(x) for x in each])[:-1]
        many = np.split((np.bincount(where, times) > hot)[where], cuts)
        return pa.Table.from_pydict({
            "pack": [r["pack"] for r in rows], "shard": pa.array([r["shard"] for r in rows], pa.int32()),
            "n": pa.array([r["n"] for r in rows], pa.int64()),
            "hits": [np.packbits(h).tobytes() for h in np.split(packs[where] > 1, cuts)],
            "hot": [np.packbits(h).tobytes() for h in many], "n_hot": pa.array([int(h.sum()) for h in many], pa.int64())})

    asked = packed.select("pack", "sizes", "n", "data").mapInArrow(
        ask, "shard int, pack string, n long, anchors binary, times binary")
    return asked.groupBy("shard").applyInArrow(answer, "pack string, shard int, n long, hits binary, hot binary, n_hot long")


def _collapsed(r: dict, replies: list[dict], shards: int):
    """The contexts of a pack that others may share, in order of (anchor, id, place):
    (anchor, start in the document, windows, anchor place in the context,
    document, id, hot, sent, again, texts of sent): ``sent`` numbers the earliest of equal
    ones, ``again`` the others."""
    data, starts, ends = _open(r)
    anchor, first, windows, place, _ = contexts(np.frombuffer(data, np.uint8), starts, ends)
    distinct = np.unique(anchor)
    dealt = _dealt(distinct, shards)
    wanted, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for a in replies:
        at = np.searchsorted(distinct, dealt[a["shard"]])
        for flags, name in ((wanted, "hits"), (hot, "hot")):
            flags[at] = np.unpackbits(np.frombuffer(a[name], np.uint8))[:a["n"]] == 1
    where = np.searchsorted(distinct, anchor)
    # an anchor seen twice in the pack needs its contexts as well
    wanted |= np.bincount(where, minlength=len(distinct)) > 1
    keep = np.flatnonzero(wanted[where])
    doc = np.searchsorted(ends, first[keep], side="right")
    ids = np.array([np.iinfo(np.int64).min if i is None else i for i in r["ids"]], np.int64)
    # equal contexts of the pack meet; the earliest goes on
    by = keep[np.lexsort((place[keep], doc, ids[doc], anchor[keep]))]
    first, windows, place, anchor, hot = first[by], windows[by], place[by], anchor[by], hot[where[by]]
    doc = np.searchsorted(ends, first, side="right")
    view = memoryview(data)
    known: dict[tuple, int] = {}
    sent, again, texts = [], [], []
    for i, (h, f, n) in enumerate(zip(anchor.tolist(), first.tolist(), (windows + SPAN - 1).tolist())):
        t = bytes(view[f:f + n])
        if known.setdefault((h, t), i) == i:
            sent.append(i)
            texts.append(t)
        else:
            again.append(i)
    start = first - starts[doc]
    return (anchor, start, windows, place - first, doc, ids[doc], hot,
            np.array(sent, np.int64), np.array(again, np.int64), texts)


_UNIT = ("key long, low int, high int, pack string, id long, doc long, start long, windows int, place int, text binary")


def _hot_units(packed: DataFrame, replies: DataFrame, shards: int) -> DataFrame:
    """(``_UNIT``) the contexts of hot anchors, one row each."""
    shape = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("pack", pa.string()),
                       ("id", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
                       ("place", pa.int32()), ("text", pa.binary())])

    def run(key, left, right):
        r = left.to_pylist()[0]
        anchor, start, windows, place, doc, ids, hot, sent, _, texts = _collapsed(r, right.to_pylist(), shards)
        mine = np.flatnonzero(hot[sent])
        x = sent[mine]
        return pa.Table.from_pydict({
            "key": anchor[x].view(np.int64), "low": np.zeros(len(x), np.int32), "high": np.full(len(x), SPAN - GRAM, np.int32),
            "pack": [r["pack"]] * len(x), "id": ids[x], "doc": doc[x], "start": start[x], "windows": windows[x].astype(np.int32),
            "place": place[x].astype(np.int32), "text": [texts[k] for k in mine.tolist()]}, shape)

    # a pack with a hot anchor takes all its replies along
    some = replies.where("n_hot > 0").select("pack").distinct()
    return packed.join(some, "pack", "left_semi").groupBy("pack").cogroup(
        replies.join(some, "pack", "left_semi").groupBy("pack")).applyInArrow(run, _UNIT)


def _halved(units: DataFrame) -> DataFrame:
    """Both halves of every unit, by the place of the anchor in the window."""
    names = [f.split()[0] for f in _UNIT.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for u in b.to_pylist():
                middle, place = (u["low"] + u["high"]) // 2, u["place"]
                for low, high in ((u["low"], middle), (middle + 1, u["high"])):
                    # the windows w with low <= place - w <= high
                    w0, w1 = max(0, place - high), min(u["windows"] - 1, place - low)
                    if low <= high and w0 <= w1:
                        # all windows of such places hold these bytes
                        core = xxhash.xxh64_intdigest(u["text"][place - low:place - high + SPAN], low * SPAN + high)
                        out.append(u | {"key": core - (1 << 64) * (core >> 63), "low": low, "high": high, "place": place - w0,
                                        "start": u["start"] + w0, "windows": w1 - w0 + 1, "text": u["text"][w0:w1 + SPAN]})
            yield pa.RecordBatch.from_pylist(out, b.schema)

    return units.select(*names).mapInArrow(run, _UNIT)


def _spread(units: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(units, repeats): halves until no key has more than ``hot`` units or a unit
    is one window; of equal units of a pack the earliest stays, the others are
    repeats.  Keys that are hot are at most one in ``hot`` units."""
    settled, repeats = [], []
    for _ in range(ROUNDS):
        keys = written(units.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"),
                       "substring-hot")
        if keys.isEmpty():
            break
        settled.append(units.join(keys, "key", "left_anti"))
        same = Window.partitionBy("key", "pack", "text").orderBy("id", "doc", "start")
        halves = written(_halved(units.join(keys, "key", "left_semi")).withColumn("nth", F.row_number().over(same)),
                         "substring-halves")
        repeats.append(halves.where("nth > 1").drop("nth"))
        units = halves.where("nth = 1").drop("nth")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union([*settled, units]), union(repeats) if repeats else units.limit(0)


_PARTS = ("anchor", "size", "text", "place", "id", "doc", "start")


def ranges(packed: DataFrame, shards: int, hot: int = HOT) -> DataFrame:
    """(pack, n, doc, start, windows): windows that also start earlier."""
    replies = written(_replies(packed, shards, hot), "substring-anchors")
    packed = packed.select("pack", "ids", "sizes", "n", "data")
    asks = pa.schema([("pack", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("repeat", pa.bool_()),
                      *[(p, pa.binary()) for p in _PARTS]])

    def repeated(pack, doc, start, windows):
        shard = int(_mix(np.array([int(pack[:15], 16)]))[0] % _U(shards))
        return {"pack": pack, "shard": shard, "n": len(doc), "repeat": True, "doc": _z(doc.astype(np.uint32)),
                "start": _z(start.astype(np.uint32)), "size": _z(windows.astype(np.uint32))}

    def sent_to(pack, shard, key, windows, texts, place, ids, doc, start):
        return {"pack": pack, "shard": shard, "n": len(key), "repeat": False, "anchor": _z(np.diff(key, prepend=_U(0))),
                "size": _z(windows.astype(np.uint32)), "text": pa.compress(b"".join(texts), "zstd", asbytes=True),
                "place": _z(place.astype(np.uint32)), "id": _z(ids), "doc": _z(doc.astype(np.uint32)),
                "start": _z(start.astype(np.uint32))}

    def ask(key, left, right):
        r = left.to_pylist()[0]
        anchor, start, windows, place, doc, ids, is_hot, sent, again, texts = _collapsed(r, right.to_pylist(), shards)
        out = [repeated(r["pack"], doc[again], start[again], windows[again])] if len(again) else []
        cold = np.flatnonzero(~is_hot[sent])
        to = _shard(anchor[sent[cold]], shards)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(shards + 1))
        for s in range(shards):
            y = cold[order[edges[s]:edges[s + 1]]]
            if len(y):
                z = sent[y]
                out.append(sent_to(r["pack"], s, anchor[z], windows[z], [texts[k] for k in y.tolist()], place[z], ids[z],
                                   doc[z], start[z]))
        return pa.Table.from_pylist(out, asks)

    def bundle(batches, again):
        for b in batches:
            rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "doc", "start", "windows", "place")}
            keys, packs, texts = rows["key"].view(_U), b.column("pack").to_pylist(), b.column("text").to_pylist()
            groups: dict[tuple, list] = {}
            for i, k in enumerate(zip(packs, [0] * len(packs) if again else _shard(keys, shards).tolist())):
                groups.setdefault(k, []).append(i)
            out = []
            for (pack, s), i in groups.items():
                id, doc, start, windows, place = (rows[c][i] for c in ("id", "doc", "start", "windows", "place"))
                out.append(repeated(pack, doc, start, windows) if again else sent_to(
                    pack, s, keys[i], windows, [texts[k] for k in i], place, id, doc, start))
            yield pa.RecordBatch.from_pylist(out, asks)

    shape = f"pack string, shard int, n long, repeat boolean, {', '.join(p + ' binary' for p in _PARTS)}"
    asked = packed.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(ask, shape)
    if not replies.where("n_hot > 0").isEmpty():
        units, repeats = _spread(written(_hot_units(packed, replies, shards), "substring-units"), hot)
        asked = asked.unionByName(units.mapInArrow(lambda batches: bundle(batches, False), shape)).unionByName(
            repeats.mapInArrow(lambda batches: bundle(batches, True), shape))
    answers = pa.schema([("pack", pa.string()), ("n", pa.int64()), ("doc", pa.binary()), ("start", pa.binary()),
                         ("windows", pa.binary())])

    def answer(key, table):
        rows = table.to_pylist()
        out = [{"pack": r["pack"], "n": r["n"], "doc": r["doc"], "start": r["start"], "windows": r["size"]}
               for r in rows if r["repeat"]]
        rows = sorted((r for r in rows if not r["repeat"]), key=lambda r: r["pack"])
        if rows:
            anchor = np.concatenate([np.cumsum(_unz(r["anchor"], r["n"], _U)) for r in rows])
            cols = {p: np.concatenate([_unz(r[p], r["n"], np.int64 if p == "id" else np.uint32).astype(np.int64)
                                       for r in rows]) for p in ("size", "place", "id", "doc", "start")}
            size, place = cols["size"], cols["place"]
            length = size + SPAN - 1
            parts = np.split(length, np.cumsum([r["n"] for r in rows])[:-1])
            data = b"".join(pa.decompress(r["text"], int(x.sum()), "zstd", asbytes=True) for r, x in zip(rows, parts))
            ends = np.cumsum(length)
            text = pa.Array.from_buffers(pa.large_binary(), len(length), [
                None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)])
            code = text.dictionary_encode().indices.to_numpy()
            names = sorted({r["pack"] for r in rows})
            number_of = {p: k for k, p in enumerate(names)}
            pack = np.repeat([number_of[r["pack"]] for r in rows], [r["n"] for r in rows])
            # contexts of an anchor in order of occurrence; equal ones collapse
            by = np.lexsort((cols["start"] + place, cols["doc"], pack, cols["id"], anchor))
            same = np.lexsort((np.arange(len(by)), code[by], anchor[by]))
            e = _edges(anchor[by][same], code[by][same])
            lead = np.empty(len(by), np.int64)
            lead[same] = np.repeat(same[e], np.diff(np.append(e, len(same))))
            is_lead = lead == np.arange(len(by))
            distinct = by[is_lead]
            number = np.cumsum(is_lead) - 1
            strings = text.take(pa.array(distinct)).to_pylist()
            owner = earliest(strings, size[distinct], place[distinct], anchor[distinct])
            at = np.cumsum(size[distinct]) - size[distinct]
            # of each row, the windows whose owner is not the row itself
            mine = number[lead]
            n_windows = size[by]
            flat = _ranges(at[mine], n_windows)
            row = np.repeat(np.arange(len(by)), n_windows)
            seen = (owner[flat] != mine[row]) | ~is_lead[row]
            w = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            w, row = w[seen], row[seen]
            if len(row):
                # neighbouring windows make one range
                new = np.ones(len(row), bool)
                new[1:] = (np.diff(row) != 0) | (np.diff(w) != 1)
                e = np.flatnonzero(new)
                n = np.diff(np.append(e, len(row)))
                src = by[row[e]]
                to = pack[src]
                o = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[o], np.arange(len(names) + 1))
                doc, start = cols["doc"][src], cols["start"][src] + w[e]
                for k, name in enumerate(names):
                    y = o[edges[k]:edges[k + 1]]
                    if len(y):
                        out.append({"pack": name, "n": len(y), "doc": _z(doc[y].astype(np.uint32)),
                                    "start": _z(start[y].astype(np.uint32)), "windows": _z(n[y].astype(np.uint32))})
        return pa.Table.from_pylist(out, answers)

    return asked.groupBy("shard").applyInArrow(answer, "pack string, n long, doc binary, start binary, windows binary")


def dedupe(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int | None = None,
           with_text: bool = True, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) per row.
    ``hot``: contexts of one anchor beyond which they are halved before they are sent."""
    spark = docs.sparkSession
    packed = written(_pack_rows(docs, id, text), "substring-packs")
    if shards is None:
        total = packed.agg(F.sum("n")).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / SHARD_BYTES))
    found = written(ranges(packed, shards, hot), "substring-ranges")

    def cut(key, left, right):
        r = left.to_pylist()[0]
        data, starts, ends = _open(r)
        rows = right.to_pylist()
        doc, start, windows = (np.concatenate([_unz(x[p], x["n"], np.uint32).astype(np.int64) for x in rows])
                               if rows else np.zeros(0, np.int64) for p in ("doc", "start", "windows"))
        # places with a gap after each document, so runs end with it
        gap = starts + np.arange(len(starts))
        a = gap[doc] + start
        by = np.argsort(a, kind="stable")
        a, b = a[by], (a + windows + SPAN - 1)[by]
        runs = []
        if len(a):
            reach = np.maximum.accumulate(b)
            e = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
            runs = list(zip(doc[by][e].tolist(), a[e].tolist(), reach[np.append(e[1:], len(a)) - 1].tolist()))
        spans = {d: [(x - int(gap[d]), y - int(gap[d])) for _, x, y in g] for d, g in groupby(runs, key=lambda x: x[0])}
        out = {k: [] for k in shape.names}
        for d, (i, s, e) in enumerate(zip(r["ids"], starts.tolist(), ends.tolist())):
            t = data[s:e]
            mine = spans.get(d, [])
            kept, at = [], 0
            for x, y in mine:
                kept.append(t[at:x])
                at = y
            kept = b"".join([*kept, t[at:]])
            row = [i, e - s, e - s - len(kept), len(mine), hashlib.sha256(kept).hexdigest()]
            if with_text:
                row += [[{"start": x, "end": y} for x, y in mine], kept]
            for k, v in zip(out, row):
                out[k].append(v)
        return pa.Table.from_pydict(out, shape)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())]
    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields += [("spans", span), ("kept", pa.binary())]
        kinds += ", spans array<struct<start:long,end:long>>, kept binary"
    shape = pa.schema(fields)
    return packed.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(cut, kinds).withColumnRenamed("id", id)
