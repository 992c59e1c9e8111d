"""Language-model scoring with an Elias-Fano n-gram trie, in shards.

The model is a bigram model with Dirichlet smoothing,
``p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU)`` over the add-one unigram
``p(w) = (c(w) + 1) / (N + V + 1)``; texts start after a start mark and end
with an end token.  It learns from the rows that are not held out.

Nothing that grows with the corpus is broadcast or collected.  Rows are packed
(about ``PACK`` tokens a pack); packs and shards talk in two rounds:

1. every pack sends its distinct words with training counts to word shards;
   a shard sums them and answers with the word's number and count;
2. every pack sends its distinct (context, word) pairs with their training
   counts to the shard of the context; a shard sums them, builds its part of
   the trie - contexts, pointers, successors, quantised probabilities - and
   answers every pack with the log probability of each of its pairs, 16 bits
   a pair.  The pack adds them up per document.

A pair crosses the shuffle once per pack, however many documents hold it.
Contexts that hold more than a quarter of a shard (at most 4 a shard, with
their counts the only thing broadcast) are dealt by (context, word) instead.
The number of shards follows the token count.  A pack is cut between texts, so
memory is that of about ``PACK`` tokens or of one longer text.

Edge cases: null and blank texts consist of the end token; a null ``held``
means training; repeated rows are scored and learnt one by one; without
training rows every probability is that of an empty vocabulary; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .elias_fano import Trie, quantise, restore

MU = 200.0
PACK = 1 << 21
SHARD_TOKENS = 2 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Numbers of the two marks; words follow.
END, START, WORDS = 0, 1, 2


def _z(x: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, one byte plane after the other."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else x
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unz(b: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(b, n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _joined(words: list[bytes]) -> tuple[bytes, int]:
    """Compressed text of ``words`` (which hold no blanks) and its size."""
    text = b" ".join(words)
    return pa.compress(text, "zstd", asbytes=True), len(text)


def _words(blob: bytes, size: int) -> list[bytes]:
    return pa.decompress(blob, size, "zstd", asbytes=True).split(b" ") if size else []


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hash of integers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


def packs(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, held) as packs: distinct words and word positions."""
    id_type = rows.schema["id"].dataType.simpleString()

    def pack(batch, texts, ids, held):
        words, sizes = [], []
        for t in texts:
            w = t.translate(_LOWER).split() if t else []
            words += w
            sizes.append(len(w))
        found = pa.array(words, pa.binary()).dictionary_encode()
        order = pa.compute.sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[found.indices.to_numpy()]
        known, size = _joined(found.dictionary.take(pa.array(order)).to_pylist())
        return pa.RecordBatch.from_pydict({
            "pack": [uuid.uuid4().hex], "ids": pa.array([ids], pa.list_(batch.schema.field(0).type)),
            "held": pa.array([held], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "n": pa.array([len(tokens)], pa.int64()), "tokens": [_z(tokens)],
            "n_words": pa.array([len(order)], pa.int64()), "words": [known], "size": pa.array([size], pa.int64())})

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            ids, held = b.column(0).to_pylist(), b.column(2).to_pylist()
            size = np.cumsum([len(t or b"") // 6 + 1 for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(size // PACK)) + 1), len(texts)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    yield pack(b, texts[i:j], ids[i:j], [bool(h) for h in held[i:j]])

    return rows.mapInArrow(run, f"pack string, ids array<{id_type}>, held array<boolean>, sizes array<int>, n long, "
                                "tokens binary, n_words long, words binary, size long")


def _count_words(packed: DataFrame, shards: int) -> DataFrame:
    """Round 1: (pack, shard, k, at, local, counts), what word shards answer;
    and per shard one row without a pack: its known words and tokens."""
    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                tokens = _unz(r["tokens"], r["n"], np.uint32)
                learn = np.repeat(~np.array(r["held"], bool), r["sizes"])
                counts = np.bincount(tokens[learn], minlength=r["n_words"])
                words = _words(r["words"], r["size"])
                to = np.array([hash_of(w) for w in words], np.uint64) % np.uint64(shards)
                words = pa.array(words, pa.binary())
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(shards + 1))
                for s in range(shards):
                    mine = order[edges[s]:edges[s + 1]]
                    if len(mine):
                        blob, size = _joined(words.take(pa.array(mine)).to_pylist())
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([s], pa.int32()), "pack": [r["pack"]], "k": pa.array([len(mine)], pa.int64()),
                            "at": [_z(np.diff(mine, prepend=0).astype(np.uint32))], "counts": [_z(counts[mine].astype(np.uint32))],
                            "words": [blob], "size": pa.array([size], pa.int64())})

    def answer(key, table):
        rows = table.to_pylist()
        found = pa.array([w for r in rows for w in _words(r["words"], r["size"])], pa.binary()).dictionary_encode()
        index = found.indices.to_numpy()
        sizes = [r["k"] for r in rows]
        asked = np.concatenate([_unz(r["counts"], n, np.uint32) for r, n in zip(rows, sizes)]).astype(np.int64)
        total = np.bincount(index, weights=asked).astype(np.int64)
        # the known words are numbered by falling count
        order = np.argsort(-total, kind="stable")
        local = np.empty(len(total), np.int64)
        local[order] = np.arange(len(total))
        known = int((total > 0).sum())
        top = found.dictionary.take(pa.array(order[:min(known, 4 * shards)])).to_pylist()
        out = {"pack": [None], "shard": [rows[0]["shard"]], "k": [known], "at": [b""],
               "local": [np.array([hash_of(w) for w in top], "<u8").tobytes()], "counts": [_z(total[order][:known])]}
        ends = np.cumsum(sizes)
        for r, a, n in zip(rows, ends - sizes, sizes):
            mine = index[a:a + n]
            out["pack"].append(r["pack"])
            out["shard"].append(r["shard"])
            out["k"].append(n)
            out["at"].append(r["at"])
            out["local"].append(_z(local[mine].astype(np.uint32)))
            out["counts"].append(_z(total[mine].astype(np.int64)))
        return pa.Table.from_pydict(out, schema)

    schema = pa.schema([("pack", pa.string()), ("shard", pa.int32()), ("k", pa.int64()), ("at", pa.binary()),
                        ("local", pa.binary()), ("counts", pa.binary())])
    asked = packed.select("pack", "held", "sizes", "n", "tokens", "n_words", "words", "size").mapInArrow(
        ask, "shard int, pack string, k long, at binary, counts binary, words binary, size long")
    return asked.groupBy("shard").applyInArrow(
        answer, "pack string, shard int, k long, at binary, local binary, counts binary")


def hash_of(word: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word)


def _totals(answers: DataFrame, shards: int) -> tuple[int, list[int], dict[int, tuple[int, int]]]:
    """(tokens, first number of each shard, {number: (count, hash)} of heavy words)."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                counts = _unz(r["counts"], r["k"], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([r["shard"]], pa.int32()), "k": pa.array([r["k"]], pa.int64()),
                    "n": pa.array([int(counts.sum())], pa.int64()),
                    "top": pa.array([counts[:4 * shards].tolist()], pa.list_(pa.int64())),
                    "hash": pa.array([np.frombuffer(r["local"], "<i8").tolist()], pa.list_(pa.int64()))})

    stats = written(answers.filter("pack is null").select("shard", "k", "counts", "local").mapInArrow(
        run, "shard int, k long, n long, top array<long>, hash array<long>"), "lm-stats")
    sizes = {r.shard: (r.k, r.n) for r in stats.select("shard", "k", "n").collect()}
    first, at = [], WORDS
    for s in range(shards):
        first.append(at)
        at += sizes.get(s, (0, 0))[0]
    total = sum(n for _, n in sizes.values())
    limit = max(1, total // (4 * shards))
    heavy = stats.select("shard", F.posexplode(F.arrays_zip("top", "hash")).alias("i", "x")).filter(
        F.col("x.top") > limit).collect()
    return total, [*first, at], {first[r.shard] + r.i: (r.x.top, r.x.hash % (1 << 64)) for r in heavy}  # at most 4 a shard


class _Pairs:
    """Distinct (context, word) pairs of a pack in the order they are sent:
    by shard, context and word, all known from the pack alone."""

    def __init__(self, r: dict, shards: int, heavy: set[int]):
        words = _words(r["words"], r["size"])
        hashes = np.array([hash_of(w) for w in (b" end", b" start", *words)], np.uint64)
        tokens = _unz(r["tokens"], r["n"], np.uint32)
        self.sizes = np.array(r["sizes"], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1     # places of the end tokens
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        self.stream = np.full(len(self.doc), END, np.int64)
        inner = np.ones(len(self.stream), bool)
        inner[ends] = False
        self.stream[inner] = tokens.astype(np.int64) + WORDS
        before = np.empty(len(self.stream), np.int64)
        before[1:] = self.stream[:-1]
        before[np.r_[0, ends[:-1] + 1]] = START
        distinct, index = np.unique(before * len(hashes) + self.stream, return_inverse=True)
        context, word = np.divmod(distinct, len(hashes))
        to = _mix(hashes[context])
        if heavy:
            split = np.isin(hashes, np.array(list(heavy), np.uint64))[context]
            to = np.where(split, _mix(to ^ _mix(hashes[word])), to)
        to = (to % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        self.edges = np.searchsorted(to[order], np.arange(shards + 1))
        self.context, self.word = context[order], word[order]
        sent = np.empty(len(order), np.int64)
        sent[order] = np.arange(len(order))
        #: which pair each token is the end of
        self.of_token = sent[index]


def score(docs: DataFrame, held: Column, id: str = "doc_id", text: str = "text", mu: float = MU,
          shards: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    return _rounds(docs, held, id, text, mu, shards, False)


def tries(docs: DataFrame, held: Column, id: str = "doc_id", text: str = "text", mu: float = MU,
          shards: int | None = None) -> DataFrame:
    """The model: (shard, trie) with the serialised trie of every shard."""
    return _rounds(docs, held, id, text, mu, shards, True)


def _rounds(docs, held, id, text, mu, shards, keep_tries) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.coalesce(held, F.lit(False)).alias("held"))
    packed = written(packs(rows), "lm-packs")
    if shards is None:
        tokens = packed.agg(F.sum("n")).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(tokens / SHARD_TOKENS))
    answers = written(_count_words(packed, shards), "lm-words")
    word_tokens, first, heavy = _totals(answers, shards)
    learnt = packed.select(F.size(F.filter("held", lambda h: ~h)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    vocabulary = first[-1] - WORDS + (learnt > 0)
    n_train = word_tokens + learnt
    whole = n_train + vocabulary + 1
    counts_of = {n: c for n, (c, _) in heavy.items()} | {START: learnt}
    hashes = {h for _, h in heavy.values()} | {hash_of(b" start")}
    shared = spark.sparkContext.broadcast((np.array(first, np.int64), counts_of, hashes))
    universe = first[-1] + 1  # the last number stands for all unknown words

    def ask(key, left, right):
        first, _, heavy = shared.value
        r = left.to_pylist()[0]
        number = np.full(r["n_words"] + WORDS, universe - 1, np.int64)
        count = np.zeros(r["n_words"] + WORDS, np.int64)
        for a in right.to_pylist():
            at = np.cumsum(_unz(a["at"], a["k"], np.uint32)) + WORDS
            count[at] = _unz(a["counts"], a["k"], np.int64)
            number[at] = first[a["shard"]] + _unz(a["local"], a["k"], np.uint32)
        number[count == 0] = universe - 1
        number[END], number[START], count[END] = END, START, learnt
        pairs = _Pairs(r, shards, heavy)
        n_docs = len(pairs.sizes)
        base = np.log10((count + 1) / whole)
        by_doc = lambda x: np.bincount(pairs.doc, weights=x[pairs.stream], minlength=n_docs)
        info = {"ids": r["ids"], "held": r["held"], "n_tokens": (pairs.sizes + 1).tolist(),
                "n_known": by_doc(count > 0).astype(np.int64).tolist(), "base": by_doc(base).tolist()}
        learn = np.repeat(~np.array(r["held"], bool), pairs.sizes + 1)
        seen = np.bincount(pairs.of_token, weights=learn, minlength=len(pairs.word)).astype(np.uint32)
        context, word, code = number[pairs.context], number[pairs.word], quantise(base)[pairs.word]
        home = int(_mix(np.array([hash_of(r["pack"].encode()) >> 1]))[0] % shards)
        out = [{"shard": home, "n": 0, "info": info}]
        for s in range(shards):
            mine = slice(pairs.edges[s], pairs.edges[s + 1])
            n = int(mine.stop - mine.start)
            if n:
                out.append({"shard": s, "n": n, "context": _z(np.diff(context[mine], prepend=0).astype(np.int32).view(np.uint32)),
                            "word": _z(word[mine].astype(np.uint32)), "seen": _z(seen[mine]), "code": _z(code[mine])})
        for x in out:
            x["pack"] = r["pack"]
        return pa.Table.from_pylist(out, asks)

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = packed.schema["ids"].dataType.elementType.simpleString()
    info_type = (f"struct<ids:array<{id_type}>,held:array<boolean>,n_tokens:array<long>,n_known:array<long>,base:array<double>>")
    info_arrow = pa.struct([("ids", to_arrow_type(packed.schema["ids"].dataType)), ("held", pa.list_(pa.bool_())),
                            ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())),
                            ("base", pa.list_(pa.float64()))])
    parts = ("context", "word", "seen", "code")
    asks = pa.schema([("pack", pa.string()), ("shard", pa.int32()), ("n", pa.int64()),
                      *[(p, pa.binary()) for p in parts], ("info", info_arrow)])
    asked = packed.groupBy("pack").cogroup(answers.filter("pack is not null").groupBy("pack")).applyInArrow(
        ask, f"pack string, shard int, n long, {', '.join(p + ' binary' for p in parts)}, info {info_type}")
    replies = pa.schema([("pack", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("codes", pa.binary()),
                         ("info", info_arrow)])

    def answer(key, table):
        _, heavy, _ = shared.value
        infos = table.filter(pa.compute.is_valid(table.column("info")))
        rows = table.filter(pa.compute.is_null(table.column("info"))).select(["pack", "n", *parts]).to_pylist()
        shard = key[0].as_py()
        pairs, seen, code = [], [], []
        for r in rows:
            context = np.cumsum(_unz(r["context"], r["n"], np.uint32).view(np.int32), dtype=np.int64).astype(np.uint64)
            pairs.append(context * np.uint64(universe) + _unz(r["word"], r["n"], np.uint32))
            seen.append(_unz(r["seen"], r["n"], np.uint32))
            code.append(_unz(r["code"], r["n"], np.uint16))
        blob, answered = b"", []
        if rows:
            pairs, seen, code = map(np.concatenate, (pairs, seen, code))
            distinct, where = np.unique(pairs, return_inverse=True)
            del pairs
            some = np.zeros(len(distinct), np.uint16)
            some[where] = code
            count = np.bincount(where, weights=seen, minlength=len(distinct))
            del seen, code
            context, word = (distinct // np.uint64(universe)).astype(np.int64), distinct % np.uint64(universe)
            kept = np.flatnonzero(count)
            v, w, c = context[kept], word[kept], count[kept]
            starts = np.flatnonzero(np.r_[True, np.diff(v) != 0]) if len(v) else np.zeros(0, np.int64)
            total = np.add.reduceat(c, starts) if len(v) else np.zeros(0)
            for i in np.flatnonzero(np.isin(v[starts], np.array(list(heavy), np.int64))):
                total[i] = heavy[int(v[starts[i]])]
            each = np.repeat(total, np.diff(np.r_[starts, len(v)]))
            p = np.log10((c + mu * 10 ** restore(some[kept])) / (each + mu))
            blob = Trie.build(v, w, p, lambda contexts: np.log10(mu / (total + mu)), universe)
            if not keep_tries:
                known, weight, hit, found = Trie(blob).look_up(context, word)
                # an unseen pair falls back on the word; a heavy context may lack all of its pairs here
                lone = np.flatnonzero(~known & np.isin(context, np.array(list(heavy), np.int64)))
                weight[lone] = [log10(mu / (heavy[int(x)] + mu)) for x in context[lone]]
                codes = quantise(np.where(hit, found, weight + restore(some)))[where]
                at = 0
                for r in rows:
                    answered.append({"pack": r["pack"], "shard": shard, "n": r["n"], "codes": _z(codes[at:at + r["n"]])})
                    at += r["n"]
        if keep_tries:
            return pa.Table.from_pydict({"shard": pa.array([shard], pa.int32()), "trie": [blob]})
        passed = pa.Table.from_arrays([infos.column("pack"), infos.column("shard"), infos.column("n"),
                                       pa.nulls(len(infos), pa.binary()), infos.column("info").cast(info_arrow)], schema=replies)
        return pa.concat_tables([passed, pa.Table.from_pylist(answered, replies)])

    if keep_tries:
        return asked.groupBy("shard").applyInArrow(answer, "shard int, trie binary")
    sums = asked.groupBy("shard").applyInArrow(answer, f"pack string, shard int, n long, codes binary, info {info_type}")

    def finish(key, left, right):
        rows = right.to_pylist()
        info = next(r["info"] for r in rows if r["info"] is not None)
        pairs = _Pairs(left.to_pylist()[0], shards, shared.value[2])
        log_p = np.zeros(len(pairs.word))
        for r in rows:
            if r["info"] is None:
                at = pairs.edges[r["shard"]]
                log_p[at:at + r["n"]] = restore(_unz(r["codes"], r["n"], np.uint16))
        total = np.bincount(pairs.doc, weights=log_p[pairs.of_token], minlength=len(pairs.sizes))
        n = len(info["ids"])
        return pa.Table.from_arrays(
            [pa.array(info["ids"], info_arrow.field("ids").type.value_type), pa.array(info["held"], pa.bool_()),
             pa.array(info["n_tokens"], pa.int64()), pa.array(info["n_known"], pa.int64()),
             pa.array([n_train] * n, pa.int64()), pa.array(info["base"], pa.float64()), pa.array(total, pa.float64())],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # the packs are dealt as they were for ``ask``, so that shuffle is used again
    return packed.groupBy("pack").cogroup(sums.groupBy("pack")).applyInArrow(
        finish, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                "score double").withColumnRenamed("id", id)
