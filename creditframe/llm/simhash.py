"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

1. ``fingerprints``: one narrow pass; each row's lower-cased words become
   space-joined shingles, their XXH64 values vote on 64 bits.
2. Equal fingerprints collapse (partial aggregation), so copies never meet
   pair by pair.
3. ``links``: the 64 bits are split into B blocks; fingerprints at most d
   bits apart agree on at least B - d blocks, so they share a bucket in one
   of the C(B, d) tables keyed by B - d blocks.  Every bucket is verified by
   Hamming distance and reports a spanning forest of its links, at most one
   fewer than its members.  A large bucket is cut again into blocks of its
   remaining bits.
4. ``components`` of the links give the classes.

B grows with the number of distinct fingerprints so that buckets of unrelated
fingerprints stay small; every choice finds every link.

Edge cases: null and blank texts have fingerprint 0 and link like any other;
a text with fewer words than a shingle is one shingle; repeated rows share
their class; a class without any id has component null.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Buckets above this many members are cut into smaller ones before comparing.
CUT = 1024


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 ``text`` as an unsigned 64-bit number."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row struct of ``keys``, fp long) per row of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"),
                       F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["row", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())]))


def _blocks(n: int, bits: int = 64) -> list[int]:
    """Masks of ``n`` blocks that together cover ``bits`` bits."""
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def tables(n: int, max_bits: int = MAX_BITS) -> list[int]:
    """Key masks for ``n`` distinct fingerprints: C(B, max_bits) tables of B - max_bits blocks."""
    extra = next((e for e in range(1, 5) if n <= 4 * 2 ** (64 * e / (max_bits + e))), 5)
    blocks = _blocks(max_bits + extra)
    return [sum(chosen) for chosen in combinations(blocks, extra)]


def forest(f: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most ``max_bits`` apart) among distinct ``f``."""
    out: list[tuple[int, int]] = []
    if len(f) > CUT:
        varying = [b for b in range(64) if len(np.unique((f >> np.uint64(b)) & np.uint64(1))) > 1]
        if len(varying) > max_bits:
            cuts = [round(i * len(varying) / (max_bits + 1)) for i in range(max_bits + 2)]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                key = f & np.uint64(sum(1 << v for v in varying[a:b]))
                order = np.argsort(key, kind="stable")
                parts += np.split(f[order], np.flatnonzero(np.diff(key[order])) + 1)
            for p in parts:
                if 1 < len(p) < len(f):
                    out += forest(p, max_bits)
            return out
    left = f
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.bitwise_count(left ^ reached[0]) <= max_bits
            fresh = left[near]
            out += [(int(reached[0]), int(x)) for x in fresh]
            reached, left = np.concatenate([reached[1:], fresh]), left[~near]
    return out


def links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (fp) that are near: a
    spanning forest of every bucket, so whatever is linked is connected."""
    masks = tables(n, max_bits)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
        for i, m in enumerate(masks)])).alias("k")).select("k.t", "k.key", "fp")
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def verify(batches):
        held = [np.zeros(0, np.int64)] * 3

        def bucket_links(cols):
            t, key, fp = cols
            edge = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            start, end = np.r_[0, edge], np.r_[edge, len(t)]
            f = fp.view(np.uint64)
            two = start[end - start == 2]
            near = two[np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits]
            a, b = [f[near]], [f[near + 1]]
            for s, e in zip(start[end - start > 2], end[end - start > 2]):
                found = np.array(forest(f[s:e], max_bits), np.uint64).reshape(-1, 2)
                a.append(found[:, 0])
                b.append(found[:, 1])
            return pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64),
                                               "b": np.concatenate(b).view(np.int64)})

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            cols = [np.concatenate([h, x]) for h, x in zip(held, new)]
            # the last bucket may go on in the next batch
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield bucket_links([c[:cut] for c in cols])
        if len(held[0]):
            yield bucket_links(held)

    return dealt.mapInArrow(verify, "a long, b long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for every distinct ``fp``; root is the class."""
    distinct = written(prints.select("fp").distinct(), "fingerprints")
    found = components(links(distinct, distinct.count(), max_bits))
    return distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(``id``, fingerprint, component_id) per row of ``docs``."""
    prints = written(fingerprints(docs, (id,), text, shingle).select(F.col(f"row.`{id}`").alias("id"), "fp"), "prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    of = classes(prints, max_bits)
    by_root = written(of.join(least, "fp").select("fp", "root", "least"), "classes")
    named = written(by_root.groupBy("root").agg(F.min("least").alias("component_id")), "class-names")
    label = written(by_root.join(named, "root").select("fp", "component_id"), "class-labels")
    return prints.join(label, "fp").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every class, unchanged: the smallest id (null last), and of
    rows that share it the first."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text}`").alias("text"), F.col(f"`{id}`").alias("id")).withColumn(
        "n", F.monotonically_increasing_id())
    rows = written(rows.drop("text"), "rows")
    packed = rows.select("n", "id", F.col(f"row.`{text}`").alias("text"))
    prints = written(fingerprints(packed, ("n", "id"), "text", shingle)
                     .select("row.n", "row.id", "fp"), "prints")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("n"))).alias("first")
    least = prints.groupBy("fp").agg(first)
    by_root = classes(prints, max_bits).join(least, "fp")
    kept = written(by_root.groupBy("root").agg(F.min("first").alias("first")).select("first.n"), "kept")
    # what stays grows with the corpus, so it is joined by key at every size
    return rows.join(kept.hint("merge"), "n", "left_semi").select("row.*")
