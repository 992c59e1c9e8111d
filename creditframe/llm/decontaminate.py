"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a benchmark item is a test
string (an item of fewer words, but not none, is one window).  Windows of one
length share a search table whose symbols are words:

* a *block* is two consecutive words (one for one-word windows); the shift
  table tells how far the search may skip when a block ends at the current
  position without ending any window;
* a block with shift 0 selects a bucket of windows by their suffix block, and
  within it by their prefix block;
* direct comparison of all words confirms the occurrence.

Invented or unrelated text skips nearly a whole window per probe.

Scale: documents are scanned in one narrow pass.  The stated test strings are
searched in blocks of at most ``BLOCK_BYTES``; only one block is held at a
time, and each is broadcast for its own pass, so a benchmark of any size runs
in bounded memory.  With more than one block the hits are merged per row.

Edge cases: null text has no words (no hits, clean); null, blank and repeated
items add nothing; an item without id is reported as ``null``; repeated rows
are judged one by one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WINDOW = 13
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z; ASCII outside 0-9 and a-z parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))

_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])


def fold_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 ``text``."""
    return text.translate(_FOLD).split() if text else []


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search tables of windows of words; ``owners`` lists the items of each."""

    def __init__(self, test_strings: list[tuple[bytes, str]]):
        owners: dict[tuple[bytes, ...], list[str]] = {}
        for string, item in test_strings:
            owners.setdefault(tuple(string.split(b" ")), []).append(item)
        self.tables = []
        for m in sorted({len(p) for p in owners}):
            block = min(2, m)
            far = m - block + 1
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict] = {}
            for p, items in owners.items():
                if len(p) != m:
                    continue
                for j in range(block, m + 1):
                    b = p[j - block:j]
                    shift[b] = min(shift.get(b, far), m - j)
                buckets.setdefault(p[m - block:], {}).setdefault(p[:block], []).append((list(p), items))
            self.tables.append((m, block, far, shift, buckets))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence, by word position."""
        n = len(words)
        for m, block, far, shift, buckets in self.tables:
            end = m
            while end <= n:
                suffix = tuple(words[end - block:end])
                skip = shift.get(suffix, far)
                if skip:
                    end += skip
                    continue
                start = end - m
                for p, items in buckets[suffix].get(tuple(words[start:start + block]), ()):
                    if words[start:end] == p:
                        yield start, end, items
                end += 1


def _merged(found: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, size: int,
            block_bytes: int) -> Iterator[list[tuple[bytes, str]]]:
    """The distinct (window, item) pairs, streamed and packed into blocks."""
    def split(batches):
        for b in batches:
            out = [(w, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())
                   for w in windows(fold_words(t), size)]
            yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in out], pa.binary()),
                                              "i": pa.array([i for _, i in out], pa.string())})

    pairs = (benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"),
                              F.col(item_text).cast("string").alias("t"))
             .filter("t is not null").mapInArrow(split, "w binary, i string").distinct())
    block, held = [], 0
    for row in pairs.toLocalIterator():
        block.append((bytes(row.w), row.i))
        held += len(row.w) + len(row.i)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _scan(rows: DataFrame, test_strings: list[tuple[bytes, str]]) -> DataFrame:
    """``rows`` (row, text) with text replaced by the hits of one block."""
    shared = rows.sparkSession.sparkContext.broadcast(test_strings)

    def search(batches):
        tables = WuManber(shared.value)
        for b in batches:
            n_words, spans, items = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = fold_words(text)
                found = list(tables.find(words))
                n_words.append(len(words))
                spans.append(_merged([f[:2] for f in found]))
                items.append(sorted({i for f in found for i in f[2]}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return rows.mapInArrow(search, T.StructType([rows.schema["row"], *_HITS.fields]))


def find(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``row`` (struct of ``keys``), ``n_words``, merged
    hit ``spans`` in words, ``n_hit``, ``items``, ``contaminated``."""
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        hits = _scan(rows, first)
    else:
        # several blocks: rows get a stable number, hits meet by it
        rows = written(rows.withColumn("n", F.monotonically_increasing_id()), "decontaminate-rows")
        numbered = rows.select(F.struct("n", "row").alias("row"), "text")
        parts = written(_scan(numbered, first), "decontaminate-hits")
        for block in itertools.chain([second], blocks):
            more = _scan(numbered, block).filter(F.size("spans") > 0)
            parts = parts.unionByName(written(more, "decontaminate-hits"))
        hits = (parts.groupBy(F.col("row.n").alias("n"))
                .agg(F.first("row.row").alias("row"), F.first("n_words").alias("n_words"),
                     F.flatten(F.collect_list("spans")).alias("spans"),
                     F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("n"))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"),
                              (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")),
        lambda a: a["n"])
    hits = hits.withColumn("n_hit", covered)
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return find(docs, benchmark, tuple(docs.columns), text, **options).filter("not contaminated").select("row.*")
