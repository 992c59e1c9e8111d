"""Mixing sources to target weights: temperature, bisected, then realised.

Weights are ``share ** exponent``, normalised, over the sources' token shares.
Lowering the exponent from 1 flattens the mix.  The exponent is bisected to
reach a target entropy (as a part of the largest possible), but never past
the point where the smallest source would repeat more often than allowed;
each pass over the source table evaluates 63 exponents, six halvings at once.

A source's quota of tokens is realised as whole blocks, each a permutation of
all of its rows, and a last block cut where the quota is used up.  The
permutation is by a hash of row and block, so nothing is sorted globally: the
cut is found from token sums of hash buckets and then inside one bucket.

Without a budget, the mix is as large as it can be with the largest source
used once: no row is lost, smaller sources repeat.

Scale: sources are only ever aggregated in Spark (any number of them); rows
of a source, however many, are summed per hash bucket before the cut is
looked for; the text is read twice and never shuffled, as the plan has one
row per source.

Edge cases: null is a source like any other; rows without words use no
budget, and a source without any token keeps its rows once; equal rows share
their place, so they enter a cut block together or not at all; an empty table
stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, words_of, written

BUCKETS = 4096
ENTROPY = 0.9
MAX_REPEATS = 4.0
SEED = 17


@dataclass(frozen=True)
class Mix:
    exponent: float
    entropy: float          # of the weights, in nats
    sources: DataFrame      # source, tokens, weight, quota, blocks, cut


def _row_hash(id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), id, text)


def _block_key(row: Column, block: Column) -> Column:
    """Place of a row in the permutation of a block, as a non-negative number."""
    return F.shiftrightunsigned(F.xxhash64(row, block), 1)


def find_exponent(sizes: DataFrame, entropy: float, max_repeats: float, budget: int | None) -> tuple[float, float]:
    """(exponent, entropy) for ``sizes`` (source, tokens > 0)."""
    top = sizes.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not top[3] or top[3] == 1:
        return 1.0, 0.0
    total, least, most, n = top
    share = F.col("tokens") / F.lit(float(total))
    low, high, reached = 0.0, 1.0, 0.0
    for _ in range(5):
        grid = [low + (high - low) * i / 64 for i in range(65)]
        z = sizes.agg(*[F.sum(F.pow(share, F.lit(a))) for a in grid],
                      *[F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in grid]).first()
        h = [log(z[i]) - a * z[65 + i] / z[i] for i, a in enumerate(grid)]

        def repeats(i: int) -> float:
            if budget is None:
                return (least / most) ** (grid[i] - 1)
            return budget / (z[i] * total) * (least / total) ** (grid[i] - 1)

        # flat enough from here down; rare enough from here up
        flat = max((i for i in range(65) if h[i] >= entropy * log(n)), default=0)
        rare = min((i for i in range(65) if repeats(i) <= max_repeats), default=64)
        at = max(flat, rare)
        reached = h[at]
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, 64)]
        exponent = grid[at]
    return round(exponent, 6), reached


def plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
         entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> Mix:
    """Exponent, and quota, whole blocks and cut of every source."""
    narrow = written(docs.select(F.col(f"`{source}`").alias("source"),
                                 F.size(words_of(F.col(f"`{text}`").cast("string"))).cast("long").alias("n"),
                                 _row_hash(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("row")), "mix-rows")
    sizes = written(narrow.groupBy("source").agg(F.sum("n").alias("tokens")), "mix-sizes")
    some = sizes.filter("tokens > 0")
    exponent, reached = find_exponent(some, entropy, max_repeats, budget)
    flat = some.withColumn("flat", F.pow(F.col("tokens").cast("double"), F.lit(exponent)))
    z, most, scale = flat.agg(F.sum("flat"), F.max("tokens"), F.max("flat")).first()
    total = budget if budget is not None else (most * z / scale if z else 0)
    # without a budget no source is used less than once, whatever the rounding
    least = F.lit(0).cast("long") if budget is not None else F.col("tokens")
    quotas = sizes.withColumn(
        "weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(z or 1.0))
        .otherwise(0.0)).withColumn(
        "quota", F.when(F.col("tokens") > 0, F.greatest(
            F.floor(F.col("weight") * F.lit(float(total)) + 1e-6), least)).otherwise(0)).withColumn(
        "blocks", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)).withColumn(
        "rest", F.col("quota") - F.col("blocks") * F.col("tokens"))
    quotas = written(quotas, "mix-quotas")
    same = narrow["source"].eqNullSafe(quotas["source"])
    keyed = (narrow.join(quotas.filter("rest > 0"), same)
             .select(quotas["source"], "rest", "n", _block_key(F.col("row"), F.col("blocks")).alias("key"))
             .withColumn("bucket", F.floor(F.col("key") / F.lit((1 << 63) // BUCKETS))))
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = W.partitionBy("source").orderBy("bucket")
    edge = written(by_bucket.withColumn("upto", F.sum("n").over(upto))
                   .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
                   .groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
                   .select("source", "e.*"), "mix-edges")
    inside = keyed.join(edge, keyed["source"].eqNullSafe(edge["source"]) & (keyed["bucket"] == edge["bucket"])).select(
        keyed["source"], "rest", "before", "n", "key")
    # equal keys share a running sum, so the cut is a key
    run = W.partitionBy("source").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    past = (inside.withColumn("upto", F.col("before") + F.sum("n").over(run)).filter("upto > rest")
            .groupBy("source").agg(F.min("key").alias("cut")))
    cuts = written(past, "mix-cuts")
    sources = quotas.join(cuts, quotas["source"].eqNullSafe(cuts["source"]), "left").select(
        quotas["source"], "tokens", "weight", "quota", "blocks", F.coalesce("cut", F.lit(0)).alias("cut"))
    return Mix(exponent, reached, written(sources, "mix-sources"))


def realise(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``block`` and ``place``: one row for each use of a row."""
    block, place = free_name(docs, "block"), free_name(docs, "place")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                         _row_hash(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("row"),
                         F.col(f"`{source}`").alias("of"))
    plan = mix.sources.select("source", "blocks", "cut")
    used = packed.join(plan, packed["of"].eqNullSafe(plan["source"]))
    extra = (_block_key(F.col("row"), F.col("blocks")) < F.col("cut")).cast("long")
    uses = F.col("blocks") + extra
    return (used.filter(uses > 0).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
            .select("doc.*", F.col("b").alias(block), _block_key(F.col("row"), F.col("b")).alias(place)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Rows of the mix with the columns of ``docs`` only."""
    names = {k: options[k] for k in ("id", "text", "source") if k in options}
    return realise(docs, plan(docs, **options), **names).select(*[f"`{c}`" for c in docs.columns])
