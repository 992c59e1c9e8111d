"""Minority oversampling (K4, SMOTE; Chawla et al. 2002).

Every synthetic row is ``x + u * (neighbour - x)`` for a minority row ``x``,
one of its k nearest minority neighbours (exact, from :mod:`knn`) and a gap
``u`` in [0, 1).  Which rows, neighbours and gaps are used comes from seeded
hashes, so the output is the same on any cluster and partitioning.  The
number of synthetic rows per minority row is ``need // n_min`` plus one for
the first ``need % n_min`` rows in hash order, so exactly ``need`` rows are
made and no row is drawn twice as often as another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn_neighbours
from .ml import _hash_rank


def smote(df: DataFrame, key: str, features: Sequence[str], label: str, *, k: int = 5, seed: int = 42,
          minority: int = 1, ratio: float = 1.0, flag: str = "synthetic") -> DataFrame:
    """K4: original rows plus synthetic minority rows until the minority is
    ``ratio`` times the majority.  Synthetic keys are ``-(rank * m + j + 1)``
    style negatives so they never collide with real (non-negative) keys."""
    feats = list(features)
    base = df.select(key, label, *[F.col(f).cast("double").alias(f) for f in feats])
    counts = base.agg(F.sum((F.col(label) == minority).cast("long")).alias("n_min"),
                      F.sum((F.col(label) != minority).cast("long")).alias("n_maj")).first()
    n_min, n_maj = int(counts["n_min"] or 0), int(counts["n_maj"] or 0)
    need = max(0, int(round(ratio * n_maj)) - n_min)
    originals = base.withColumn(flag, F.lit(False))
    if need == 0 or n_min == 0:
        return originals
    per, extra = divmod(need, n_min)
    mino = base.where(F.col(label) == minority)
    nbrs = knn_neighbours(mino, key, feats, k)
    ranked = _hash_rank(mino, key, None, seed)
    gen = ranked.join(nbrs, key, "left").withColumn(
        "__m", F.lit(per) + (F.col("__rank") < F.lit(extra)).cast("int"))
    gen = gen.where(F.col("__m") > 0).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    hj = lambda s: F.xxhash64(F.col(key).cast("string"), F.col("__j"), F.lit(s))
    n_nb = F.coalesce(F.size("neighbours"), F.lit(0))
    pick = F.when(n_nb > 0, F.element_at(F.col("neighbours"), (F.pmod(hj(seed), n_nb) + 1).cast("int")))
    u = F.pmod(hj(seed + 1), F.lit(1 << 53)).cast("double") / float(1 << 53)
    gen = gen.withColumn("__nb", pick).withColumn("__u", u)
    synth = gen.select(
        (-(F.col("__rank") * F.lit(per + 1) + F.col("__j") + 1)).cast(df.schema[key].dataType).alias(key),
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        *[F.coalesce(F.col(f) + F.col("__u") * (F.col("__nb")[f] - F.col(f)), F.col(f)).alias(f) for f in feats],
        F.lit(True).alias(flag))
    return originals.unionByName(synth)
