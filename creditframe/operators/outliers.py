"""Multivariate outliers: a distributed isolation forest.

Liu, Ting and Zhou (2008): each tree isolates a small sample by random
axis-parallel cuts; points isolated in few cuts are anomalous.

* Sample: tree t takes the ``sample_size`` rows whose hash comes first in an
  order of its own (one ``md5`` a row, a multiplication a tree).  Rows first pass a
  cheap filter that keeps about
  four times that many per tree, then ``row_number <= sample_size`` per tree
  runs map-side (WindowGroupLimit): no row is shipped for trees it is not in.
* Build: one ``applyInPandas`` group per tree (a few hundred rows each); cuts
  are drawn by hashes of tree and node, so the forest table can be grown again.
* Score: the forest is at most ``trees * (2 * sample_size - 1)`` nodes, so it
  is collected once and shipped with the scoring function; every task scores
  its Arrow batches with numpy, one tree level at a time.
* Label: rows below the ``contamination`` quantile of the score are
  outliers (-1), others 1; the quantile is exact and distributed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .clean import with_scalars
from .ml import _key_hash
from .ordered import quantiles

EULER = 0.5772156649015329
#: Modulus of the per-tree order of the rows (a Mersenne prime).
PRIME = (1 << 31) - 1
NODE_SCHEMA = "tree int, node int, feature int, threshold double, size long"


def average_path(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search over n points, in
    steps of 2**-32, so that sums of path lengths do not depend on their order."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return np.floor(out * 2.0**32 + 0.5) / 2.0**32


def _digits(*parts) -> int:
    """60 bits of ``md5`` over the parts joined by ``:`` (any engine can recompute them)."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _draw(*parts) -> float:
    return _digits(*parts) / float(1 << 60)


def _build_tree(tree: int, x: np.ndarray, max_depth: int, seed: int) -> list[tuple]:
    """Rows of ``NODE_SCHEMA``; node 1 is the root, 2i and 2i + 1 are the
    children of i, a leaf has feature -1.  A cut takes one of the features
    that vary in the node, at a place between its least and largest value."""
    nodes, todo = [], [(1, 0, np.arange(x.shape[0]))]
    while todo:
        node, depth, idx = todo.pop()
        sub = x[idx]
        lo, hi = (sub.min(axis=0), sub.max(axis=0)) if idx.size else (np.zeros(x.shape[1]),) * 2
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or usable.size == 0:
            nodes.append((tree, node, -1, 0.0, idx.size))
            continue
        f = int(usable[min(int(_draw("f", tree, node, seed) * usable.size), usable.size - 1)])
        cut = float(lo[f] + _draw("t", tree, node, seed) * (hi[f] - lo[f]))
        cut = float(hi[f]) if cut <= lo[f] else cut
        nodes.append((tree, node, f, cut, idx.size))
        left = sub[:, f] < cut
        todo += [(2 * node, depth + 1, idx[left]), (2 * node + 1, depth + 1, idx[~left])]
    return nodes


def forest_table(df: DataFrame, key: str, features: Sequence[str], *, trees: int = 100,
                 sample_size: int = 256, seed: int = 42, rows: int | None = None) -> DataFrame:
    """The forest as a table, one row per node (``NODE_SCHEMA``; at most
    ``trees * (2 * sample_size - 1)`` rows): ``feature`` is the place in
    ``features``, ``size`` the sampled rows that reached the node.

    Every draw is a hash of (tree, node, seed) and every sample an order of
    hashes of the key, so the forest is the same on any cluster and can be
    grown again by another engine.  Empty input gives no node.
    """
    feats = list(features)
    n = df.count() if rows is None else rows
    m = min(sample_size, n)
    max_depth = int(math.ceil(math.log2(max(m, 2))))
    # about 4 m rows a tree are ordered, the others are passed over in the scan
    bound = int(min(1.0, 4.0 * m / max(n, 1)) * PRIME) + 1
    factor = F.array(*[F.lit(_digits("a", t, seed) % (PRIME - 1) + 1) for t in range(trees)])
    shift = F.array(*[F.lit(_digits("b", t, seed) % PRIME) for t in range(trees)])
    place = lambda t: (F.col("__h") % F.lit(PRIME) * F.get(factor, t) + F.get(shift, t)) % F.lit(PRIME)
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < F.lit(bound))
    sampled = (df.select(F.col(f"`{key}`").alias("__k"), _key_hash(key, seed).alias("__h"),
                         *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
               .withColumn("tree", F.explode(picked)))
    w = Window.partitionBy("tree").orderBy(place(F.col("tree")), "__h", "__k")
    names = [f"x{i}" for i in range(len(feats))]
    sample = sampled.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= m).select("tree", *names)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_build_tree(int(pdf["tree"].iloc[0]), pdf[names].to_numpy(dtype="float64"), max_depth, seed),
                            columns=["tree", "node", "feature", "threshold", "size"])

    return sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def _score_fn(nodes: pd.DataFrame, sample_size: int):
    trees = []
    for _, nd in nodes.groupby("tree"):
        feat = np.full(int(nd["node"].max()) + 1, -1)
        cut, adjust = np.zeros(feat.size), np.zeros(feat.size)
        at = nd["node"].to_numpy()
        feat[at], cut[at], adjust[at] = nd["feature"], nd["threshold"], average_path(nd["size"])
        trees.append((feat, cut, adjust))
    norm = float(average_path([sample_size])[0]) or 1.0

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape[0])
        for feat, cut, adjust in trees:
            node = np.ones(x.shape[0], dtype=np.int64)
            active = np.flatnonzero(feat[node] >= 0)
            while active.size:
                at = node[active]
                node[active] = 2 * at + (x[active, feat[at]] >= cut[at])
                total[active] += 1.0
                active = active[feat[node[active]] >= 0]
            total += adjust[node]
        return -np.power(2.0, -(total / max(len(trees), 1)) / norm)   # lower = more anomalous

    return score


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], *, trees: int = 100,
                     sample_size: int = 256, contamination: float = 0.05, seed: int = 42,
                     label: str = "outlier_label", score_col: str = "outlier_score") -> DataFrame:
    """``outlier_label`` (-1 outlier, 1 inlier) and ``outlier_score``
    (higher is more normal, as ``score_samples``) for every row.  Inputs must
    be non-null (median-fill first, as the source did)."""
    feats = list(features)
    n = df.count()
    nodes = forest_table(df, key, feats, trees=trees, sample_size=sample_size, seed=seed, rows=n).toPandas()
    score = _score_fn(nodes, min(sample_size, n))

    names = [f"x{i}" for i in range(len(feats))]

    def apply(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf["__k"], score_col: score(pdf[names].to_numpy(dtype="float64"))})

    key_type = df.schema[key].dataType.simpleString()
    # the scores are read for the cut and for the result: computed once
    scored = cut_lineage(df.select(F.col(f"`{key}`").alias("__k"), *[
        F.col(f"`{f}`").cast("double").alias(x) for f, x in zip(feats, names)]).mapInPandas(
        apply, f"`{key}` {key_type}, `{score_col}` double"))
    offset = quantiles(scored, [score_col], [contamination])
    qname = [c for c in offset.columns if c != "feature"][0]
    out = with_scalars(scored, offset.select(F.col(qname).alias("__offset")))
    return out.withColumn(label, F.when(F.col(score_col) < F.col("__offset"), F.lit(-1)).otherwise(F.lit(1))) \
        .drop("__offset")
