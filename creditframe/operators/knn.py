"""Exact k-nearest neighbours by a pruned join of cells (J4, K1, K4 support).

1. Identical points are collapsed to one weighted point ``(coords, cnt,
   ysum)``: a value repeated by a third of all rows is a single row here.
2. Points are laid along a Z-order curve over their coordinates' ranks (so
   skewed and median-filled axes still spread) and cut into cells of ``CELL``
   neighbours on the curve; ``FAN`` cells make a parent, and so on.  Only
   occupied cells exist, each with its bounding box and number of individuals.
3. Pairs of (query node, point node) are followed from the top down.  At every
   level a query node knows a distance within which k individuals must lie
   (from boxes and counts); point nodes that begin beyond it are dropped, the
   others and the query node are replaced by their children.
4. The surviving pairs of leaf cells bring each query cell its candidate
   points - an equi-join on the cell number - and each cell is searched as one
   block of arrays.  Every query is final after this one pass.

No query ever meets all points unless k asks for them: the number of candidate
cells depends on k, the cell size and the dimensions, not on the table size.

Ties: points are taken in (squared distance, coordinates) order; when the
k-th individual falls inside a group of identical points, that group counts
with the needed fraction, i.e. its mean label.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import running_totals

CELL = 64
FAN = 8
#: Nodes at the top of a tree, whose pairs are the first to be looked at.
TOP = 64


def _curve(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``points`` with ``__z``: their place on a Z-order curve over ranks."""
    bits = max(1, min(10, 40 // len(dims)))
    cuts = (1 << bits) - 1
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    # 4 x 1023 numbers at most; the ranks of a block of rows are one search
    row = points.agg(*[F.percentile_approx(d, probs, 20 * (cuts + 1)).alias(f"b{i}") for i, d in enumerate(dims)]).first()
    bounds = [np.array(b or [], dtype=float) for b in row]

    @F.pandas_udf("long")
    def place(xs: pd.DataFrame) -> pd.Series:
        z = np.zeros(len(xs), dtype=np.int64)
        for i, b in enumerate(bounds):
            x = xs.iloc[:, i].to_numpy(dtype=float)
            rank = np.searchsorted(b, x, side="left").astype(np.int64)
            for bit in range(bits):
                z |= (rank >> bit & 1) << (bit * len(bounds) + i)
        return pd.Series(z)

    return points.withColumn("__z", place(F.struct(*[F.col(d) for d in dims])))


def _tree(points: DataFrame, dims: Sequence[str], tiebreak: Sequence[str], weight: Column, size: int
          ) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their ``cell``, and the levels of nodes from the top down:
    (node, parent, lo.., hi.., n)."""
    placed = running_totals(_curve(points, dims).withColumn("__w", F.lit(1)), "__z", ["__w"],
                            tiebreak=[*dims, *tiebreak])
    placed = cut_lineage(placed.withColumn("cell", F.floor(F.col("__w_before") / size))
                         .drop("__z", "__w", "__w_before", "__w_total"))
    boxes = [F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)] + [F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)]
    nodes = cut_lineage(placed.groupBy(F.col("cell").alias("node")).agg(*boxes, F.sum(weight).alias("n")))
    up = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(len(dims))] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(len(dims))]
    levels = []
    while True:
        levels.append(nodes.withColumn("parent", F.floor(F.col("node") / FAN)))
        if nodes.count() <= TOP:
            return placed, levels[::-1]
        nodes = cut_lineage(levels[-1].groupBy(F.col("parent").alias("node")).agg(*up, F.sum("n").alias("n")))


def _leaf_pairs(queries: list[DataFrame], points: list[DataFrame], d: int, need: int) -> DataFrame:
    """(q, p): leaf cells of points that may hold one of the ``need`` nearest
    individuals of a query in leaf cell q."""
    def side(nodes: DataFrame, s: str) -> DataFrame:
        return nodes.withColumnsRenamed({"node": s, "parent": f"{s}_parent", "n": f"{s}_n",
                                         **{f"{e}{i}": f"{s}_{e}{i}" for e in ("lo", "hi") for i in range(d)}})

    near, far = F.lit(0.0), F.lit(0.0)
    for i in range(d):
        ql, qh, pl, ph = (F.col(f"{s}_{e}{i}") for s in ("q", "p") for e in ("lo", "hi"))
        gap = F.greatest(pl - qh, ql - ph, F.lit(0.0))
        reach = F.greatest(ph - ql, qh - pl)
        near, far = near + gap * gap, far + reach * reach
    depth = max(len(queries), len(points))
    pairs = None
    for step in range(depth):
        qi, pi = step - (depth - len(queries)), step - (depth - len(points))
        q, p = side(queries[max(qi, 0)], "q"), side(points[max(pi, 0)], "p")
        if pairs is None:
            # at most TOP point nodes: every query node lists them
            tops = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in p.collect()])
            met = q.select("*", F.inline(tops))
        else:
            qkey = "q_parent" if qi > 0 else "q"
            pkey = "p_parent" if pi > 0 else "p"
            met = pairs.withColumnsRenamed({"q": "__q", "p": "__p"}).join(q, F.col("__q") == F.col(qkey)).join(
                p, F.col("__p") == F.col(pkey))
        met = met.select("q", "p", "p_n", near.alias("near"), far.alias("far"))
        # k individuals lie within the farthest reach of the nodes that first hold them
        order = Window.partitionBy("q").orderBy("far", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = met.withColumn("held", F.sum("p_n").over(order))
        within = F.min(F.when(F.col("held") >= need, F.col("far"))).over(Window.partitionBy("q"))
        pairs = cut_lineage(met.withColumn("within", within)
                            .where(F.col("within").isNull() | (F.col("near") <= F.col("within"))).select("q", "p"))
    return pairs


def _search(points: DataFrame, dims: Sequence[str], k: int, queries: DataFrame | None, query_extra: Sequence[str],
            exclude_self: bool, means: str | None, size: int | None) -> DataFrame:
    """Candidates of every query cell, searched as one block of arrays; either
    the taken points of every query or, with ``means``, their mean label."""
    dims, extra = list(dims), list(query_extra)
    points = points.select(*[F.col(x).cast("double").alias(x) for x in dims], F.col("cnt").cast("long").alias("cnt"),
                           F.col("ysum").cast("double").alias("ysum"))
    size = size or CELL
    placed, levels = _tree(points, dims, [], F.col("cnt"), size)
    if queries is None and not extra:
        asked, q_levels = placed.select(*dims, "cell"), levels
    else:
        queries = (points if queries is None else queries).select(
            *[F.col(x).cast("double").alias(x) for x in dims], *extra).distinct()
        asked, q_levels = _tree(queries, dims, extra, F.lit(1), size)
    pairs = _leaf_pairs(q_levels, levels, len(dims), k + int(exclude_self))
    q_dims = [f"q_{x}" for x in dims]
    asked = asked.select(F.col("cell").alias("q_cell"), *[F.col(x).alias(f"q_{x}") for x in dims], *extra)
    candidates = pairs.join(placed, F.col("p") == F.col("cell")).select(F.col("q").alias("cell"), *dims, "cnt", "ysum")
    d = len(dims)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        # in order of coordinates, so that a stable sort by distance settles ties
        right = right.sort_values(dims, kind="stable")
        p = right[dims].to_numpy(float)
        cnt, ysum = right["cnt"].to_numpy(float), right["ysum"].to_numpy(float)
        out = []
        for i, row in enumerate(left[q_dims].to_numpy(float)):
            d2 = np.zeros(len(p))
            for j in range(d):
                t = p[:, j] - row[j]
                d2 = d2 + t * t
            c, y = cnt, ysum
            if exclude_self:
                own = (p == row).all(axis=1)
                c = cnt - own
                y = ysum - own * float(left["qy"].iloc[i])
            some = np.flatnonzero(c > 0)
            if len(some) > k:
                # k points hold k individuals at least; ties with the last may come first by coordinates
                some = some[d2[some] <= np.partition(d2[some], k - 1)[k - 1]]
            some = some[np.argsort(d2[some], kind="stable")]
            before = np.cumsum(c[some]) - c[some]
            take = np.minimum(c[some], k - before)
            some, take = some[take > 0], take[take > 0]
            key = [*row, *left[extra].iloc[i]]
            if means:
                out.append([*key, float((take * y[some] / c[some]).sum() / take.sum()) if len(some) else None])
            else:
                out += [[*key, *p[s], int(t), int(c[s]), y[s], d2[s]] for s, t in zip(some, take)]
        return pd.DataFrame(out, columns=names)

    kinds = {x: asked.schema[x].dataType.simpleString() for x in extra}
    names = q_dims + extra + ([means] if means else [*dims, "take", "cnt", "ysum", "d2"])
    shape = [f"`q_{x}` double" for x in dims] + [f"`{x}` {t}" for x, t in kinds.items()]
    shape += [f"`{means}` double"] if means else [f"`{x}` double" for x in dims] + ["take long", "cnt long", "ysum double", "d2 double"]
    return asked.groupBy("q_cell").cogroup(candidates.groupBy("cell")).applyInPandas(nearest, ", ".join(shape))


def knn_candidates(points: DataFrame, dims: Sequence[str], k: int, *, queries: DataFrame | None = None,
                   query_extra: Sequence[str] = (), exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """Exact k nearest individuals for every query point.

    ``points``: one row per distinct point with ``dims``, ``cnt`` (how many
    individuals) and ``ysum`` (their label sum).  ``queries`` (default: the
    distinct points) holds ``dims`` plus ``query_extra`` columns; with
    ``exclude_self`` one individual with the query's own label ``qy`` is
    removed from the query's own point.

    Returns rows ``(q_<dims>, q_extra.., <dims>, take, cnt, ysum, d2)``: the
    neighbour points with how many of their individuals are taken.  ``cells``:
    points per leaf cell.
    """
    return _search(points, dims, k, queries, query_extra, exclude_self, None, cells)


def collapse(df: DataFrame, dims: Sequence[str], label: str | None) -> DataFrame:
    """Distinct points with their individual count and label sum."""
    y = F.col(label).cast("double") if label else F.lit(0.0)
    return df.groupBy(*[F.col(x).cast("double").alias(x) for x in dims]).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(y).alias("ysum"))


def knn_target_mean(df: DataFrame, key: str, dims: Sequence[str], label: str, k: int = 500, *,
                    exclude_self: bool = False, out: str = "KNN_TARGET_MEAN", cells: int | None = None) -> DataFrame:
    """K1: mean label of the k nearest rows (Euclidean over ``dims``; rows
    must have no nulls in ``dims`` - median-fill first, as the source did).

    The source includes the row itself among its neighbours (the default
    here); ``exclude_self`` removes it, which avoids leaking the own label.
    Returns ``(key, out)`` for every row.
    """
    dims = list(dims)
    pts = collapse(df, dims, label)
    if exclude_self:
        qy = df.select(*[F.col(x).cast("double").alias(x) for x in dims],
                       F.col(label).cast("double").alias("qy")).distinct()
        means = _search(pts, dims, k, qy, ["qy"], True, out, cells)
        qkeys = [f"q_{x}" for x in dims] + ["qy"]
    else:
        means = _search(pts, dims, k, None, [], False, out, cells)
        qkeys = [f"q_{x}" for x in dims]
    rows = df.select(key, *[F.col(x).cast("double").alias(f"q_{x}") for x in dims],
                     *([F.col(label).cast("double").alias("qy")] if exclude_self else []))
    return rows.join(means, qkeys, "left").select(key, out)


def knn_neighbours(df: DataFrame, key: str, dims: Sequence[str], k: int = 5) -> DataFrame:
    """J4 for resampling: per row, the coordinates of its k nearest *other*
    distinct points, nearest first, as an array of structs ``(d2, x...)``."""
    dims = list(dims)
    pts = collapse(df, dims, None).withColumn("cnt", F.lit(1).cast("long"))
    cand = knn_candidates(pts, dims, k + 1)
    own = F.lit(True)
    for x in dims:
        own = own & (F.col(x) == F.col(f"q_{x}"))
    nb = cand.where(~own).groupBy(*[f"q_{x}" for x in dims]).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("d2", *dims))), 1, k).alias("neighbours"))
    rows = df.select(key, *[F.col(x).cast("double").alias(f"q_{x}") for x in dims])
    return rows.join(nb, [f"q_{x}" for x in dims], "left").select(key, "neighbours")
