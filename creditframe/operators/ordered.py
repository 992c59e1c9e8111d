"""Exact global order statistics without a single-partition window.

``running_totals`` gives every row of a (pre-aggregated) table the sum of a
weight over all rows ordered before it.  A bare ``Window.orderBy`` would pull
every row into one task; instead rows are cut into value buckets at
approximate quantile boundaries, bucket totals (a tiny table) are turned into
offsets, and each bucket computes its own running sum.  The result is exact:
approximation only decides *where* the buckets split, not what is summed.

Quantiles need no ranks of all rows: a sketch brackets them, everything else
is counted in a few rows, and only the brackets are ordered.

On top of it: exact quantiles (linear / nearest, as ``PERCENTILE_CONT`` and
the Polars default), percentile ranks, and the rank statistics used by AUC
and ROC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


#: Rows around a quantile that may be ordered by value.
BRACKET_ROWS = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null meets null; key columns come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _n_below(bounds: Column, x: Column, n: int) -> Column:
    """How many of the ``n`` sorted ``bounds`` lie below ``x``, in two steps of
    about sqrt(n) comparisons."""
    step = max(1, int(n ** 0.5))
    coarse = F.filter(bounds, lambda b, i: (i % step == step - 1) & (b < x))
    skip = F.size(coarse) * step
    fine = F.filter(F.slice(bounds, skip + 1, F.lit(step)), lambda b: b < x)
    return skip + F.size(fine)


def running_totals(df: DataFrame, order_col: str, weights: Sequence[str], *,
                   by: Sequence[str] = (), buckets: int | None = None, descending: bool = False,
                   accuracy: int = 10000, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``{w}_before`` (sum over rows strictly before in order) and
    ``{w}_total`` (sum over the group) for every weight column.

    ``df`` should hold one row per ``(by, order_col)``: pre-aggregate first,
    so a value repeated by a third of all rows is one row here; rows that
    still share a place are ordered by ``tiebreak``.  Null is a group of its
    own.  The input is read three times (bounds, bucket totals, rows), so it is
    written once first and what feeds it runs once.  There are as many buckets as shuffle partitions (64 at least), so
    parallelism follows the cluster's setting.  Bounds and offsets are small
    tables (groups x buckets); whether they are broadcast is left to their
    size.  Without ``by`` the bucket bounds arrive as a scalar subquery.
    """
    from .clean import with_scalars
    keys = list(by)
    df = materialize(df, "ordered")
    if buckets is None:
        buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    o = F.col(order_col)
    ordered = -o if descending else o
    probs = [i / buckets for i in range(1, buckets)]
    bounds_agg = F.percentile_approx(ordered, probs, max(accuracy, 20 * buckets)).alias("__bounds")
    if keys:
        # written, so that the bounds of a few groups are known to be small
        b = join_null_safe(df, materialize(df.groupBy(*keys).agg(bounds_agg), "bounds"), keys)
    else:
        b = with_scalars(df, df.agg(bounds_agg))
    place = F.coalesce(_n_below(F.col("__bounds"), ordered, buckets), F.lit(0))
    b = b.withColumn("__bucket", place).drop("__bounds")
    tot = b.groupBy(*keys, "__bucket").agg(*[F.sum(w).alias(f"__bt_{w}") for w in weights])
    # the bucket table has at most len(groups) * buckets rows: windows over it are tiny
    part = keys or [F.lit(0)]
    wb = Window.partitionBy(*part).orderBy("__bucket")
    offs = tot.select(
        *keys, "__bucket",
        *[F.coalesce(F.sum(f"__bt_{w}").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"__off_{w}") for w in weights],
        *[F.sum(f"__bt_{w}").over(Window.partitionBy(*part)).alias(f"{w}_total") for w in weights])
    b = join_null_safe(b, offs, keys + ["__bucket"])
    wi = Window.partitionBy(*keys, "__bucket").orderBy(ordered, *tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    return b.select(
        *[c for c in b.columns if not c.startswith("__off_")],
        *[(F.col(f"__off_{w}") + F.coalesce(F.sum(w).over(wi), F.lit(0))).alias(f"{w}_before")
          for w in weights]).drop("__bucket")


def value_counts_long(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = (),
                      name: str = "feature", value: str = "value") -> DataFrame:
    """Numeric columns to ``(by, feature, value, cnt)`` with nulls dropped.

    The group-by combines map-side, so a value held by many rows crosses
    the shuffle once per map task.
    """
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), name, value)
    return long.where(F.col(value).isNotNull()).groupBy(*by, name, value).agg(
        F.count(F.lit(1)).alias("cnt"))


def quantiles_from_counts(vc: DataFrame, qs: Sequence[float], *, by: Sequence[str] = (),
                          value: str = "value", method: str = "linear",
                          names: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact quantiles per ``by`` group from ``(by, value, cnt)`` rows.

    ``linear`` = ``PERCENTILE_CONT`` / pandas default; ``nearest`` = value at
    rank ``round((n - 1) q)`` (Polars default).
    """
    names = list(names or [f"q{int(round(q * 100)):02d}" for q in qs])
    rt = running_totals(vc, value, ["cnt"], by=by, buckets=buckets)
    keys = list(by)
    exprs = _at_ranks(qs, names, method, value)
    return rt.groupBy(*keys).agg(*exprs) if keys else rt.agg(*exprs)


def _at_ranks(qs: Sequence[float], names: Sequence[str], method: str, value: str) -> list[Column]:
    """Aggregates that pick the quantiles from ``(value, cnt, cnt_before, cnt_total)``."""
    start, cnt, n = F.col("cnt_before"), F.col("cnt"), F.col("cnt_total")

    def at_rank(r: Column) -> Column:
        return F.max(F.when((start <= r) & (r < start + cnt), F.col(value)))

    exprs = []
    for q, nm in zip(qs, names):
        pos = (n - 1).cast("double") * F.lit(float(q))
        if method == "nearest":
            exprs.append(at_rank(F.floor(pos + 0.5)).alias(nm))
        else:
            lo, hi = at_rank(F.floor(pos)), at_rank(F.ceil(pos))
            frac = F.max(pos - F.floor(pos))
            exprs.append((lo + frac * (hi - lo)).alias(nm))
    return exprs


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], *, by: Sequence[str] = (),
              method: str = "linear", accuracy: int = 10000) -> DataFrame:
    """Quantiles of several columns as long rows ``(by, feature, q..)``.

    ``method='approx'`` uses ``percentile_approx`` (bounded memory sketch);
    ``linear`` / ``nearest`` are exact and distributed.
    """
    names = [f"q{int(round(q * 100)):02d}" for q in qs]
    if method == "approx":
        long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
            list(by), list(cols), "feature", "value")
        agg = long.groupBy(*by, "feature").agg(
            F.percentile_approx("value", list(qs), accuracy).alias("__q"))
        return agg.select(*by, "feature", *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])
    vc = _bracketed_counts(df, cols, qs, by, accuracy)
    keys = [*by, "feature"]
    order = Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first(), "gap")
    ranked = vc.withColumn("cnt_before", F.coalesce(
        F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "cnt_total", F.sum("cnt").over(Window.partitionBy(*keys))).where("not gap")
    return ranked.groupBy(*keys).agg(*_at_ranks(qs, names, method, "value"))


def _bracketed_counts(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str],
                      accuracy: int) -> DataFrame:
    """``(by, feature, value, gap, cnt)`` with the exact count of every value
    near a wanted quantile; what lies between is one row per stretch (gap).

    A sketch gives, on either side of each quantile, a value that is off by
    at most ``1 / accuracy`` of the rows, so the wanted ranks lie between.
    Groups of at most ``accuracy`` rows keep all their values.  All other
    values meet in a few gap rows before the shuffle.  Without groups a bracket
    that would hold more than ``BRACKET_ROWS`` rows is narrowed first, so what
    is ordered does not grow with the table.
    """
    margin = 2.0 / accuracy
    probs = [max(0.0, q - margin) for q in qs] + [min(1.0, q + margin) for q in qs]
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    stats = [s for i, c in enumerate(cols) for s in (
        F.count(x[c]).alias(f"__n{i}"), F.percentile_approx(x[c], probs, accuracy).alias(f"__p{i}"))]
    wide = df.select(*by, *[x[c].alias(f"__x{i}") for i, c in enumerate(cols)])
    # without groups the brackets are one row, read once and used as constants
    row = None if by else _narrowed(wide, df.agg(*stats).first().asDict(), qs, accuracy)
    # written, the brackets of a few groups are known to be small and meet the
    # rows where they are; dealt by group, the rows of a group would meet in one task
    near = join_null_safe(wide, materialize(df.groupBy(*by).agg(*stats), "brackets"), by) if by else wide

    def placed(i: int) -> Column:
        v = F.col(f"__x{i}")
        if row is None:
            edges = [F.get(f"__p{i}", F.lit(j)) for j in range(2 * len(qs))]
            within = F.col(f"__n{i}") <= accuracy
        else:
            edges = [F.lit(e) for e in row[f"__p{i}"] or [0.0] * (2 * len(qs))]
            within = F.lit(row[f"__n{i}"] <= accuracy)
        lo, hi = edges[:len(qs)], edges[len(qs):]
        for a, b in zip(lo, hi):
            within = within | ((v >= a) & (v <= b))
        passed = [F.when(b < v, b) for b in hi]
        below = F.greatest(*passed) if len(passed) > 1 else passed[0]
        return F.when(v.isNotNull(), F.struct(F.when(within, v).otherwise(below).alias("value"), (~within).alias("gap")))

    long = near.select(*by, *[placed(i).alias(c if c not in by else f"__c{i}") for i, c in enumerate(cols)]).unpivot(
        list(by), [c if c not in by else f"__c{i}" for i, c in enumerate(cols)], "feature", "s")
    for i, c in enumerate(cols):
        if c in by:
            long = long.withColumn("feature", F.when(F.col("feature") == f"__c{i}", c).otherwise(F.col("feature")))
    return long.where("s is not null").groupBy(*by, "feature", F.col("s.value").alias("value"), F.col("s.gap").alias("gap")).agg(
        F.count(F.lit(1)).alias("cnt"))


def _narrowed(wide: DataFrame, row: dict, qs: Sequence[float], accuracy: int) -> dict:
    """``row`` (n, brackets of every column) with brackets of at most
    ``BRACKET_ROWS`` rows or of one value: the rows of a bracket are counted,
    and a sketch of those rows alone gives the next, closer one.  Two scans a
    round, all columns and quantiles at once; each round keeps about
    6 / ``accuracy`` of a bracket."""
    m = len(qs)
    columns = [int(k[3:]) for k in row if k.startswith("__n")]
    open_ = [(i, j) for i in columns for j in range(m)
             if row[f"__n{i}"] > max(accuracy, BRACKET_ROWS * accuracy // 6) and row[f"__p{i}"][j] < row[f"__p{i}"][m + j]]
    while open_:
        edges = {(i, j): (row[f"__p{i}"][j], row[f"__p{i}"][m + j]) for i, j in open_}
        inside = {(i, j): F.col(f"__x{i}").between(lo, hi) for (i, j), (lo, hi) in edges.items()}
        held = wide.agg(*[c for (i, j), (lo, _) in edges.items() for c in (
            F.count_if(F.col(f"__x{i}") < lo).alias(f"b{i}_{j}"), F.count_if(inside[i, j]).alias(f"c{i}_{j}"))]).first()
        open_ = [(i, j) for i, j in open_ if held[f"c{i}_{j}"] > BRACKET_ROWS]
        sketches = []
        for i, j in open_:
            at, rows = (row[f"__n{i}"] - 1) * qs[j] - held[f"b{i}_{j}"], held[f"c{i}_{j}"]
            p, margin = at / rows, 2.0 / accuracy + 1.0 / rows
            sketches.append(F.percentile_approx(F.when(inside[i, j], F.col(f"__x{i}")),
                                                [min(1.0, max(0.0, p - margin)), min(1.0, max(0.0, p + margin))],
                                                accuracy).alias(f"s{i}_{j}"))
        if open_:
            closer = wide.agg(*sketches).first()
            still = []
            for i, j in open_:
                lo, hi = closer[f"s{i}_{j}"]
                if lo < hi and (lo, hi) != edges[i, j]:
                    still.append((i, j))
                row[f"__p{i}"][j], row[f"__p{i}"][m + j] = lo, hi
            open_ = still
    return row


def percent_rank_le(df: DataFrame, col: str, *, by: Sequence[str] = (), out: str = "pct_rank") -> DataFrame:
    """A21 for every row: ``100 * count(x <= v) / count(x)`` (null for null v).

    Distinct values carry their cumulative counts; rows get them back by an
    equi-join on (by, value), which AQE splits if one value is hot.
    """
    vc = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("cnt"))
    rt = running_totals(vc, col, ["cnt"], by=by)
    ranks = rt.select(*by, col, (F.lit(100.0) * (F.col("cnt_before") + F.col("cnt"))
                                 / F.col("cnt_total")).alias(out))
    return join_null_safe(df, ranks, [*by, col], "left")
