"""Ordered history per parent: first-N / last-N means.

``row_number`` over ``partitionBy(key)`` followed by ``rn <= N`` lets Spark
insert a partial WindowGroupLimit *before* the shuffle: each map task keeps
at most N rows per key, so a key holding a third of all rows ships only
N rows per map task instead of its whole history to one reducer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order_col: str, tie_col: str, newest_first: bool) -> list[Column]:
    # PostgreSQL order: DESC puts nulls first, ASC puts them last; the tie
    # column makes the order total so results do not depend on partitioning.
    if newest_first:
        return [F.col(order_col).desc_nulls_first(), F.col(tie_col).desc()]
    return [F.col(order_col).asc_nulls_last(), F.col(tie_col).asc()]


def ranked(df: DataFrame, key: str, order_col: str, tie_col: str, *, newest_first: bool,
           name: str = "rn") -> DataFrame:
    """1-based position within the key, newest-first or oldest-first."""
    w = Window.partitionBy(key).orderBy(*_order(order_col, tie_col, newest_first))
    return df.withColumn(name, F.row_number().over(w))


def window_means(df: DataFrame, key: str, order_col: str, tie_col: str, *,
                 newest_first: bool, specs: Mapping[int, Sequence[str]],
                 names: Mapping[tuple[int, str], str] | None = None) -> DataFrame:
    """Mean of each column over the first N rows of every key.

    ``specs`` maps N to the columns averaged over it; a 0/1 flag column gives
    the rate over the last N (W3).  A key with fewer than N rows averages what
    it has; null values are skipped as ``AVG`` does.
    """
    names = dict(names or {})
    top = max(specs)
    r = ranked(df, key, order_col, tie_col, newest_first=newest_first)
    r = r.where(F.col("rn") <= top)
    side = "LAST" if newest_first else "FIRST"
    exprs = []
    for n, cols in sorted(specs.items()):
        for col in cols:
            alias = names.get((n, col), f"{side}{n}_{col}".upper())
            exprs.append(F.avg(F.when(F.col("rn") <= n, F.col(col).cast("double"))).alias(alias))
    return r.groupBy(key).agg(*exprs)


def first_last_means(df: DataFrame, key: str, order_col: str, tie_col: str, *,
                     last: Mapping[int, Sequence[str]] | None = None,
                     first: Mapping[int, Sequence[str]] | None = None,
                     names: Mapping[tuple[str, int, str], str] | None = None) -> DataFrame:
    """Last-N and first-N means for one key, as one row per key."""
    names = dict(names or {})
    parts = []
    if last:
        parts.append(window_means(df, key, order_col, tie_col, newest_first=True, specs=last,
                                  names={(n, c): v for (s, n, c), v in names.items() if s == "last"}))
    if first:
        parts.append(window_means(df, key, order_col, tie_col, newest_first=False, specs=first,
                                  names={(n, c): v for (s, n, c), v in names.items() if s == "first"}))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on=key, how="full")
    return out
