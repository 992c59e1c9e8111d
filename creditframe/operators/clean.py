"""Cleaning and range checks.

Population statistics (bounds, shares) are computed by one aggregate and
attached to the rows as a scalar subquery: no join, no row leaves its
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import clip, finite_or_null, sentinel_to_null
from .ordered import quantiles

_K = "__scalars"


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row statistics frame to every row.

    The row is a scalar subquery (one struct, computed once, inlined as a
    value): no join at all, so nothing is shuffled or paired with the data.
    """
    packed = scalars.select(F.struct(*[F.col(f"`{c}`") for c in scalars.columns])).scalar()
    return df.withColumn(_K, packed).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(_K)[c].alias(c) for c in scalars.columns])


def replace_sentinel(df: DataFrame, cols: Sequence[str], sentinel: float = 365243) -> DataFrame:
    """Sentinel value to null in the given columns."""
    return df.withColumns({c: sentinel_to_null(c, sentinel) for c in cols})


def add_age_years(df: DataFrame, days_birth: str = "DAYS_BIRTH", out: str = "AGE_YEARS") -> DataFrame:
    """``-DAYS_BIRTH / 365``."""
    return df.withColumn(out, -F.col(days_birth) / F.lit(365.0))


def percentile_bounds(df: DataFrame, cols: Sequence[str], lower: float, upper: float,
                      method: str = "linear") -> DataFrame:
    """One row ``{c}__lo, {c}__hi`` per column set (exact unless ``approx``)."""
    q = quantiles(df, cols, [lower, upper], method=method)
    lo, hi = q.columns[-2], q.columns[-1]
    return q.groupBy().pivot("feature", list(cols)).agg(
        F.first(lo).alias("lo"), F.first(hi).alias("hi")).select(
        *[F.col(f"{c}_lo").alias(f"{c}__lo") for c in cols],
        *[F.col(f"{c}_hi").alias(f"{c}__hi") for c in cols])


def cap_percentiles(df: DataFrame, cols: Sequence[str], lower: float = 0.01, upper: float = 0.99,
                    method: str = "linear") -> DataFrame:
    """Winsorize each column at its lower / upper percentile.

    ``method``: ``linear`` (pandas), ``nearest`` (Polars default) or
    ``approx`` (bounded-memory sketch).  Nulls stay null.
    """
    bounds = percentile_bounds(df, cols, lower, upper, method)
    out = with_scalars(df, bounds)
    out = out.withColumns({c: clip(c, f"{c}__lo", f"{c}__hi") for c in cols})
    return out.drop(*[f"{c}__lo" for c in cols], *[f"{c}__hi" for c in cols])


def iqr_bounds(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5,
               method: str = "linear") -> DataFrame:
    """Long rows ``(feature, q25, q75, iqr, lower_bound, upper_bound)``."""
    q = quantiles(df, cols, [0.25, 0.75], method=method)
    iqr = F.col("q75") - F.col("q25")
    return q.select("feature", "q25", "q75", iqr.alias("iqr"),
                    (F.col("q25") - F.lit(multiplier) * iqr).alias("lower_bound"),
                    (F.col("q75") + F.lit(multiplier) * iqr).alias("upper_bound"))


def iqr_outliers(df: DataFrame, col: str, multiplier: float = 1.5, method: str = "linear") -> DataFrame:
    """Rows outside ``[q25 - m IQR, q75 + m IQR]``, with both bounds."""
    b = iqr_bounds(df, [col], multiplier, method).select("lower_bound", "upper_bound")
    out = with_scalars(df, b)
    return out.where((F.col(col) < F.col("lower_bound")) | (F.col(col) > F.col("upper_bound")))


def iqr_summary(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5,
                method: str = "linear") -> DataFrame:
    """P5: per column: outlier count, % of all rows, bounds."""
    bounds = iqr_bounds(df, cols, multiplier, method)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    counted = long.join(bounds.select("feature", "lower_bound", "upper_bound"), "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
              .cast("int")).cast("long").alias("n_outliers"))
    return bounds.join(counted, "feature").withColumn(
        "outlier_pct", F.col("n_outliers") * 100.0 / F.col("n_rows")).drop("n_rows")


def infinities_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-inf (and NaN) to null in float columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_null(c) for c in cols})


def count_nonfinite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Totals of infinite, NaN and null cells over float columns (one row)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = [F.sum(F.col(c).isin(float("inf"), float("-inf")).cast("long")) for c in cols]
    nan = [F.sum(F.isnan(c).cast("long")) for c in cols]
    nul = [F.sum(F.col(c).isNull().cast("long")) for c in cols]
    add = lambda xs: F.coalesce(sum(xs[1:], xs[0]), F.lit(0))
    return df.agg(add(inf).alias("n_inf"), add(nan).alias("n_nan"), add(nul).alias("n_null"))


def missing_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One-row null share per column (NaN counted as missing, as pandas does)."""
    cols = list(cols or df.columns)
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    miss = lambda c: (F.col(c).isNull() | F.isnan(c)) if c in fl else F.col(c).isNull()
    return df.agg(*[F.avg(miss(c).cast("double")).alias(c) for c in cols])


def drop_missing_columns(df: DataFrame, threshold: float = 0.5,
                         protect: Sequence[str] = ("SK_ID_CURR", "TARGET")) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share exceeds ``threshold``.

    The shares are one row; the driver reads that row to pick names
    (schema work, not data), then the plan drops them.
    """
    cand = [c for c in df.columns if c not in protect]
    row = missing_shares(df, cand).first().asDict()
    dropped = [c for c in cand if row[c] is not None and row[c] > threshold]
    return df.drop(*dropped), dropped


def drop_constant_columns(df: DataFrame, protect: Sequence[str] = ("SK_ID_CURR", "TARGET")
                          ) -> tuple[DataFrame, list[str]]:
    """P10: drop numeric columns with zero variance (all values equal); a
    column without any value has no variance and stays."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name not in protect]
    if not num:
        return df, []
    row = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in num]).first().asDict()
    dropped = [c for c in num if row[c] is True]
    return df.drop(*dropped), dropped


def days_range_report(df: DataFrame, cols: Sequence[str] | None = None, needle: str = "DAYS") -> DataFrame:
    """Min, max and count of positive values per ``DAYS`` column (long)."""
    cols = list(cols or [c for c in df.columns if needle in c])
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value")
    return long.groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum((F.col("value") > 0).cast("long")).alias("n_positive"))


def out_of_range_counts(df: DataFrame, col: str, low: float = 20, high: float = 70) -> DataFrame:
    """Number of rows below ``low`` and above ``high``."""
    return df.agg(F.count_if(F.col(col) < low).alias("n_below"),
                  F.count_if(F.col(col) > high).alias("n_above"))
