"""Data profiling.

Statistics for many columns are produced in *long* form
``(feature, statistic...)`` from one aggregate, instead of one query per
column as the source did.  Quantiles come from the exact distributed
primitive in :mod:`ordered` (or a bounded sketch with ``method='approx'``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import with_scalars
from .ordered import join_null_safe, quantiles


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "feature", "value")


def label_rate(df: DataFrame, label: str) -> DataFrame:
    """Row count, positives and rate of a 0/1 label."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.col(label).cast("long")).alias("n_positive"),
                  F.avg(F.col(label).cast("double")).alias("rate"))


def value_counts(df: DataFrame, col: str, *, top_n: int | None = None,
                 normalize: bool = True, dropna: bool = True) -> DataFrame:
    """Count (and share) per value, most frequent first.

    Nulls are left out of both, as ``pandas.value_counts`` does, unless
    ``dropna`` is off.  The total is a one-row aggregate joined back, not a
    window over all groups.  ``top_n`` keeps the n most frequent (ties by value).
    """
    df = df.where(F.col(col).isNotNull()) if dropna else df
    vc = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.agg(F.count(F.lit(1)).alias("__total"))
        vc = with_scalars(vc, total).withColumn("share", F.col("count") / F.col("__total")).drop("__total")
    vc = vc.orderBy(F.col("count").desc(), F.col(col).asc_nulls_last())
    return vc.limit(top_n) if top_n else vc


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct count of every column, long ``(feature, n_distinct)``."""
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    row = df.agg(*[f(c).cast("long").alias(c) for c in cols])
    return row.unpivot([], list(cols), "feature", "n_distinct")


def describe(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = (),
             method: str = "linear") -> DataFrame:
    """Count, mean, std (sample), min, q25, median, q75, max per
    column, long form (one row per feature and group)."""
    long = _long(df, cols, by)
    moments = long.groupBy(*by, "feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by=by, method=method).withColumnRenamed(
        "q50", "median")
    out = join_null_safe(moments, q, [*by, "feature"], "left")
    return out.select(*by, "feature", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def five_numbers(df: DataFrame, cols: Sequence[str], by: str, method: str = "linear") -> DataFrame:
    """Min, q25, median, q75, max per label and column (box plot).

    Grouping by a two-valued label is an aggregate, never a window, so a
    label holding most rows is still combined map-side.
    """
    d = describe(df, cols, by=[by], method=method)
    return d.select(by, "feature", "min", "q25", "median", "q75", "max")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, *, top_n: int | None = None,
                   only_missing: bool = True) -> DataFrame:
    """Null count and % per column, sorted, optionally >0 only / top n."""
    cols = list(cols or df.columns)
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    miss = lambda c: (F.col(c).isNull() | F.isnan(c)) if c in fl else F.col(c).isNull()
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(miss(c).cast("long")).alias(c) for c in cols])
    long = row.unpivot(["__n"], cols, "feature", "missing_count")
    long = long.withColumn("missing_pct", F.col("missing_count") * 100.0 / F.col("__n")).drop("__n")
    if only_missing:
        long = long.where(F.col("missing_count") > 0)
    long = long.orderBy(F.col("missing_count").desc(), F.col("feature"))
    return long.limit(top_n) if top_n else long


def missing_by_table(tables: Mapping[str, DataFrame], only_missing: bool = True) -> DataFrame:
    """A15 for several tables, with a table column."""
    parts = [missing_report(df, only_missing=only_missing).withColumn("table_name", F.lit(name))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "feature", "missing_count", "missing_pct")


def coverage(base: DataFrame, base_key: str, children: Mapping[str, tuple[DataFrame, str]],
             digits: int = 2) -> DataFrame:
    """Per child table: rows, distinct parents, % of the base covered,
    average rows per covered parent (rounded as the source did)."""
    n_base = base.agg(F.count_distinct(base_key).alias("__base"))
    parts = []
    for name, (df, key) in children.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"),
                            F.count_distinct(key).alias("n_applicants")).withColumn("table_name", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = with_scalars(out, n_base)
    return out.select(
        "table_name", "n_rows", "n_applicants",
        F.round(F.col("n_applicants") * 100.0 / F.col("__base"), digits).alias("pct_of_base"),
        F.round(F.col("n_rows") / F.col("n_applicants"), digits).alias("avg_rows_per_applicant"))


def label_by_flag(df: DataFrame, flag: str, label: str) -> DataFrame:
    """Label mean and count per flag value."""
    return df.groupBy(flag).agg(F.avg(F.col(label).cast("double")).alias("label_mean"),
                                F.count(F.lit(1)).alias("count"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that repeat an earlier row (pandas ``duplicated``)."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def quality_summary(df: DataFrame, label: str | None = None,
                    exclude: Sequence[str] = ()) -> DataFrame:
    """Rows, features, missing cells and %, duplicates, label counts (one row)."""
    feats = [c for c in df.columns if c not in exclude and c != label]
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    miss = [F.sum(((F.col(c).isNull() | F.isnan(c)) if c in fl else F.col(c).isNull()).cast("long"))
            for c in feats]
    total_missing = miss[0]
    for m in miss[1:]:
        total_missing = total_missing + m
    aggs = [F.count(F.lit(1)).alias("n_rows"), total_missing.alias("missing_cells")]
    if label:
        aggs += [F.sum((F.col(label) == 1).cast("long")).alias("n_positive"),
                 F.sum((F.col(label) == 0).cast("long")).alias("n_negative")]
    row = df.agg(*aggs).withColumn("n_features", F.lit(len(feats)))
    row = row.withColumn("missing_pct", F.col("missing_cells") * 100.0 / (F.col("n_rows") * F.lit(len(feats))))
    return with_scalars(row, duplicate_rows(df))
