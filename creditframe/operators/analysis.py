"""Population analysis and chart-data shaping.

Every statistic for every requested feature comes out of one aggregate (the
source ran one SQL query per feature or per pair).  Chart shapes are plain
DataFrames: one row per bar / bin / step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (bin_label, clip, corr_direction, corr_strength, feature_category, risk_band4,
                                     risk_class, safe_div, skew_label)
from .clean import with_scalars
from .explain import contributions, explain, explanation_text
from .ordered import percent_rank_le, quantiles, running_totals
from .profile import _long, describe


# ------------------------------------------------------------ group stats
def group_stats(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Mean and sample std per group and feature (long)."""
    return _long(df, cols, [by]).groupBy(by, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count("value").alias("count"))


def percentile_of_value(df: DataFrame, col: str, value: float) -> DataFrame:
    """A21 for one value: ``100 * count(x <= v) / count(x)`` (one row)."""
    x = F.col(col)
    return df.where(x.isNotNull()).agg(
        (F.lit(100.0) * F.sum((x <= F.lit(value)).cast("long")) / F.count(x)).alias("percentile"))


# --- fixed values: default fields of an applicant lookup ------------------
PROFILE_FIELDS = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED",
                  "EXT_SOURCE_2", "EXT_SOURCE_3", "CODE_GENDER")


def applicant_profile(df: DataFrame, key: str, ids: DataFrame, fields: Sequence[str] | None = None,
                      label: str | None = "TARGET") -> DataFrame:
    """Rows of the given applicants with chosen fields, plus whole
    years of age and of employment (``floor(|days| / 365)``; positive
    employment days, the not-employed sentinel, give 0).  A semi-join, so
    any number of ids is one distributed lookup."""
    fields = list(fields or [f for f in PROFILE_FIELDS if f in df.columns])
    cols = [key, *fields] + ([label] if label and label in df.columns else [])
    out = df.join(ids.select(key).distinct(), key, "left_semi").select(*cols)
    if "DAYS_BIRTH" in fields:
        out = out.withColumn("age_years", F.floor(F.abs(F.col("DAYS_BIRTH")) / 365))
    if "DAYS_EMPLOYED" in fields:
        d = F.col("DAYS_EMPLOYED")
        out = out.withColumn("employment_years", F.when(d < 0, F.floor(F.abs(d) / 365)).otherwise(F.lit(0)))
    return out


def valid_range(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Non-null rows within ``[lo, hi]`` (pushed to the scan as filters)."""
    cond = F.col(col).isNotNull()
    if lo is not None:
        cond &= F.col(col) >= lo
    if hi is not None:
        cond &= F.col(col) <= hi
    return df.where(cond)


# ------------------------------------------------------------- histograms
def histogram_iqr(df: DataFrame, cols: Sequence[str], bins: int = 20, *,
                  keep_top_edge: bool = False, method: str = "linear", digits: int = 2) -> DataFrame:
    """Equal bins over ``[max(min, q25 - 1.5 IQR), min(max, q75 + 1.5 IQR)]``.

    Rows ``(feature, bin, range_start, range_end, count, label)``; empty bins
    are 0.  The bucket is ``floor((x - lo) / (hi - lo) * bins) + 1`` as
    ``width_bucket``; a value equal to ``hi`` falls in bucket ``bins + 1`` and
    is dropped like the source's query did, unless ``keep_top_edge``.
    """
    long = _long(df, cols)
    stats = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    q = quantiles(df, cols, [0.25, 0.75], method=method)
    st = stats.join(q, "feature")
    iqr = F.col("q75") - F.col("q25")
    st = st.select("feature",
                   F.when(F.col("q25").isNotNull(), F.greatest(F.col("mn"), F.col("q25") - 1.5 * iqr))
                   .otherwise(F.col("mn")).alias("lo"),
                   F.when(F.col("q75").isNotNull(), F.least(F.col("mx"), F.col("q75") + 1.5 * iqr))
                   .otherwise(F.col("mx")).alias("hi")).where(F.col("hi") > F.col("lo"))
    return _binned(long, st, bins, keep_top_edge, digits)


def histogram_minmax(df: DataFrame, cols: Sequence[str], bins: int = 20, digits: int = 2) -> DataFrame:
    """Equal bins over the raw min / max with the last bin closed."""
    long = _long(df, cols)
    st = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")) \
        .where(F.col("hi") >= F.col("lo"))
    return _binned(long, st, bins, keep_top_edge=True, digits=digits)


def _binned(long: DataFrame, st: DataFrame, bins: int, keep_top_edge: bool, digits: int = 2) -> DataFrame:
    x, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    raw = F.when(hi > lo, F.floor((x - lo) / (hi - lo) * F.lit(bins)) + 1).otherwise(F.lit(1))
    bucket = F.least(raw, F.lit(bins)) if keep_top_edge else raw
    counted = (long.join(st, "feature")
               .where(x.isNotNull() & (x >= lo) & (x <= hi))
               .select("feature", bucket.cast("int").alias("bin"))
               .where(F.col("bin").between(1, bins))
               .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = st.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    start = F.col("lo") + (F.col("bin") - 1) * width
    end = F.col("lo") + F.col("bin") * width
    return (grid.join(counted, ["feature", "bin"], "left")
            .select("feature", "bin", F.round(start, digits).alias("range_start"),
                    F.round(end, digits).alias("range_end"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    bin_label(start).alias("label")))


# ------------------------------------------------------------ correlation
def pair_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are non-null; null
    (not an ANSI divide error) when either side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """A24 for a list of pairs, long ``(feature_x, feature_y, corr)``; one pass."""
    row = df.agg(*[pair_corr(a, b).alias(f"__c{i}") for i, (a, b) in enumerate(pairs)])
    stack = F.array(*[F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                               F.col(f"__c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(stack).alias("s")).select("s.*")


def correlation_matrix(df: DataFrame, cols: Sequence[str], *, digits: int = 3,
                       missing_as_zero: bool = True) -> DataFrame:
    """Full long matrix ``(feature_x, feature_y, corr)``, rounded,
    diagonal 1, undefined pairs 0.

    Pairwise-complete moments of all pairs come from one pass: every task
    folds its Arrow batches into k x k numpy sums (values centred on pilot
    means for stability) and emits one row per pair; Spark adds the partial
    sums.  Output per task is bounded by the number of pairs, not by rows.
    """
    cols = list(cols)
    k = len(cols)
    pilot = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    shift = np.array([0.0 if pilot[c] is None else float(pilot[c]) for c in cols])
    names = cols

    def fold(batches):
        n = np.zeros((k, k)); sx = np.zeros((k, k)); sxx = np.zeros((k, k)); sxy = np.zeros((k, k))
        for pdf in batches:
            v = pdf[names].to_numpy(dtype="float64") - shift
            m = (~np.isnan(v)).astype("float64")
            x = np.nan_to_num(v)
            n += m.T @ m
            sx += (x.T @ m)              # sx[i, j] = sum over rows with both of x_i
            sxx += ((x * x).T @ m)
            sxy += x.T @ x
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j],
                            "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i],
                            "sxy": sxy[i, j]})

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    parts = src.mapInPandas(fold, schema)
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    r = clip(r, F.lit(-1.0), F.lit(1.0))      # null-safe: an undefined r stays undefined
    if missing_as_zero:
        r = F.coalesce(r, F.lit(0.0))
    name_map = F.array(*[F.lit(c) for c in cols])
    upper = s.select(name_map[F.col("i")].alias("feature_x"), name_map[F.col("j")].alias("feature_y"),
                     F.round(r, digits).alias("corr"))
    lower = upper.select(F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y"), "corr")
    spark = df.sparkSession
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "feature_x string, feature_y string, corr double")
    return upper.unionByName(lower).unionByName(diag)


def correlation_with_label(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Correlation of each feature with the label, strongest first."""
    row = df.agg(*[pair_corr(c, label).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "feature", "corr")
    return long.orderBy(F.abs("corr").desc_nulls_last(), "feature")


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.95
                    ) -> tuple[DataFrame, list[str]]:
    """A column goes if any *earlier* column (in ``cols`` order, dropped
    or not) correlates above ``threshold`` in absolute value."""
    cols = list(cols)
    pos = {c: i for i, c in enumerate(cols)}
    m = correlation_matrix(df, cols, digits=12, missing_as_zero=False)
    order = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    hits = m.where((order[F.col("feature_x")] < order[F.col("feature_y")])
                   & (F.abs("corr") > threshold)).select("feature_y").distinct()
    dropped = sorted((r[0] for r in hits.collect()), key=pos.get)
    return df.drop(*dropped), dropped


# ------------------------------------------------------------ reports
def report_vs_population(df: DataFrame, key: str, ids: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The applicants' values against population means
    (``value / mean * 100``, 1 decimal, above / below)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], list(cols), "feature", "pop_mean")
    vals = df.join(ids.select(key).distinct(), key, "inner").select(
        key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], list(cols), "feature", "value")
    pct = F.round(safe_div(F.col("value"), F.col("pop_mean")) * 100, 1)
    return vals.join(means, "feature").select(
        key, "feature", "value", "pop_mean", pct.alias("pct_of_avg"),
        F.when(pct > 100, "above").when(pct.isNotNull(), "below").alias("position"))


# --- fixed values: report types and the charts they recommend --------------
REPORT_TYPES = ("summary", "detailed", "risk_focused")
REPORT_CHARTS = ("gauge", "feature_importance", "radar")


def applicant_report(df: DataFrame, key: str, ids: DataFrame, cols: Sequence[str], *, report_type: str = "summary",
                     model=None, features: Sequence[str] | None = None, top_n: int = 5) -> DataFrame:
    """One row per applicant in ``ids`` that ``df`` holds: ``comparison``
    (array of feature, value, population mean, % of it, above / below, in
    the order of ``cols``) and the recommended charts.  ``detailed`` and
    ``risk_focused`` add the model's probability, class and band, the
    ``top_n`` contributions (M11) and their sentence; a linear model is
    compared with the means of all of ``df``.

    The population costs one aggregate; applicants are a semi-join, so one id
    and all ids are the same plan.  Rows that repeat a key give a row each.
    A null value is neither above nor below.
    """
    if report_type not in REPORT_TYPES:
        raise ValueError(f"unknown report type {report_type!r}; one of {REPORT_TYPES}")
    if report_type != "summary" and model is None:
        raise ValueError(f"a {report_type} report needs a model")
    feats = list(features or cols) if report_type != "summary" else []
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"__m{i}") for i, c in enumerate(cols)])
    mine = df.join(ids.select(key).distinct(), key, "left_semi")

    def compared(i, c):
        value, mean = F.col(f"`{c}`").cast("double"), F.col(f"__m{i}")
        pct = F.round(safe_div(value, mean) * 100, 1)
        return F.struct(F.lit(c).alias("feature"), value.alias("value"), mean.alias("pop_mean"), pct.alias("pct_of_avg"),
                        F.when(pct > 100, "above").when(pct.isNotNull(), "below").alias("position"))

    out = with_scalars(mine, means).select(
        key, F.array(*[compared(i, c) for i, c in enumerate(cols)]).alias("comparison"),
        F.array(*[F.lit(c) for c in REPORT_CHARTS]).alias("recommended_charts"), *feats)
    if report_type == "summary":
        return out
    head = [key, "comparison", "recommended_charts"]
    background = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first()
    told = explanation_text(explain(contributions(model, out, feats, keep=head, means={f: background[f] or 0.0 for f in feats}),
                                    feats, keep=head, top_n=top_n), top_n)
    return told.select(*head, "base_probability", "probability", risk_class("probability").alias("prediction"),
                       risk_band4("probability").alias("risk_category"), "top_contributions", "explanation")


def importance_by_category(importance: DataFrame, feature: str = "feature",
                           value: str = "importance") -> DataFrame:
    """Summed importance and share per name-derived category."""
    cat = importance.withColumn("category", feature_category(F.col(feature)))
    g = cat.groupBy("category").agg(F.sum(value).alias("importance"),
                                    F.count(F.lit(1)).alias("n_features"))
    total = importance.agg(F.sum(value).alias("__t"))
    return with_scalars(g, total).withColumn("pct", F.col("importance") * 100.0 / F.col("__t")).drop("__t")


def count_by_prefix(names: DataFrame, feature: str = "feature", sep: str = "_") -> DataFrame:
    """Number of features per name prefix (text before the first ``sep``)."""
    return names.groupBy(F.substring_index(F.col(feature), sep, 1).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n_features"))


# ------------------------------------------------------------ shaping
def top_n_by_abs(df: DataFrame, value: str, n: int, name: str = "feature") -> DataFrame:
    """O2: n rows with the largest absolute value (ties by name)."""
    return df.orderBy(F.abs(value).desc(), F.col(name)).limit(n)


def repeatable_sample(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """O3: ``ORDER BY random() LIMIT n`` made repeatable: order by a seeded
    hash of the key (a top-n per task, then a merge of n rows per task)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def union_with_flag(a: DataFrame, b: DataFrame, flag: str = "is_train") -> DataFrame:
    """Rows of both on their common columns, with an origin flag (1 for ``a``)."""
    common = [c for c in a.columns if c in set(b.columns)]
    return (a.select(*common).withColumn(flag, F.lit(1))
            .unionByName(b.select(*common).withColumn(flag, F.lit(0))))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, index: str, series: str, value: str,
            series_values: Sequence | None = None) -> DataFrame:
    """Long to wide; pass ``series_values`` to skip the distinct pass."""
    g = df.groupBy(index)
    g = g.pivot(series, list(series_values)) if series_values is not None else g.pivot(series)
    return g.agg(F.first(value))


def trend(df: DataFrame, ts: str, value: str, unit: str = "day", series: str | None = None,
          agg: str = "sum") -> DataFrame:
    """Measure per time period (and series)."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[agg]
    keys = [F.date_trunc(unit, F.col(ts)).alias("period")] + ([F.col(series)] if series else [])
    return df.groupBy(*keys).agg(fn(value).alias(value if agg != "count" else "count"))


def share_of_total(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Each row's value as % of the column total (total joined as one row)."""
    total = df.agg(F.sum(value).alias("__total"))
    return with_scalars(df, total).withColumn(out, safe_div(F.col(value) * 100.0, F.col("__total"))) \
        .drop("__total")


def composition(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Measure per category as part of the whole."""
    agg = F.sum(value).alias("value") if value else F.count(F.lit(1)).alias("value")
    return share_of_total(df.groupBy(category).agg(agg), "value")


def cumulative_share(df: DataFrame, value: str, *, order_desc: bool = True,
                     out: str = "cumulative_share") -> DataFrame:
    """Running ``cumsum / sum`` in value order (largest first by default).

    Uses the bucketed running total, so it stays distributed on any size.
    Rows with equal values follow their other columns, so ties have one order.
    """
    rt = running_totals(df, value, [value], descending=order_desc, tiebreak=[c for c in df.columns if c != value])
    return rt.withColumn(out, (F.col(f"{value}_before") + F.col(value)) / F.col(f"{value}_total")) \
        .drop(f"{value}_before", f"{value}_total")


def waterfall(df: DataFrame, step_order: str, value: str) -> DataFrame:
    """Start / end of each signed step as a running total."""
    rt = running_totals(df, step_order, [value])
    return rt.withColumn("start", F.col(f"{value}_before")) \
        .withColumn("end", F.col(f"{value}_before") + F.col(value)) \
        .drop(f"{value}_before", f"{value}_total")


def funnel(df: DataFrame, step_order: str, value: str, out: str = "pct_of_first") -> DataFrame:
    """Each step as % of the first step's value."""
    first = df.agg(F.min_by(value, step_order).alias("__first"))
    return with_scalars(df, first).withColumn(out, safe_div(F.col(value) * 100.0, F.col("__first"))) \
        .drop("__first")


def correlation_insight(r: Column) -> Column:
    """X10 sentence fragment: ``0.812 (strong positive)``."""
    return F.format_string("%.3f (%s %s)", r, corr_strength(r), corr_direction(r))


# --- fixed values: analysis types and the charts that fit each, first choice first
CHARTS = {"distribution": ("histogram", "box_plot", "violin"), "comparison": ("bar", "grouped_bar", "radar"),
          "correlation": ("scatter", "heatmap"), "trend": ("line", "area"),
          "composition": ("pie", "stacked_bar", "waterfall"),
          "risk_breakdown": ("gauge", "waterfall", "feature_importance"),
          "percentile": ("bullet", "bar_with_marker"), "population_comparison": ("bar",)}
ANALYSIS_TYPES = tuple(CHARTS)


def chart_choice(analysis_type: str, n_features: int, *, grouped: bool = False) -> dict[str, str | list[str]]:
    """The chart an analysis is drawn as and the alternatives beside it."""
    kinds = CHARTS[analysis_type]
    chosen = kinds[0]
    if analysis_type == "comparison" and (grouped or n_features > 1):
        chosen = "grouped_bar"
    elif analysis_type == "correlation" and n_features > 2:
        chosen = "heatmap"
    elif analysis_type == "risk_breakdown":
        chosen = "feature_importance"
    return {"chart_type": chosen, "alternatives": [k for k in kinds if k != chosen]}


def per_feature(parts: dict[str, DataFrame]) -> DataFrame:
    """One frame of several features' chart rows, with a ``feature`` column."""
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("feature"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def analyze(analysis_type: str, df: DataFrame, features: Sequence[str], *, label: str = "TARGET",
            compare_groups: str | None = None, ts: str | None = None, key: str | None = None,
            applicants: DataFrame | None = None, model=None) -> dict[str, DataFrame]:
    """Analysis dispatch: a type picks the statistics (all features in one
    aggregate) and the chart data; :func:`chart_choice` names the chart.

    Every requested feature is analysed.  ``correlation`` needs two features
    or more; of exactly two it also draws a repeatable sample of 200 points
    (with ``key``).  ``risk_breakdown`` explains the rows of ``applicants`` (a
    frame with ``key``) by ``model``; its chart has one row per applicant and
    factor, strongest first.  ``percentile`` places every value of the
    applicants among all non-null values.  An id that ``df`` lacks has no row.
    """
    feats = list(features)
    if analysis_type in ("risk_breakdown", "percentile") and (key is None or applicants is None):
        raise ValueError(f"{analysis_type} needs applicants and their key")
    if analysis_type == "distribution":
        if compare_groups:
            stats = group_stats(df, feats, compare_groups)
        else:
            stats = describe(df, feats).withColumn("insight", skew_label("mean", "median"))
        return {"statistics": stats, "chart_data": histogram_iqr(df, feats)}
    if analysis_type == "comparison":
        return {"statistics": group_stats(df, feats, compare_groups or label)}
    if analysis_type == "correlation":
        if len(feats) < 2:
            raise ValueError("correlation needs two features or more")
        matrix = correlation_matrix(df, feats).withColumn("insight", correlation_insight(F.col("corr")))
        if len(feats) > 2 or key is None:
            return {"statistics": matrix}
        x, y = (F.col(f"`{f}`") for f in feats)
        points = repeatable_sample(df.where(x.isNotNull() & y.isNotNull()), key)
        return {"statistics": matrix, "chart_data": points.select(key, x.alias("x"), y.alias("y"))}
    if analysis_type == "trend":
        return {"chart_data": per_feature({f: trend(df, ts, f, series=compare_groups).withColumnRenamed(f, "value")
                                           for f in feats})}
    if analysis_type == "composition":
        return {"chart_data": per_feature({f: composition(df.withColumn(f, F.col(f).cast("string")), f)
                                           .withColumnRenamed(f, "category") for f in feats})}
    if analysis_type == "risk_breakdown":
        if model is None:
            raise ValueError("risk_breakdown needs a model")
        rows = df.join(applicants.select(key).distinct(), key, "left_semi")
        means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first()
        told = explanation_text(explain(contributions(
            model, rows, feats, keep=[key], means={f: means[f] or 0.0 for f in feats}), feats, keep=[key], top_n=len(feats)))
        factors = told.select(key, F.posexplode("top_contributions").alias("place", "c"))
        return {"statistics": told, "chart_data": factors.select(
            key, (F.col("place") + 1).alias("rank"), "c.feature", "c.value", "c.impact", "c.impact_logodds",
            F.when(F.col("c.impact") > 0, "increases risk").otherwise("decreases risk").alias("direction"))}
    if analysis_type == "percentile":
        wide = df.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in feats])
        long = _long(wide, feats, [key]).where("value is not null")
        ranked = percent_rank_le(long, "value", by=["feature"], out="percentile")
        return {"statistics": ranked.join(applicants.select(key).distinct(), key, "left_semi")}
    if analysis_type == "population_comparison":
        return {"statistics": correlation_with_label(df, feats, label)}
    raise ValueError(f"unknown analysis type {analysis_type!r}; one of {ANALYSIS_TYPES}")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("np", "pd")]
