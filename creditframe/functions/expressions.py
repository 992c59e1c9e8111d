"""Column expressions: row features, labels and formats (F, X, P1, P7, B3-B5, B8).

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen; nothing calls back into Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- arithmetic
def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``a / NULLIF(b, 0)``; null instead of an ANSI divide error."""
    return F.try_divide(c(num), c(den))


def plus_div(num: ColumnOrName, den: ColumnOrName, eps: float) -> Column:
    """``a / (b + eps)``; still null-safe when ``b + eps`` is 0."""
    return F.try_divide(c(num), c(den) + F.lit(eps))


def finite_or_null(x: ColumnOrName) -> Column:
    """NaN, +inf and -inf become null."""
    col = c(x)
    return F.when(F.isnan(col) | col.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(col)


def sentinel_to_null(x: ColumnOrName, sentinel: float = 365243) -> Column:
    """A placeholder value (365243 days) becomes null."""
    return F.nullif(c(x), F.lit(sentinel))


def clip(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName) -> Column:
    """Clip that keeps null as null (``greatest(null, lo)`` would give lo)."""
    col = c(x)
    return F.when(col.isNull(), F.lit(None)).otherwise(F.least(F.greatest(col, c(lo)), c(hi)))


# ------------------------------------------------------------ row statistics
def _non_null(cols: Sequence[ColumnOrName]) -> Column:
    return reduce(lambda a, b: a + b, [c(x).isNotNull().cast("int") for x in cols])


def row_sum(cols: Sequence[ColumnOrName]) -> Column:
    """Horizontal sum, null counted as 0 (so the result is never null)."""
    return reduce(lambda a, b: a + b, [F.coalesce(c(x), F.lit(0)) for x in cols])


def row_count_flags(cols: Sequence[ColumnOrName]) -> Column:
    """number of set flags across columns."""
    return row_sum(cols)


def row_max(cols: Sequence[ColumnOrName]) -> Column:
    """Horizontal max, nulls skipped."""
    return F.greatest(*[c(x) for x in cols])


def row_min(cols: Sequence[ColumnOrName]) -> Column:
    """Horizontal min, nulls skipped."""
    return F.least(*[c(x) for x in cols])


def row_mean(cols: Sequence[ColumnOrName], mode: str = "skip") -> Column:
    """F2 mean.  ``skip``: over the non-null values (null if none);
    ``zero``: nulls count as 0 and the divisor is always the column count."""
    if mode == "zero":
        return row_sum(cols) / F.lit(float(len(cols)))
    return F.try_divide(row_sum(cols).cast("double"), _non_null(cols).cast("double"))


def row_std(cols: Sequence[ColumnOrName], mode: str = "skip") -> Column:
    """F2 standard deviation.

    ``skip``: sample deviation over non-null values (null with fewer than two);
    ``zero``: population deviation with nulls as 0 over all columns.
    """
    if mode == "zero":
        mean = row_mean(cols, "zero")
        sq = reduce(lambda a, b: a + b, [F.pow(F.coalesce(c(x), F.lit(0)) - mean, 2) for x in cols])
        return F.sqrt(sq / F.lit(float(len(cols))))
    mean = row_mean(cols, "skip")
    sq = reduce(lambda a, b: a + b,
                [F.coalesce(F.pow(c(x) - mean, 2), F.lit(0.0)) for x in cols])
    n = _non_null(cols)
    return F.when(n >= 2, F.sqrt(sq / (n - 1).cast("double")))


def row_product(cols: Sequence[ColumnOrName]) -> Column:
    """F2 product (null if any input is null)."""
    return reduce(lambda a, b: a * b, [c(x) for x in cols])


# ------------------------------------------------------------------ scoring
def logistic(x: ColumnOrName) -> Column:
    """Expit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def prob_delta(base_logodds: ColumnOrName, contrib_logodds: ColumnOrName) -> Column:
    """Probability change ``expit(base + s) - expit(base)``."""
    return logistic(c(base_logodds) + c(contrib_logodds)) - logistic(base_logodds)


def risk_class(p: ColumnOrName, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """1 at or above the threshold (``inclusive``) or strictly above it."""
    col = c(p)
    cond = col >= F.lit(threshold) if inclusive else col > F.lit(threshold)
    return F.when(col.isNull(), F.lit(None)).otherwise(cond.cast("int"))


# --- fixed values: band edges and names ---------------------------------
# LOW < 0.15 <= MEDIUM < 0.30 <= HIGH < 0.50 <= CRITICAL
# Low < 0.3 <= Medium < 0.6 <= High (also accepted on a 0-100 scale)
def risk_band4(p: ColumnOrName) -> Column:
    col = c(p)
    return (F.when(col.isNull(), F.lit(None))
            .when(col < 0.15, "LOW").when(col < 0.30, "MEDIUM")
            .when(col < 0.50, "HIGH").otherwise("CRITICAL"))


def risk_band3(p: ColumnOrName, percent_scale: bool = False) -> Column:
    """B5; with ``percent_scale`` a score above 1 is read as already in 0-100."""
    col = c(p)
    if percent_scale:
        col = F.when(col > 1, col / 100.0).otherwise(col)
    return (F.when(col.isNull(), F.lit(None))
            .when(col < 0.3, "Low").when(col < 0.6, "Medium").otherwise("High"))


def stub_score(values: ColumnOrName) -> Column:
    """Model-free fallback over an array (or map values) of doubles.

    ``clip(0.5 + 0.5 * clip(mean(v) / (mean(|v|) + 1e-6), -1, 1), 0, 1)``,
    0.5 for an empty input.  Higher-order functions, no Python.
    """
    arr = F.filter(c(values), lambda x: x.isNotNull())   # missing entries are skipped
    n = F.size(arr)
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    sa = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    ratio = (s / n) / (sa / n + F.lit(1e-6))
    inner = F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))
    prob = F.least(F.greatest(F.lit(0.5) + F.lit(0.5) * inner, F.lit(0.0)), F.lit(1.0))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0.5)).otherwise(prob)


# ------------------------------------------------------------- text labels
def pretty_name(name: ColumnOrName) -> Column:
    """``A_B_C`` -> ``A B C`` in title case."""
    return F.initcap(F.regexp_replace(c(name), "_", " "))


def compact_number(x: ColumnOrName) -> Column:
    """1.2K / 3.4M / 5.6B with one decimal; below 1000 whole numbers
    have no decimals and others two."""
    v = c(x)
    a = F.abs(v)
    return (F.when(v.isNull(), F.lit("0"))
            .when(a >= 1e9, F.concat(F.format_string("%.1f", v / 1e9), F.lit("B")))
            .when(a >= 1e6, F.concat(F.format_string("%.1f", v / 1e6), F.lit("M")))
            .when(a >= 1e3, F.concat(F.format_string("%.1f", v / 1e3), F.lit("K")))
            .when(v == F.floor(v), F.format_string("%.0f", v))
            .otherwise(F.format_string("%.2f", v)))


def bin_label(start: ColumnOrName) -> Column:
    """A22 label: ``12K`` at 1000 and over, else the whole number; halves
    round to even as Python's ``format(x, '.0f')`` does."""
    s = c(start)
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    return F.when(s >= 1000, F.concat(whole(s / 1000.0), F.lit("K"))).otherwise(whole(s))


def format_ts(ts: ColumnOrName, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp as text (session time zone is UTC)."""
    return F.date_format(c(ts), fmt)


def skew_label(mean: ColumnOrName, median: ColumnOrName) -> Column:
    """Mean above 1.1 x median -> right, below 0.9 x median -> left."""
    m, md = c(mean), c(median)
    return (F.when(m > md * 1.1, "right-skewed")
            .when(m < md * 0.9, "left-skewed")
            .otherwise("approximately symmetric"))


def corr_strength(r: ColumnOrName) -> Column:
    """|r| > 0.7 strong, > 0.4 moderate, else weak."""
    a = F.abs(c(r))
    return F.when(a > 0.7, "strong").when(a > 0.4, "moderate").otherwise("weak")


def corr_direction(r: ColumnOrName) -> Column:
    return F.when(c(r) > 0, "positive").otherwise("negative")


def impact_strength(impact: ColumnOrName) -> Column:
    """X11: probability impact in points: > 10 strong, > 5 moderate, else slight."""
    pts = F.abs(c(impact)) * 100
    return F.when(pts > 10, "strong").when(pts > 5, "moderate").otherwise("slight")


def impact_direction(impact: ColumnOrName) -> Column:
    return F.when(c(impact) > 0, "increases_risk").otherwise("decreases_risk")


# --- fixed values: feature-name categories, first match wins -------------
FEATURE_CATEGORY_RULES = (
    (("EXT_SOURCE",), "External Sources"),
    (("BUREAU",), "Bureau"),
    (("PREV",), "Previous Applications"),
    (("CREDIT",), "Credit"),
    (("AMT_",), "Amounts"),
    (("DAYS_",), "Days/Time"),
    (("CNT_", "FLAG_"), "Counts/Flags"),
)


def feature_category(name: ColumnOrName) -> Column:
    """Category of a feature from substrings of its name."""
    n = c(name)
    expr = None
    for needles, label in FEATURE_CATEGORY_RULES:
        cond = reduce(lambda a, b: a | b, [n.contains(s) for s in needles])
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("Other")


def round_all(df, digits: int = 6, skip: Sequence[str] = ()):
    """Round every float column (oracle hygiene: summation order differs)."""
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip:
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
