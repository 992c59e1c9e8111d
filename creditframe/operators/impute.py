"""Imputation (I1-I4) and categorical encoding.

Fitted statistics (medians, modes, code dictionaries) are small tables whose
size is bounded by the schema (one row per column, one row per category), not
by the data; nothing is broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .clean import with_scalars
from .ordered import quantiles, running_totals

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def median_table(df: DataFrame, cols: Sequence[str], method: str = "linear") -> DataFrame:
    """Long ``(feature, median)``; exact distributed unless ``approx``."""
    return quantiles(df, cols, [0.5], method=method).withColumnRenamed("q50", "median")


def fill_median(df: DataFrame, cols: Sequence[str], method: str = "linear") -> DataFrame:
    """Nulls to the column median, as a lazy plan (medians joined as one
    broadcast row).  A column that is entirely null stays null."""
    med = median_table(df, cols, method).groupBy().pivot("feature", list(cols)).agg(F.first("median"))
    med = med.select(*[F.col(c).alias(f"{c}__med") for c in cols])
    out = with_scalars(df, med)
    # the median of integers may lie between them: such columns become double
    kind = {c: T.DoubleType() if isinstance(df.schema[c].dataType, T.IntegralType) else df.schema[c].dataType
            for c in cols}
    out = out.withColumns({c: F.coalesce(F.col(c).cast(kind[c]), F.col(f"{c}__med").cast(kind[c])) for c in cols})
    return out.drop(*[f"{c}__med" for c in cols])


def fit_medians(df: DataFrame, cols: Sequence[str], method: str = "linear") -> dict[str, float]:
    """I2 fitted form: the medians as a dict (one value per column) for scoring."""
    rows = median_table(df, cols, method).collect()
    return {r["feature"]: r["median"] for r in rows}


def apply_fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls from a fitted or constant mapping."""
    vals = {k: v for k, v in values.items() if v is not None and k in df.columns}
    return df.fillna(vals) if vals else df


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long ``(feature, mode)``: most frequent non-null value, lowest on a tie.

    Counts per (feature, value) are combined map-side; the pick is a
    ``min_by`` over that small table, not a window over the data.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value").where(F.col("value").isNotNull())
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return vc.groupBy("feature").agg(
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))


def fill_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Nulls to the column mode; a column with no values gets ``default``."""
    modes = mode_table(df, cols).groupBy().pivot("feature", list(cols)).agg(F.first("mode"))
    present = [c for c in cols if c in modes.columns]
    modes = modes.select(*[F.col(c).alias(f"{c}__mode") for c in present])
    out = with_scalars(df, modes) if present else df
    out = out.withColumns({
        c: F.coalesce(F.col(c).cast("string"),
                      F.col(f"{c}__mode") if c in present else F.lit(None), F.lit(default))
        for c in cols})
    return out.drop(*[f"{c}__mode" for c in present])


def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None,
                  nan_too: bool = True) -> DataFrame:
    """I4: nulls (and NaN in float columns) to a constant such as -999 or 0.0."""
    cols = list(cols or df.columns)
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    exprs = {}
    for c in cols:
        x = F.col(c)
        if nan_too and c in fl:
            x = F.nanvl(x, F.lit(None).cast("double"))
        exprs[c] = F.coalesce(x, F.lit(value).cast(df.schema[c].dataType))
    return df.withColumns(exprs)


def fit_label_codes(df: DataFrame, cols: Sequence[str], null_token: str | None = "missing"
                    ) -> DataFrame:
    """E1 / E2 fitted dictionary ``(feature, value, code)``.

    Codes are 0-based in sorted value order (``LabelEncoder``); null becomes
    ``null_token`` first (E2's ``missing``; ``'nan'`` reproduces encoding
    after ``astype(str)``), or is left unencoded when ``None``.  The table is
    stored with the model so scoring uses the same codes.
    """
    exprs = []
    for c in cols:
        v = F.col(c).cast("string")
        exprs.append(F.coalesce(v, F.lit(null_token)).alias(c) if null_token is not None else v.alias(c))
    long = df.select(*exprs).unpivot([], list(cols), "feature", "value")
    distinct = long.where(F.col("value").isNotNull()).groupBy("feature", "value").count().drop("count")
    # sorted by value: the leading bytes as a number deal values to buckets in
    # order, the value itself decides within
    lead = F.rpad(F.hex(F.substring(F.col("value").cast("binary"), 1, 6)), 12, "0")
    dealt = distinct.withColumns({"__lead": F.conv(lead, 16, 10).cast("long"), "__one": F.lit(1)})
    placed = running_totals(dealt, "__lead", ["__one"], by=["feature"], tiebreak=["value"])
    # every column reads the dictionary, so it is written once
    return materialize(placed.select("feature", "value", F.col("__one_before").cast("double").alias("code")), "label-codes")


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str],
                      null_token: str | None = "missing", unseen: float | None = -1.0) -> DataFrame:
    """Replace each categorical by its code; an unseen value gets
    ``unseen`` (null to keep it missing).

    One left join per column on the value; whether the dictionary is
    broadcast is decided by its size.  A dictionary that lists a value twice
    gives its lowest code.
    """
    fallback = F.lit(unseen).cast("double") if unseen is not None else F.lit(None).cast("double")
    out = df
    for c in cols:
        key = F.col(c).cast("string")
        if null_token is not None:
            key = F.coalesce(key, F.lit(null_token))
        d = codes.where(F.col("feature") == c).groupBy(F.col("value").alias(f"__v_{c}")).agg(
            F.min("code").cast("double").alias(f"__c_{c}"))
        out = out.withColumn(f"__k_{c}", key).join(d, F.col(f"__k_{c}") == F.col(f"__v_{c}"), "left")
        out = out.withColumn(c, F.when(F.col(f"__k_{c}").isNull(), F.lit(None).cast("double"))
                             .otherwise(F.coalesce(F.col(f"__c_{c}"), fallback)))
        out = out.drop(f"__k_{c}", f"__v_{c}", f"__c_{c}")
    return out


def label_encode(df: DataFrame, cols: Sequence[str], null_token: str | None = "missing") -> DataFrame:
    """E1 / E2 in one step (fit on this frame, apply to it)."""
    return apply_label_codes(df, fit_label_codes(df, cols, null_token), cols, null_token)
