"""Batch scoring.

Requests are DataFrames: either wide feature columns or a
``map<string,double>`` column as the JSON payloads were.  Scoring is
``model.transform`` on an assembled vector, one pass, any number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import risk_band3, risk_band4, risk_class, stub_score
from .explain import contributions, explain, explanation_text
from .store import FeatureView, lookup


def project_features(df: DataFrame, names: Sequence[str], *, map_col: str | None = None,
                     fill: float = 0.0, fill_values: Mapping[str, float] | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """The model's features in model order; an absent name (or a null /
    NaN value) gets ``fill`` or its entry in ``fill_values`` (medians)."""
    fill_values = dict(fill_values or {})
    cols = set(df.columns)
    out = []
    for n in names:
        if map_col is not None:
            v = F.col(map_col)[F.lit(n)]
        elif n in cols:
            v = F.col(n).cast("double")
        else:
            v = F.lit(None).cast("double")
        v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
        out.append(F.coalesce(v, F.lit(float(fill_values.get(n, fill)))).alias(n))
    return df.select(*keep, *out)


def validate_features(df: DataFrame, map_col: str, required: Sequence[str],
                      important: Sequence[str] = ()) -> DataFrame:
    """Per request, the missing and unexpected names and the missing
    important ones; ``valid`` is true when nothing required is missing."""
    req = F.array(*[F.lit(n) for n in required])
    keys = F.map_keys(F.col(map_col))
    missing = F.array_except(req, keys)
    imp = F.array(*[F.lit(n) for n in important]) if important else F.array().cast("array<string>")
    return df.withColumns({
        "missing_features": missing,
        "extra_features": F.array_except(keys, req),
        "missing_important": F.array_intersect(imp, missing),
        "valid": F.size(missing) == 0,
    })


def assemble(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="keep").transform(df)


def _model_input(model, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pipelines built by :mod:`ml` assemble their own vector; bare models
    get one assembled here."""
    stages = getattr(model, "stages", None)
    if stages and isinstance(stages[0], VectorAssembler):
        return df
    return assemble(df, names)


def positive_probability(prob_col: str = "probability") -> Column:
    """Probability of class 1 from a Spark ML probability vector."""
    return vector_to_array(F.col(prob_col))[1]


def score(model, df: DataFrame, names: Sequence[str], *, keep: Sequence[str] = (),
          map_col: str | None = None, fill: float = 0.0, fill_values: Mapping[str, float] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """Probability, class at ``threshold`` (inclusive) and the
    four-level band for every row."""
    x = project_features(df, names, map_col=map_col, fill=fill, fill_values=fill_values, keep=keep)
    scored = model.transform(_model_input(model, x, names))
    p = positive_probability()
    return scored.select(*keep, p.alias("probability")).withColumns({
        "prediction": risk_class("probability", threshold),
        "risk_category": risk_band4("probability"),
    })


def score_by_id(model, snapshot: DataFrame, ids: DataFrame, view: FeatureView, *, now,
                names: Sequence[str] | None = None) -> DataFrame:
    """B2: score applicants by key; an id without a live feature row is kept
    with ``status = 'not_found'`` and no probability."""
    names = list(names or view.feature_names)
    feats = lookup(snapshot, ids, view, now=now, features=names, fill=0.0)
    scored = score(model, feats, names, keep=[*view.keys, "found"])
    return scored.withColumns({
        "status": F.when(F.col("found"), "ok").otherwise("not_found"),
        "probability": F.when(F.col("found"), F.col("probability")),
        "prediction": F.when(F.col("found"), F.col("prediction")),
        "risk_category": F.when(F.col("found"), F.col("risk_category")),
    }).drop("found")


def what_if(model, scenarios: DataFrame, names: Sequence[str], *, medians: Mapping[str, float] | None = None,
            features_col: str = "features_map", name_col: str = "name",
            median_flag: str = "fill_missing_with_median", explained: bool = False, top_n: int = 5,
            means: Mapping[str, float] | None = None) -> DataFrame:
    """Score scenario rows given as maps; absent features are 0.0, or the
    population median when the row's flag asks for it (the source accepted
    the flag but ignored it; here it is honoured).  Reports how many values
    were given and how many were filled.

    ``explained`` adds the scenario's own explanation (M11, M12): the ``top_n``
    contributions as rank, feature, filled-in value and impact, the base
    probability and a sentence, over the values that were scored.  A linear
    model is compared with ``means`` (default: the scenarios' own).  Names need not be unique.
    """
    medians = dict(medians or {})
    given = F.size(F.map_keys(F.col(features_col)))
    n_required = len(names)
    provided_known = F.size(F.array_intersect(F.map_keys(F.col(features_col)),
                                              F.array(*[F.lit(n) for n in names])))
    exprs = []
    for n in names:
        v = F.col(features_col)[F.lit(n)].cast("double")
        fallback = F.when(F.col(median_flag), F.lit(float(medians.get(n, 0.0)))).otherwise(F.lit(0.0)) \
            if median_flag in scenarios.columns else F.lit(0.0)
        exprs.append(F.coalesce(v, fallback).alias(n))
    x = scenarios.select(name_col, given.alias("n_provided"),
                         (F.lit(n_required) - provided_known).alias("n_filled"), *exprs)
    scored = model.transform(_model_input(model, x, names))
    p = positive_probability()
    out = ["probability", "prediction", "risk_level"]
    classes = {"probability": p, "prediction": F.when(p > 0.5, "High Risk").otherwise("Low Risk"), "risk_level": risk_band3(p)}
    if not explained:
        return scored.select(name_col, "n_provided", "n_filled", *[classes[c].alias(c) for c in out])
    # the scores ride along through the explanation: no join by name
    head = [name_col, "n_provided", "n_filled", *out]
    rows = scored.select(name_col, "n_provided", "n_filled", *[classes[c].alias(c) for c in out], *names)
    parts = explanation_text(explain(contributions(model, rows, names, keep=head, means=means and dict(means)), names,
                                     keep=[c for c in head if c != "probability"], top_n=top_n))
    return parts.select(*head, "base_probability", "top_contributions", "explanation")


def human_scenario(df: DataFrame, *, income="income", credit_amount="credit_amount", age="age",
                   employment_years="employment_years", has_car="has_car", has_realty="has_realty",
                   children_count="children_count", ext_source_2="ext_source_2",
                   ext_source_3="ext_source_3", sentinel: float = 365243) -> DataFrame:
    """Turn human inputs into a feature map.

    Age and years become negative day counts; no employment becomes the
    sentinel 365243 as the source did; the credit/income ratio uses 10 when
    income is not positive; external scores are included only when given.
    """
    inc, cred = F.col(income).cast("double"), F.col(credit_amount).cast("double")
    entries = [
        ("AMT_INCOME_TOTAL", inc),
        ("AMT_CREDIT", cred),
        ("DAYS_BIRTH", (-F.col(age) * 365).cast("double")),
        ("DAYS_EMPLOYED", F.when(F.col(employment_years) > 0, (-F.col(employment_years) * 365).cast("double"))
         .otherwise(F.lit(float(sentinel)))),
        ("CNT_CHILDREN", F.col(children_count).cast("double")),
        ("FLAG_OWN_CAR", F.col(has_car).cast("double")),
        ("FLAG_OWN_REALTY", F.col(has_realty).cast("double")),
        ("EXT_SOURCE_2", F.col(ext_source_2).cast("double")),
        ("EXT_SOURCE_3", F.col(ext_source_3).cast("double")),
        ("CREDIT_INCOME_RATIO", F.when(cred > 0, F.when(inc > 0, cred / inc).otherwise(F.lit(10.0)))),
    ]
    m = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[v for _, v in entries]))
    # entries whose value is null (optional inputs not given) are removed
    return df.withColumn("features_map", F.map_filter(m, lambda k, v: v.isNotNull()))


def fallback_score_grouped(df: DataFrame, key: str | Sequence[str], value: str,
                           out: str = "probability") -> DataFrame:
    """B8 when the request's values are rows (one per value) rather than a
    map: the same formula from ``avg(v)`` and ``avg(|v|)``, an aggregate with
    a map-side partial step, so no group is ever collected into an array."""
    keys = [key] if isinstance(key, str) else list(key)
    v = F.col(value).cast("double")
    g = df.groupBy(*keys).agg(F.avg(v).alias("__m"), F.avg(F.abs(v)).alias("__a"), F.count(v).alias("__n"))
    inner = F.least(F.greatest(F.col("__m") / (F.col("__a") + F.lit(1e-6)), F.lit(-1.0)), F.lit(1.0))
    prob = F.least(F.greatest(F.lit(0.5) + F.lit(0.5) * inner, F.lit(0.0)), F.lit(1.0))
    return g.select(*keys, F.when(F.col("__n") > 0, prob).otherwise(F.lit(0.5)).alias(out))


def fallback_score(df: DataFrame, col: str, out: str = "probability") -> DataFrame:
    """Model-free score over a request map's values (or an array)."""
    from pyspark.sql import types as T
    values = F.map_values(F.col(col)) if isinstance(df.schema[col].dataType, T.MapType) else F.col(col)
    return df.withColumn(out, stub_score(values))
