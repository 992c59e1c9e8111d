"""Reports, chart choices, explained scenarios and the certificate of a fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditframe.operators import analysis as A
from creditframe.operators import ml
from creditframe.operators.score import what_if


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400) * 30 + 7, "flat": 2.0})
    pdf["y"] = (pdf.a - pdf.b / 30 + rng.normal(size=400) > 0).astype(int)
    pdf["w"] = np.where(pdf.y == 1, 2.0, 1.0)
    df = spark.createDataFrame(pdf).cache()
    return df, ml.logistic(["a", "b", "flat"], "y", weight="w").fit(df), pdf


def test_certificate_tells_a_fit_from_an_early_stop(fitted):
    df, model, pdf = fitted
    good = {r.term: r for r in ml.optimality(model, df, ["a", "b", "flat"], "y", weight="w").collect()}
    assert len(good) == 4 and all(r.optimal for r in good.values())
    early = ml.logistic(["a", "b", "flat"], "y", weight="w", max_iter=1).fit(df)
    got = {r.term: r for r in ml.optimality(early, df, ["a", "b", "flat"], "y", weight="w").collect()}
    assert not got["a"].optimal
    lr = early.stages[-1]
    p = 1 / (1 + np.exp(-(lr.intercept + pdf[["a", "b", "flat"]].to_numpy() @ lr.coefficients.toArray())))
    off = pdf.w * (p - pdf.y)
    mean = (pdf.w * pdf.a).sum() / pdf.w.sum()
    spread = np.sqrt((pdf.w * (pdf.a - mean) ** 2).sum() / pdf.w.sum())
    assert abs(got["a"].gradient - (off * (pdf.a - mean)).sum() / pdf.w.sum() / spread) < 1e-9


def test_risk_breakdown_explains_the_applicants_asked_for(spark, fitted):
    df, model, _ = fitted
    ids = spark.createDataFrame([(3,), (5,), (5,), (9999,)], "id long")
    out = A.analyze("risk_breakdown", df, ["a", "b", "flat"], key="id", applicants=ids, model=model)
    bars = out["chart_data"].orderBy("id", "rank").collect()
    assert [(r.id, r["rank"]) for r in bars] == [(i, k) for i in (3, 5) for k in (1, 2, 3)]
    assert all(abs(x.impact) >= abs(y.impact) for x, y in zip(bars, bars[1:]) if x.id == y.id)
    assert out["statistics"].count() == 2
    for missing in ({}, {"applicants": ids, "key": "id"}):
        with pytest.raises(ValueError):
            A.analyze("risk_breakdown", df, ["a"], **missing)


def test_percentiles_and_scatter(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, None), (3, 4.0, 6.0), (4, None, 7.0)], "id long, a double, b double")
    out = A.analyze("percentile", df, ["a", "b"], key="id", applicants=df.where("id <= 2"))["statistics"]
    assert {(r.id, r.feature): round(r.percentile, 4) for r in out.collect()} == \
        {(1, "a"): 66.6667, (2, "a"): 66.6667, (1, "b"): 33.3333}
    pair = A.analyze("correlation", df, ["a", "b"], key="id")
    assert sorted(map(tuple, pair["chart_data"].collect())) == [(1, 1.0, 5.0), (3, 4.0, 6.0)]
    with pytest.raises(ValueError):
        A.analyze("correlation", df, ["a"])


def test_chart_and_alternatives():
    assert A.chart_choice("correlation", 2) == {"chart_type": "scatter", "alternatives": ["heatmap"]}
    assert A.chart_choice("correlation", 3)["chart_type"] == "heatmap"
    assert A.chart_choice("risk_breakdown", 1) == {"chart_type": "feature_importance", "alternatives": ["gauge", "waterfall"]}
    assert set(A.ANALYSIS_TYPES) >= {"distribution", "comparison", "trend", "composition", "percentile"}


def test_report_types(spark, fitted):
    df, model, pdf = fitted
    some = df.where("id < 3")
    plain = A.applicant_report(df, "id", some, ["a", "b"])
    assert plain.count() == 3 and plain.columns == ["id", "comparison", "recommended_charts"]
    row = plain.where("id = 1").first().comparison[1]
    assert row.feature == "b" and row.pct_of_avg == round(pdf.b[1] / pdf.b.mean() * 100, 1)
    risk = A.applicant_report(df, "id", some, ["a", "b"], report_type="risk_focused", model=model,
                              features=["a", "b", "flat"], top_n=2).collect()
    assert all(len(r.top_contributions) == 2 and 0 < r.probability < 1 and r.explanation for r in risk)
    for bad in ({"report_type": "short"}, {"report_type": "detailed"}):
        with pytest.raises(ValueError):
            A.applicant_report(df, "id", some, ["a"], **bad)
    empty = A.applicant_report(df.limit(0), "id", some, ["a"], report_type="detailed", model=model, features=["a", "b", "flat"])
    assert empty.count() == 0


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_scenarios_carry_their_explanation(spark, fitted, kind):
    df, model, _ = fitted
    names = ["a", "b", "flat"]
    if kind == "trees":
        model = ml.boosted_trees(names, "y", rounds=3, depth=2).fit(df)
    ask = spark.createDataFrame([("x", {"a": 1.0}, True), ("x", {"a": 1.0, "b": 3.0, "other": 1.0}, False), ("none", {}, False)],
                                "name string, features_map map<string,double>, fill_missing_with_median boolean")
    out = what_if(model, ask, names, medians={"b": 7.0}, means={"a": 0.0, "b": 7.0, "flat": 2.0}, explained=True)
    plain = what_if(model, ask, names, medians={"b": 7.0})
    key = lambda r: (r.name, r.n_provided)
    got, want = sorted(out.collect(), key=key), sorted(plain.collect(), key=key)
    assert [(r.name, r.n_provided, r.n_filled, r.prediction, r.risk_level) for r in got] == \
        [(r.name, r.n_provided, r.n_filled, r.prediction, r.risk_level) for r in want]
    assert len(got) == 3 and all(abs(g.probability - w.probability) < 1e-9 for g, w in zip(got, want))
    for r in got:
        odds = np.log(r.base_probability / (1 - r.base_probability)) + sum(c.impact_logodds for c in r.top_contributions)
        assert abs(1 / (1 + np.exp(-odds)) - r.probability) < 1e-6
    assert out.where(F.col("explanation").isNull()).count() == 0
