"""Profiling, histograms, correlations and chart shaping."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditframe.operators import analysis as A
from creditframe.operators import profile as P


@pytest.fixture()
def frame(spark):
    rng = np.random.default_rng(7)
    n = 400
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "y": (rng.random(n) < 0.3).astype(int), "a": a,
                        "b": 2 * a + rng.normal(scale=0.01, size=n), "c": 2 * a + rng.normal(scale=0.05, size=n),
                        "k": np.ones(n)})
    pdf.loc[::10, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf).replace(float("nan"), None)


def test_describe_matches_pandas(spark, frame):
    pdf, df = frame
    d = {r["feature"]: r for r in P.describe(df, ["a", "b"]).collect()}
    for c in ("a", "b"):
        s = pdf[c].dropna()
        assert d[c]["count"] == len(s)
        assert d[c]["mean"] == pytest.approx(s.mean()) and d[c]["std"] == pytest.approx(s.std())
        assert d[c]["q25"] == pytest.approx(s.quantile(0.25)) and d[c]["median"] == pytest.approx(s.median())


def test_missing_and_duplicates(spark, frame):
    _, df = frame
    m = P.missing_report(df).collect()
    assert [(r["feature"], r["missing_count"]) for r in m] == [("b", 40)]
    dup = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, "y")], "a long, b string")
    assert P.duplicate_rows(dup).first()[0] == 2


def test_value_counts_top(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",)], "v string")
    assert [(r["v"], r["count"]) for r in P.value_counts(df, "v", top_n=2).collect()] == [("b", 2), ("c", 2)]


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 11)], "x double")
    drop = {r["bin"]: r["count"] for r in A.histogram_minmax(df, ["x"], 5).collect()}
    assert sum(drop.values()) == 11 and drop[5] == 3                   # last bin closed
    iqr = {r["bin"]: r["count"] for r in A.histogram_iqr(df, ["x"], 5).collect()}
    assert sum(iqr.values()) == 10 and len(iqr) == 5                   # x == hi lost, as the source
    kept = {r["bin"]: r["count"] for r in A.histogram_iqr(df, ["x"], 5, keep_top_edge=True).collect()}
    assert sum(kept.values()) == 11


def test_correlations(spark, frame):
    pdf, df = frame
    r = A.correlations(df, [("a", "b"), ("a", "k")]).collect()
    both = pdf[["a", "b"]].dropna()
    assert r[0]["corr"] == pytest.approx(np.corrcoef(both.a, both.b)[0, 1])
    assert r[1]["corr"] is None                                        # constant column
    m = {(r["feature_x"], r["feature_y"]): r["corr"] for r in A.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert m[("a", "b")] == pytest.approx(round(np.corrcoef(both.a, both.b)[0, 1], 3))
    assert m[("a", "k")] == 0.0 and m[("k", "k")] == 1.0 and m[("b", "a")] == m[("a", "b")]


def test_drop_correlated_chain(spark, frame):
    _, df = frame
    _, dropped = A.drop_correlated(df, ["a", "b", "c"], 0.95)
    assert dropped == ["b", "c"]          # both follow a; c goes even though b was dropped


def test_shaping(spark):
    df = spark.createDataFrame([(1, 10.0), (2, -4.0), (3, 6.0)], "step int, v double")
    wf = rows(A.waterfall(df, "step", "v"), "step", "start", "end")
    assert wf == [(1, 0.0, 10.0), (2, 10.0, 6.0), (3, 6.0, 12.0)]
    fn = dict(rows(A.funnel(df, "step", "v"), "step", "pct_of_first"))
    assert fn[2] == -40.0
    imp = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "feature string, importance double")
    cs = dict(rows(A.cumulative_share(imp, "importance"), "feature", "cumulative_share"))
    assert cs == {"a": 0.5, "b": 0.8, "c": 1.0}
    share = dict(rows(A.share_of_total(imp, "importance"), "feature", "share_pct"))
    assert share["a"] == 50.0
    wide = A.to_wide(spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "i int, s string, v double"),
                     "i", "s", "v", ["x", "y"]).first()
    assert (wide["x"], wide["y"]) == (1.0, 2.0)
    s1 = A.repeatable_sample(spark.range(1000).withColumnRenamed("id", "k"), "k", 20)
    s2 = A.repeatable_sample(spark.range(1000).withColumnRenamed("id", "k").repartition(7), "k", 20)
    assert rows(s1) == rows(s2)


def test_report_vs_population(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 300.0)], "id long, inc double")
    r = A.report_vs_population(df, "id", spark.createDataFrame([(2,)], "id long"), ["inc"]).first()
    assert r["pct_of_avg"] == 150.0 and r["position"] == "above"


def test_quantiles_of_few_groups_leave_rows_where_they_are(spark):
    import io
    from contextlib import redirect_stdout
    from pyspark.sql import functions as F
    from creditframe.operators.ordered import quantiles
    df = spark.range(40_000, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("g"), (F.col("id") % 1000).cast("double").alias("v"))
    out = quantiles(df, ["v"], [0.5], by=["g"])
    buf = io.StringIO()
    with redirect_stdout(buf):
        out.explain()
    # the rows meet the brackets of their group without being dealt by group
    assert "SortMergeJoin" not in buf.getvalue() and "BroadcastHashJoin" in buf.getvalue()
    assert {(r.g, r.q50) for r in out.collect()} == {(None, 500.0), (0, 498.0), (2, 500.0)}
