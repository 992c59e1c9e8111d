"""Exact order statistics, cleaning, imputation and encoding."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditframe.operators import clean as C
from creditframe.operators import impute as I
from creditframe.operators.ordered import percent_rank_le, quantiles, running_totals


def test_running_totals_matches_cumsum_and_partitioning(spark):
    rng = np.random.default_rng(3)
    v = rng.permutation(500).astype(float)
    w = rng.integers(1, 5, 500)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    for parts in (1, 7):
        got = running_totals(df.repartition(parts), "v", ["w"], buckets=16).toPandas().sort_values("v")
        exp = pd.DataFrame({"v": v, "w": w}).sort_values("v")
        assert list(got["w_before"]) == list(exp["w"].cumsum() - exp["w"])
        assert (got["w_total"] == w.sum()).all()
    desc = running_totals(df, "v", ["w"], descending=True).toPandas().sort_values("v", ascending=False)
    exp = pd.DataFrame({"v": v, "w": w}).sort_values("v", ascending=False)
    assert list(desc["w_before"]) == list(exp["w"].cumsum() - exp["w"])


def test_quantiles_exact(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=301) * 10, 1)
    x[:100] = 3.0                                   # a third of rows share one value
    g = np.where(np.arange(301) % 2 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g}))
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = quantiles(df, ["x"], qs).first()
    assert [got[f"q{int(q * 100):02d}"] for q in qs] == pytest.approx(list(np.quantile(x, qs)))
    near = quantiles(df, ["x"], [0.3], method="nearest").first()["q30"]
    srt = np.sort(x)
    assert near == srt[int(np.floor(0.3 * 300 + 0.5))]
    byg = {r["g"]: r["q50"] for r in quantiles(df, ["x"], [0.5], by=["g"]).collect()}
    assert byg["a"] == pytest.approx(np.median(x[g == "a"])) and byg["b"] == pytest.approx(np.median(x[g == "b"]))


def test_percent_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "id long, x double")
    assert rows(percent_rank_le(df, "x"), "id", "pct_rank") == [(1, 100 / 3), (2, 100.0), (3, 100.0), (4, None)]


def test_cap_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    out = [r[0] for r in C.cap_percentiles(df, ["x"], 0.01, 0.99).collect()]
    assert None in out and min(v for v in out if v is not None) == 1.0 and max(v for v in out if v is not None) == 99.0


def test_iqr(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    s = C.iqr_summary(df, ["x"]).first()
    assert s["q25"] == 3.0 and s["q75"] == 7.0 and s["n_outliers"] == 1
    assert C.iqr_outliers(df, "x").count() == 1


def test_drop_missing_and_constant(spark):
    df = spark.createDataFrame([(1, None, 5.0, 1.0), (2, None, 5.0, 2.0), (3, 1.0, 5.0, None)],
                               "SK_ID_CURR long, a double, c double, d double")
    _, dropped = C.drop_missing_columns(df, 0.5)
    assert dropped == ["a"]
    _, const = C.drop_constant_columns(df)
    assert "c" in const and "d" not in const


def test_nonfinite_counts(spark):
    df = spark.createDataFrame([(float("inf"), float("nan")), (None, 1.0)], "a double, b double")
    r = C.count_nonfinite(df).first()
    assert (r["n_inf"], r["n_nan"], r["n_null"]) == (1, 1, 1)
    assert C.infinities_to_null(df).first()["a"] is None


def test_median_mode_encode(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 3.0, "b"), (4, 10.0, "a"), (5, None, None)],
                               "id long, x double, c string")
    filled = dict(rows(I.fill_median(df, ["x"]), "id", "x"))
    assert filled[2] == 3.0 and filled[5] == 3.0
    modes = dict(rows(I.fill_mode(df, ["c"]), "id", "c"))
    assert modes[5] == "a"                                    # tie a/b -> lowest
    assert dict(rows(I.fill_mode(df.withColumn("c", F.lit(None).cast("string")), ["c"]), "id", "c"))[1] == "Unknown"
    codes = I.fit_label_codes(df, ["c"], null_token="missing")
    assert rows(codes, "value", "code") == [("a", 0.0), ("b", 1.0), ("missing", 2.0)]
    new = spark.createDataFrame([(9, "z"), (10, None)], "id long, c string")
    enc = dict(rows(I.apply_label_codes(new, codes, ["c"]), "id", "c"))
    assert enc == {9: -1.0, 10: 2.0}
    const = I.fill_constant(spark.createDataFrame([(float("nan"),), (None,)], "x double"), -999.0)
    assert [r[0] for r in const.collect()] == [-999.0, -999.0]


def test_brackets_are_narrowed_until_few_rows_are_left(spark, monkeypatch):
    import random

    import numpy as np
    from creditframe.operators import ordered
    rng = random.Random(5)
    rows = [(rng.lognormvariate(0, 3), float(rng.choice([1, 1, 1, 2, 3])), None if i % 9 else float(i), -1e12 if i == 0 else float(i % 7919))
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    monkeypatch.setattr(ordered, "BRACKET_ROWS", 20)
    qs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    seen = []
    narrowed = ordered._narrowed
    monkeypatch.setattr(ordered, "_narrowed", lambda *a: seen.append(narrowed(*a)) or seen[-1])
    got = {r.feature: r for r in ordered.quantiles(df, ["a", "b", "c", "d"], qs, accuracy=100).collect()}
    for j, name in enumerate("abcd"):
        x = np.array([r[j] for r in rows if r[j] is not None])
        want = np.quantile(x, qs)
        assert [got[name][f"q{int(round(q * 100)):02d}"] for q in qs] == pytest.approx(want.tolist())
        for k, q in enumerate(qs):
            lo, hi = seen[0][f"__p{j}"][k], seen[0][f"__p{j}"][len(qs) + k]
            assert lo == hi or ((x >= lo) & (x <= hi)).sum() <= 20
