"""Row features, labels and formats on edge-case literal frames."""

import math

import pytest
from pyspark.sql import functions as F

from creditframe.functions import expressions as X


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_ratios_edge(spark):
    # denominator 0, null numerator, null denominator, NaN, infinity
    data = [(1.0, 0.0), (None, 2.0), (3.0, None), (float("nan"), 2.0), (float("inf"), 2.0), (6.0, 3.0)]
    got = one(spark, X.safe_div("a", "b"), data, "a double, b double")
    assert got[0] is None and got[1] is None and got[2] is None
    assert math.isnan(got[3]) and got[4] == float("inf") and got[5] == 2.0
    fin = one(spark, X.finite_or_null(X.safe_div("a", "b")), data, "a double, b double")
    assert fin[3] is None and fin[4] is None and fin[5] == 2.0


def test_plus_div(spark):
    got = one(spark, X.plus_div("a", "b", 1.0), [(4.0, 1.0), (4.0, -1.0)], "a double, b double")
    assert got == [2.0, None]


def test_ext_sources_skip_and_zero(spark):
    data = [(None, None, None), (0.5, None, None), (0.2, 0.4, 0.9)]
    schema = "e1 double, e2 double, e3 double"
    cols = ["e1", "e2", "e3"]
    assert one(spark, X.row_mean(cols), data, schema)[:2] == [None, 0.5]
    assert one(spark, X.row_mean(cols), data, schema)[2] == pytest.approx(0.5)
    assert one(spark, X.row_mean(cols, "zero"), data, schema) == pytest.approx([0.0, 0.5 / 3, 0.5])
    std = one(spark, X.row_std(cols), data, schema)
    assert std[0] is None and std[1] is None and std[2] == pytest.approx(0.360555127546, rel=1e-9)
    pop0 = one(spark, X.row_std(cols, "zero"), data, schema)
    assert pop0[1] == pytest.approx(math.sqrt(((0.5 - 0.5 / 3) ** 2 + 2 * (0.5 / 3) ** 2) / 3))
    assert one(spark, X.row_max(cols), data, schema) == [None, 0.5, 0.9]
    assert one(spark, X.row_min(cols), data, schema) == [None, 0.5, 0.2]
    assert one(spark, X.row_product(cols), data, schema)[:2] == [None, None]


def test_flag_counts_null_as_zero(spark):
    got = one(spark, X.row_count_flags(["a", "b", "c"]), [(1.0, None, 1.0), (None, None, None)],
              "a double, b double, c double")
    assert got == [2.0, 0.0]


def test_sentinel(spark):
    got = one(spark, X.sentinel_to_null("d"), [(365243.0,), (None,), (12.0,), (-400.0,)], "d double")
    assert got == [None, None, 12.0, -400.0]


def test_clip_keeps_null(spark):
    got = one(spark, X.clip("x", F.lit(1.0), F.lit(5.0)), [(None,), (0.0,), (1.0,), (5.0,), (9.0,)], "x double")
    assert got == [None, 1.0, 1.0, 5.0, 5.0]


def test_bands_and_class(spark):
    data = [(0.1,), (0.15,), (0.3,), (0.5,), (0.59,), (0.6,), (None,)]
    assert one(spark, X.risk_band4("p"), data, "p double") == ["LOW", "MEDIUM", "HIGH", "CRITICAL",
                                                                "CRITICAL", "CRITICAL", None]
    assert one(spark, X.risk_band3("p"), data, "p double") == ["Low", "Low", "Medium", "Medium", "Medium",
                                                                "High", None]
    assert one(spark, X.risk_band3("p", percent_scale=True), [(45.0,)], "p double") == ["Medium"]
    assert one(spark, X.risk_class("p", 0.5), [(0.5,), (0.49,)], "p double") == [1, 0]
    assert one(spark, X.risk_class("p", 0.5, inclusive=False), [(0.5,)], "p double") == [0]


def test_stub_score(spark):
    got = one(spark, X.stub_score("v"), [([],), ([1.0, 1.0],), ([-2.0, -2.0],), ([1.0, -1.0],)],
              "v array<double>")
    assert got[0] == 0.5
    assert got[1] == pytest.approx(1.0, abs=1e-6) and got[2] == pytest.approx(0.0, abs=1e-6)
    assert got[3] == pytest.approx(0.5)


def test_logistic_delta(spark):
    got = one(spark, X.prob_delta(F.lit(0.0), "s"), [(0.0,), (100.0,)], "s double")
    assert got == pytest.approx([0.0, 0.5])


def test_labels(spark):
    names = ["EXT_SOURCE_2", "BUREAU_DAYS", "PREV_X", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH",
             "CNT_CHILDREN", "FLAG_X", "outlier_score"]
    got = one(spark, X.feature_category("n"), [(n,) for n in names], "n string")
    assert got == ["External Sources", "Bureau", "Previous Applications", "Credit", "Amounts", "Days/Time",
                   "Counts/Flags", "Counts/Flags", "Other"]
    assert one(spark, X.pretty_name("n"), [("EXT_SOURCE_3",)], "n string") == ["Ext Source 3"]
    assert one(spark, X.compact_number("x"), [(1500.0,), (2.5e6,), (3e9,), (12.0,), (1.234,), (None,)],
               "x double") == ["1.5K", "2.5M", "3.0B", "12", "1.23", "0"]
    assert one(spark, X.bin_label("x"), [(12500.0,), (13500.0,), (999.4,)], "x double") == ["12K", "14K", "999"]
    assert one(spark, X.skew_label("m", "d"), [(12.0, 10.0), (8.0, 10.0), (10.0, 10.0)], "m double, d double") == [
        "right-skewed", "left-skewed", "approximately symmetric"]
    assert one(spark, X.corr_strength("r"), [(0.8,), (-0.5,), (0.1,)], "r double") == ["strong", "moderate", "weak"]
    assert one(spark, X.impact_strength("i"), [(0.11,), (-0.06,), (0.01,)], "i double") == [
        "strong", "moderate", "slight"]
