"""Sources and sinks (S1-S13) and the remaining operators."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from creditframe.operators import analysis as A
from creditframe.operators import ml
from creditframe.operators import profile as P
from creditframe.operators.score import score_by_id
from creditframe.operators.store import Entity, FeatureView
from creditframe.functions.expressions import format_ts
from creditframe.sources import io


def test_csv_typed_ragged_and_export(spark):
    d = tempfile.mkdtemp(prefix="cf-io-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as fh:
        fh.write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-3,C\n2,,X\n3\n")      # empty field, short row
    schema = io.RAW_TABLES["bureau_balance"]
    df = io.read_csv(spark, path, schema)
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == {1: (-3.0, "C"), 2: (None, "X"), 3: (None, None)}
    out = os.path.join(d, "out")
    io.write_csv(df, out)
    assert io.read_csv(spark, out, schema).count() == 3
    io.write_parquet(df, os.path.join(d, "pq"))
    assert io.read_parquet(spark, os.path.join(d, "pq")).count() == 3


def test_text_repair_and_casts(spark):
    df = spark.createDataFrame([("1.5", "x", 2), ("", "7", 3), (" ", None, 4)], "a string, b string, c int")
    out = {r["c"]: (r["a"], r["b"]) for r in io.text_columns_to_double(df).collect()}
    assert out == {2: (1.5, None), 3: (None, 7.0), 4: (None, None)}
    with pytest.raises(Exception):
        io.text_columns_to_double(df, strict=True).collect()
    assert [r[0] for r in df.select(io.to_double("a")).collect()] == [1.5, None, None]


def test_catalogue_sql_summary_names(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    cat = io.schema_catalogue({"a": a})
    assert rows(cat) == [("a", 1, "k", "bigint"), ("a", 2, "v", "string")]
    q = io.run_sql(spark, {"a": a}, "SELECT k + 1 AS k2 FROM a", limit=10)
    assert q.first()["k2"] == 2
    s = io.result_summary(a)
    assert s["row_count"] == 1 and s["columns"] == ["k", "v"] and len(s["preview"]) == 1
    names = io.feature_name_list(spark.createDataFrame([(1, 0, 1.0)], "SK_ID_CURR long, TARGET int, f double"))
    assert names == ["f"]
    p = os.path.join(tempfile.mkdtemp(), "names.txt")
    io.write_name_list(names, p)
    assert open(p).read() == "f"


def test_profile_lookup_and_range(spark):
    df = spark.createDataFrame([(1, -10000.0, -800.0, 0), (2, -20000.0, 365243.0, 1), (3, -9000.0, -100.0, 0)],
                               "SK_ID_CURR long, DAYS_BIRTH double, DAYS_EMPLOYED double, TARGET int")
    p = rows(A.applicant_profile(df, "SK_ID_CURR", spark.createDataFrame([(1,), (2,)], "SK_ID_CURR long")),
             "SK_ID_CURR", "age_years", "employment_years")
    assert p == [(1, 27, 2), (2, 54, 0)]
    assert A.valid_range(df, "DAYS_EMPLOYED", hi=0).count() == 2


def test_missing_by_table(spark):
    a = spark.createDataFrame([(1, None)], "k long, x double")
    b = spark.createDataFrame([(None, 2.0)], "k long, y double")
    got = rows(P.missing_by_table({"a": a, "b": b}), "table_name", "feature", "missing_count")
    assert got == [("a", "x", 1), ("b", "k", 1)]


def test_analysis_dispatch(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, dt.datetime(2024, 1, 1)), (0, 2.0, 1.0, dt.datetime(2024, 1, 2)),
                                (1, 3.0, 0.0, dt.datetime(2024, 1, 2))], "TARGET int, a double, b double, ts timestamp")
    assert set(A.analyze("distribution", df, ["a", "b"])) == {"statistics", "chart_data"}
    assert A.analyze("comparison", df, ["a"])["statistics"].count() == 2
    assert A.analyze("correlation", df, ["a", "b"])["statistics"].count() == 4
    assert A.analyze("trend", df, ["a"], ts="ts")["chart_data"].count() == 2
    with pytest.raises(ValueError):
        A.analyze("nope", df, ["a"])


def test_random_search_and_overfit(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(200), "x": rng.normal(size=200)})
    pdf["y"] = (pdf.x + rng.normal(scale=0.5, size=200) > 0).astype(int)
    df = ml.stratified_folds(spark.createDataFrame(pdf), "id", "y", 3)
    cv = ml.random_search(ml.logistic(["x"], "y", max_iter=20), {"regParam": [0.0, 0.1, 1.0]}, draws=2,
                          label="y", fold_col="fold", parallelism=1).fit(df)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.7
    metrics = spark.createDataFrame([("train", 0.9), ("validation", 0.8)], "split string, auc double")
    r = ml.overfit_check(metrics).first()
    assert r["overfit"] and r["auc_gap"] == pytest.approx(0.1)
    best = ml.best_model(spark.createDataFrame([("a", 0.7), ("b", 0.8)], "model string, auc double")).first()
    assert best["model"] == "b"


def test_score_by_id(spark):
    import numpy as np
    import pandas as pd
    pdf = pd.DataFrame({"k": range(50), "x": np.linspace(-2, 2, 50)})
    pdf["y"] = (pdf.x > 0).astype(int)
    df = spark.createDataFrame(pdf)
    model = ml.logistic(["x"], "y", max_iter=20).fit(df)
    view = FeatureView("v", Entity("e", ("k",)), T.StructType([T.StructField("x", T.DoubleType())]), ts="ts",
                       ttl=dt.timedelta(days=1))
    snap = df.select("k", "x", F.lit(dt.datetime(2024, 1, 1)).alias("ts"))
    ids = spark.createDataFrame([(49,), (999,)], "k long")
    got = {r["k"]: r for r in score_by_id(model, snap, ids, view, now=dt.datetime(2024, 1, 1, 12)).collect()}
    assert got[49]["status"] == "ok" and got[49]["probability"] > 0.5
    assert got[999]["status"] == "not_found" and got[999]["probability"] is None


def test_format_ts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 6, 7, 8, 9),)], "t timestamp")
    assert df.select(format_ts("t")).first()[0] == "2024-05-06 07:08:09"
