"""The credit feature build on a small fixture with the raw table schemas."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditframe import schemas
from creditframe.plans.credit_features import FeatureOptions, feature_matrix, project_view

CHOICES = {"NAME_CONTRACT_STATUS": ["Approved", "Refused", "Canceled"], "CREDIT_ACTIVE": ["Active", "Closed"],
           "CREDIT_TYPE": ["Consumer", "Car", None], "STATUS": ["C", "X", "0"],
           "NAME_CONTRACT_TYPE": ["Cash loans", "Revolving loans"]}


def make(spark, schema, n, rng, ids):
    rows = []
    for i in range(n):
        row = []
        for f in schema.fields:
            if f.name in ids:
                row.append(ids[f.name](i))
            elif isinstance(f.dataType, T.StringType):
                opts = CHOICES.get(f.name, ["a", "b", None])
                row.append(opts[rng.integers(len(opts))])
            elif f.name == "TARGET":
                row.append(float(rng.integers(2)))
            elif f.name.startswith(("AMT_", "CNT_")):
                row.append(float(rng.integers(1, 50)) * 1000)
            elif f.name.startswith("DAYS_"):
                row.append(float(-rng.integers(100, 20000)))
            elif f.name.startswith("EXT_SOURCE"):
                row.append(None if rng.random() < 0.3 else float(rng.random()))
            else:
                row.append(float(rng.integers(0, 2)))
        rows.append(tuple(row))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    n = 40
    app = make(spark, schemas.APPLICATION_TRAIN, n, rng, {"SK_ID_CURR": lambda i: 100 + i})
    app = app.withColumn("DAYS_EMPLOYED", F.when(F.col("SK_ID_CURR") % 7 == 0, F.lit(365243.0))
                         .otherwise(F.col("DAYS_EMPLOYED")))
    # applicants 100..129 have history; 130..139 have none
    bureau = make(spark, schemas.BUREAU, 80, rng, {"SK_ID_CURR": lambda i: 100 + i % 30, "SK_ID_BUREAU": lambda i: i})
    bb = make(spark, schemas.BUREAU_BALANCE, 120, rng, {"SK_ID_BUREAU": lambda i: i % 90})
    prev = make(spark, schemas.PREVIOUS_APPLICATION, 90, rng,
                {"SK_ID_CURR": lambda i: 100 + i % 30, "SK_ID_PREV": lambda i: 1000 + i})
    pos = make(spark, schemas.POS_CASH_BALANCE, 60, rng,
               {"SK_ID_CURR": lambda i: 100 + i % 30, "SK_ID_PREV": lambda i: 1000 + i % 90})
    cc = make(spark, schemas.CREDIT_CARD_BALANCE, 30, rng,
              {"SK_ID_CURR": lambda i: 100 + i % 30, "SK_ID_PREV": lambda i: 1000 + i % 90})
    inst = make(spark, schemas.INSTALLMENTS_PAYMENTS, 150, rng,
                {"SK_ID_CURR": lambda i: 100 + i % 30, "SK_ID_PREV": lambda i: 1000 + i % 90})
    return {"application_train": app, "bureau": bureau, "bureau_balance": bb, "previous_application": prev,
            "pos_cash_balance": pos, "credit_card_balance": cc, "installments_payments": inst}


@pytest.fixture(scope="module")
def built(spark, tables):
    opts = FeatureOptions(knn_k=5, iforest_trees=10)
    wide, codes = feature_matrix(tables, event_time=dt.datetime(2025, 1, 1), opts=opts, project=False)
    return wide, project_view(wide, opts), codes


def test_view_shape_and_fills(spark, built):
    _, m, codes = built
    assert m.columns == [schemas.ENTITY_KEY, schemas.LABEL] + schemas.FEATURE_NAMES + [schemas.EVENT_TS]
    assert m.count() == 40
    pdf = m.toPandas().set_index("SK_ID_CURR").sort_index()
    # history zero-filled for applicants without children
    assert (pdf.loc[130:139, "BUREAU_SK_ID_BUREAU_COUNT"] == 0).all()
    assert (pdf.loc[130:139, "PREV_LAST3_AMT_CREDIT"] == 0).all()
    assert (pdf.loc[100:129, "BUREAU_SK_ID_BUREAU_COUNT"] > 0).all()
    # nothing left missing among features
    assert int(pdf[schemas.FEATURE_NAMES].isna().sum().sum()) == 0
    # encoded categoricals are codes
    assert set(pdf["NAME_CONTRACT_TYPE"].unique()) <= {0.0, 1.0, 2.0}
    assert set(pdf["outlier_label"].unique()) <= {-1.0, 1.0}
    # kNN label mean is a mean of labels
    assert pdf["KNN_TARGET_MEAN_500"].between(0, 1).all()
    assert codes.where("feature = 'CODE_GENDER'").count() >= 2


def test_values_follow_definitions(spark, tables, built):
    wide, _, _ = built
    pdf = wide.toPandas().set_index("SK_ID_CURR").sort_index()
    r = pdf.loc[101]
    assert r["CREDIT_INCOME_RATIO"] == pytest.approx(r["AMT_CREDIT"] / r["AMT_INCOME_TOTAL"])
    assert r["CREDIT_ANNUITY_YEARS"] == pytest.approx(r["AMT_CREDIT"] / (r["AMT_ANNUITY"] * 12 + 1))
    # the sentinel never survives: 365243 became null and then the median
    assert (pdf["DAYS_EMPLOYED"] != 365243).all()
    bureau = tables["bureau"].where("SK_ID_CURR = 101").toPandas()
    assert r["BUREAU_AMT_CREDIT_SUM_SUM"] == pytest.approx(bureau["AMT_CREDIT_SUM"].sum())
    assert r["BUREAU_ACTIVE_COUNT"] == (bureau["CREDIT_ACTIVE"] == "Active").sum()


def test_extended_build(spark, tables):
    opts = FeatureOptions(knn="constant", iforest_trees=5, extended=True, ext_source="zero",
                          past_due_std="pop", past_due_severity="mean", distinct_counts_null=True)
    m, _ = feature_matrix(tables, event_time=dt.datetime(2025, 1, 1), opts=opts)
    for c in ("CC_UTILIZATION_RATIO", "BB_MONTHS_BALANCE_MEAN", "PREV_LAST10_APPROVAL_RATE", "AGE_INT",
              "INST_AMT_PAYMENT_SUM", "DOWN_PAYMENT_RATIO"):
        assert c in m.columns
    assert (m.toPandas()["KNN_TARGET_MEAN_500"] == 0.0).all()
