"""First/last-N history (W1-W3) and instalment features."""

import datetime as dt

import pytest

from creditframe.operators.installments import installment_aggregate, past_due_aggregate, payment_rows
from creditframe.operators.sequence import first_last_means


def test_sequence_short_ties_nulls(spark):
    d = dt.date
    df = spark.createDataFrame([
        (1, 1, d(2020, 1, 1), 10.0), (1, 2, d(2020, 1, 2), 20.0), (1, 3, d(2020, 1, 2), 30.0),
        (1, 4, None, 40.0), (2, 5, d(2020, 1, 1), 7.0)], "k long, id long, day date, v double")
    out = {r["k"]: r for r in first_last_means(df, "k", "day", "id", last={2: ["v"], 3: ["v"]},
                                               first={2: ["v"]}).collect()}
    # newest first: null date first (PostgreSQL DESC), then ties by id desc
    assert out[1]["LAST2_V"] == pytest.approx(35.0)        # rows 4 (null date) and 3
    assert out[1]["LAST3_V"] == pytest.approx(30.0)        # + row 2
    assert out[1]["FIRST2_V"] == pytest.approx(15.0)       # rows 1, 2 (ASC, nulls last)
    assert out[2]["LAST3_V"] == 7.0                        # fewer rows than N


def test_payment_rows_edges(spark):
    df = spark.createDataFrame([(1, 100.0, 100.0, -10.0, -12.0), (1, 0.0, 5.0, -5.0, -1.0),
                                (1, 50.0, None, -3.0, None)],
                               "k long, due double, paid double, due_day double, paid_day double")
    r = payment_rows(df, due="due", paid="paid", due_day="due_day", paid_day="paid_day").collect()
    assert r[0]["DAYS_DIFF"] == -2.0 and r[0]["LATE_PAYMENT"] == 0 and r[0]["DAYS_PAST_DUE"] == 0.0
    assert r[1]["PAYMENT_RATIO"] is None and r[1]["LATE_PAYMENT"] == 1 and r[1]["DAYS_PAST_DUE"] == 4.0
    assert r[2]["LATE_PAYMENT"] == 0 and r[2]["DAYS_PAST_DUE"] == 0.0   # unpaid: null difference


def test_installment_and_past_due(spark):
    df = spark.createDataFrame([(1, 100.0, 90.0, 2.0), (1, 100.0, 100.0, -1.0), (2, 10.0, 10.0, 0.0)],
                               "k long, due double, paid double, dd double")
    a5 = {r["k"]: r for r in installment_aggregate(df, key="k", due="due", paid="paid", days_diff="dd").collect()}
    assert a5[1]["INST_PAYMENT_DIFF_SUM"] == -10.0 and a5[1]["INST_LATE_PAYMENT_SUM"] == 1
    assert a5[1]["INST_LATE_PAYMENT_MEAN"] == 0.5 and a5[1]["INST_PAYMENT_RATIO_MIN"] == 0.9
    a6 = {r["k"]: r for r in past_due_aggregate(df, key="k", due="due", paid="paid", days_diff="dd").collect()}
    assert a6[1]["PAST_DUE_SEVERITY"] == pytest.approx(2.0 / 2)       # sum / (late + 1)
    assert a6[2]["PAST_DUE_PAYMENT_RATIO_STD"] is None                 # one row: sample std undefined
    m = {r["k"]: r for r in past_due_aggregate(df, key="k", due="due", paid="paid", days_diff="dd",
                                               std="pop", severity="mean").collect()}
    assert m[2]["PAST_DUE_PAYMENT_RATIO_STD"] == 0.0 and m[1]["PAST_DUE_SEVERITY"] == 1.0
