"""Child aggregates, joins and zero fill."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditframe.operators.aggregate import (AggSpec, attach, child_aggregate, fill_zero_by_substring,
                                             two_hop_aggregate)


@pytest.fixture()
def children(spark):
    base = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    child = spark.createDataFrame(
        [(1, 10.0, "Active", "A"), (1, 20.0, "Closed", None), (2, 5.0, "Active", "B"),
         (3, None, None, None)],
        "id long, amt double, status string, kind string")
    return base, child


def test_aggspec_names_and_values(spark, children):
    _, child = children
    spec = AggSpec("BUREAU", {"amt": ["mean", "sum", "max", "count"]},
                   counts_if={"BUREAU_ACTIVE_COUNT": ("status", "Active")},
                   distinct={"BUREAU_KIND_COUNT": "kind"})
    out = child_aggregate(child, "id", spec)
    assert out.columns == ["id", "BUREAU_AMT_MEAN", "BUREAU_AMT_SUM", "BUREAU_AMT_MAX", "BUREAU_AMT_COUNT",
                           "BUREAU_ACTIVE_COUNT", "BUREAU_KIND_COUNT"]
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["BUREAU_AMT_MEAN"] == 15.0 and got[1]["BUREAU_ACTIVE_COUNT"] == 1
    assert got[1]["BUREAU_KIND_COUNT"] == 1            # null ignored
    assert got[3]["BUREAU_AMT_SUM"] is None             # sum of only nulls is null (not 0)
    assert got[3]["BUREAU_AMT_COUNT"] == 0 and got[3]["BUREAU_ACTIVE_COUNT"] == 0


def test_distinct_counting_null(spark, children):
    _, child = children
    spec = AggSpec("B", distinct={"N": "kind"}, distinct_counts_null=True)
    got = dict(rows(child_aggregate(child, "id", spec), "id", "N"))
    assert got == {1: 2, 2: 1, 3: 1}


def test_attach_zero_fill(spark, children):
    base, child = children
    agg = child_aggregate(child, "id", AggSpec("B", {"amt": ["sum"]}))
    out = attach(base, "id", agg, fill_zero=["B_AMT_SUM"])
    assert rows(out) == [(1, 30.0), (2, 5.0), (3, 0.0), (4, 0.0)]


def test_fill_by_substring_is_literal(spark):
    df = spark.createDataFrame([(None, None, None)], "BUREAU_X double, AMT_REQ_CREDIT_BUREAU_DAY double, OTHER double")
    out = fill_zero_by_substring(df, ["BUREAU"]).first()
    assert out["BUREAU_X"] == 0 and out["AMT_REQ_CREDIT_BUREAU_DAY"] == 0 and out["OTHER"] is None


def test_two_hop_equals_direct_and_drops_orphans(spark):
    bb = spark.createDataFrame([(100, -1.0, "C"), (100, -3.0, "X"), (101, -2.0, "C"), (999, -7.0, "C")],
                               "bid long, months double, status string")
    bureau = spark.createDataFrame([(100, 1), (101, 1)], "bid long, cid long")
    out = two_hop_aggregate(bb, bureau, grandchild_key="bid", parent_key="cid",
                            measures={"months": ["mean", "max"]}, counts_if={"BB_CLOSED": ("status", "C")})
    r = out.first()
    assert out.count() == 1 and r["cid"] == 1
    assert r["BB_MONTHS_MEAN"] == pytest.approx(-2.0) and r["BB_MONTHS_MAX"] == -1.0 and r["BB_CLOSED"] == 2
