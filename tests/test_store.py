"""Feature store: publish, newest-per-key materialization, TTL lookup, stream."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from creditframe.operators.store import (Entity, FeatureService, FeatureView, latest_per_key, lookup, materialize,
                                         publish, read_published)

FEATS = T.StructType([T.StructField("x", T.DoubleType())])
VIEW = FeatureView("v", Entity("e", ("k",)), FEATS, ts="ts", ttl=dt.timedelta(days=10))


def frame(spark, data):
    return spark.createDataFrame(data, "k long, x double, ts timestamp, seq long")


def test_late_older_row_and_ties(spark):
    t = dt.datetime
    first = frame(spark, [(1, 1.0, t(2024, 1, 5), 1), (2, 2.0, t(2024, 1, 5), 2)])
    snap = materialize(first, VIEW, start=None, end=t(2024, 1, 10), tiebreak=["seq"])
    # a late row older than the snapshot's row and a tie on the timestamp
    late = frame(spark, [(1, 9.0, t(2024, 1, 1), 3), (2, 7.0, t(2024, 1, 5), 9), (3, 3.0, t(2024, 1, 12), 4)])
    snap2 = materialize(late, VIEW, start=None, end=t(2024, 1, 15), snapshot=snap, tiebreak=["seq"])
    got = rows(snap2, "k", "x")
    assert got == [(1, 1.0), (2, 7.0), (3, 3.0)]


def test_ttl_lookup_fill(spark):
    t = dt.datetime
    snap = frame(spark, [(1, None, t(2024, 1, 9), 1), (2, 5.0, t(2023, 1, 1), 2)])
    ents = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = rows(lookup(snap, ents, VIEW, now=t(2024, 1, 10)), "k", "x", "found")
    assert got == [(1, 0.0, True), (2, 0.0, False), (3, 0.0, False)]


def test_service_names():
    svc = FeatureService("s", (VIEW, FeatureView("w", VIEW.entity, T.StructType([T.StructField("y", T.DoubleType())]))))
    assert svc.feature_names() == ["x", "y"]


def test_publish_versions(spark):
    root = tempfile.mkdtemp(prefix="cf-store-")
    df = spark.createDataFrame([(1, 1.0, dt.datetime(2024, 1, 1))], "k long, x double, ts timestamp")
    r1 = publish(df, VIEW, root)
    r2 = publish(df.withColumn("x", F.lit(2.0)), VIEW, root)
    assert r1["recreated"] and not r2["recreated"] and r2["rows"] == 1
    assert read_published(spark, root).first()["x"] == 2.0


def test_stream_available_now(spark):
    from creditframe.streaming.materialize import run_available_now
    from creditframe.operators.store import current_path
    offline, snap, ck = (tempfile.mkdtemp(prefix=p) for p in ("cf-off-", "cf-snap-", "cf-ck-"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType()),
                           T.StructField("ts", T.TimestampType())])
    t = dt.datetime
    spark.createDataFrame([(1, 1.0, t(2024, 1, 2)), (1, 2.0, t(2024, 1, 3))], schema).write.mode("append").parquet(offline)
    run_available_now(spark, VIEW, offline, snap, schema=schema, checkpoint=ck)
    spark.createDataFrame([(1, 0.5, t(2024, 1, 1)), (2, 4.0, t(2024, 1, 4))], schema).write.mode("append").parquet(offline)
    run_available_now(spark, VIEW, offline, snap, schema=schema, checkpoint=ck)
    got = rows(spark.read.parquet(current_path(spark, snap)), "k", "x")
    assert got == [(1, 2.0), (2, 4.0)]


def test_bucketed_snapshot_writes_what_a_delivery_touches(spark):
    from creditframe.operators.store import latest_per_key
    from creditframe.streaming import buckets as B
    offline, snap, ck = (tempfile.mkdtemp(prefix=p) for p in ("cf-off-", "cf-buckets-", "cf-ck-"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("ts", T.TimestampType())])
    t = dt.datetime
    deliveries = [[(k, float(k), t(2024, 1, 2)) for k in range(200)], [(1, 9.0, t(2024, 1, 9)), (1, 8.0, t(2024, 1, 8)), (None, 1.0, t(2024, 1, 9))],
                  [(2, 7.0, t(2024, 1, 1)), (3, 5.0, None)], [], [(1, 6.0, t(2024, 1, 10))], [(1, 5.0, t(2024, 1, 11)), (500, 0.0, t(2020, 1, 1))]]
    sent, runs = [], []
    for d in deliveries:
        sent += d
        spark.createDataFrame(d, schema).coalesce(1).write.mode("append").parquet(offline)
        B.run_bucketed(spark, VIEW, offline, snap, schema=schema, checkpoint=ck, buckets=16, max_runs=2)
        runs.append({(b, run) for b, run, _ in B._manifest(spark, snap)})
    assert [len(b - a) for a, b in zip(runs, runs[1:])] == [2, 1, 0, 1, 1]      # new runs: buckets of the delivery
    assert len(runs[0]) == 16 and max(sum(b == c for c, _ in runs[-1]) for b in range(16)) <= 2
    whole = spark.createDataFrame([r for r in sent if r[2] and r[2].year == 2024], schema)
    want = latest_per_key(whole, ["k"], "ts").collect()
    got = B.read_snapshot(spark, snap, VIEW, schema).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    from creditframe.operators.store import _pointers
    assert len(_pointers(spark, snap)) == 3
