"""Feature-store queries over ``events``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import Entity, FeatureView, lookup, materialize
from ..sources.tables import events, table
from .registry import REGISTRY, register

USER = Entity("user", ("user_id",))
EVENT_FEATURES = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                               T.StructField("value", T.LongType())])
LONG_TTL = FeatureView("user_events", USER, EVENT_FEATURES, ts="ts", ttl=dt.timedelta(days=36500))
WEEK_TTL = FeatureView("user_events_7d", USER, EVENT_FEATURES, ts="ts", ttl=dt.timedelta(days=7))

FIRST_RUN = dt.datetime(2024, 1, 10)
NOW = dt.datetime(2024, 1, 20)


def _source(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "ts")


@register("d4_latest_per_key", """
SELECT user_id, event_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM @EVENTS WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
WHERE rn = 1
""", "D4, D5")
def d4_latest_per_key(spark, sf_dir):
    src = _source(spark, sf_dir)
    # two incremental runs: everything up to the first run, then (first, now]
    snap = materialize(src, LONG_TTL, start=None, end=FIRST_RUN, tiebreak=["event_id"])
    snap = materialize(src, LONG_TTL, start=FIRST_RUN, end=NOW, snapshot=snap, tiebreak=["event_id"])
    return snap.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("d6_lookup_ttl", """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
                          FROM @EVENTS WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'
                            AND ts >= TIMESTAMP '2024-01-13 00:00:00') WHERE rn = 1)
SELECT c.c_custkey AS user_id, coalesce(s.value, 0) AS value, coalesce(s.event_type, 'none') AS event_type,
       s.user_id IS NOT NULL AS found
FROM customer c LEFT JOIN s ON c.c_custkey = s.user_id
""", "D6, J6, I4")
def d6_lookup_ttl(spark, sf_dir):
    snap = materialize(_source(spark, sf_dir), WEEK_TTL, start=None, end=NOW, tiebreak=["event_id"])
    ents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    out = lookup(snap, ents, WEEK_TTL, now=NOW, features=["value", "event_type"], fill=0.0)
    return out.select("user_id", "value", F.coalesce("event_type", F.lit("none")).alias("event_type"), "found")


D4_SQL = REGISTRY["d4_latest_per_key"].sql


def d4_stream_latest(spark, sf_dir):
    """D4 through Structured Streaming: the offline folder receives the
    events in three deliveries up to now; each is a run of the buckets it
    touches in a bucketed snapshot, merged by an ``availableNow`` run.  Files
    and stream state live under the shared checkpoint folder."""
    from ..session import scratch_path
    from ..streaming.buckets import read_snapshot, run_bucketed
    from ..operators.store import ts_literal
    src = _source(spark, sf_dir)
    root = scratch_path(spark, "d4-stream")
    offline, snap, ck = f"{root}/offline", f"{root}/snapshot", f"{root}/state"
    dtype = src.schema["ts"].dataType
    begin = None
    for end in (FIRST_RUN, FIRST_RUN + dt.timedelta(days=5), NOW):
        part = src.where(F.col("ts") <= ts_literal(end, dtype))
        if begin is not None:
            part = part.where(F.col("ts") > ts_literal(begin, dtype))
        part.write.mode("append").parquet(offline)
        run_bucketed(spark, LONG_TTL, offline, snap, schema=src.schema, tiebreak=["event_id"], checkpoint=ck, buckets=16, max_runs=2)
        begin = end
    out = read_snapshot(spark, snap, LONG_TTL, src.schema, ["event_id"])
    return out.select("user_id", "event_id", "event_type", "value",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


register("d4_stream_latest", D4_SQL, "D4 (Structured Streaming, availableNow, bucketed snapshot)")(d4_stream_latest)
