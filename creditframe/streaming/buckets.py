"""A keyed snapshot in hash buckets that a stream brings up to date.

``run_bucketed`` is ``materialize.run_available_now`` for snapshots that are
much larger than a delivery: the newest row per key of a micro-batch is written
as one more *run* of the buckets it touches, so what is written follows the
delivery and not the snapshot.  A bucket with more than ``max_runs`` runs is
merged to one.  A manifest - a small table (bucket, run, newest event time) -
lists the live runs; it is written first and then committed by the next
numbered pointer, so readers see the state before or after a batch.  A batch
that is repeated after a crash adds the same rows again, which the reader's
newest-row rule makes one.

The manifest has at most buckets x (``max_runs`` + 1) rows; it alone is read
on the driver.  ``read_snapshot`` reduces the runs to the newest row per key.

Edge cases: rows without event time are not materialized; late rows lose
against newer ones; equal times go to the larger ``tiebreak``; null keys are a
key; an empty delivery changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import FeatureView, _fs, _pointers, _read_pointer, _write_pointer, latest_per_key, ts_literal
from ..session import ensure_checkpoint_dir

MAX_RUNS = 4


def _manifest(spark: SparkSession, path: str, pointer: str | None = None) -> list[tuple[int, str, dt.datetime]]:
    """(bucket, run folder below ``path``, newest event time so far)."""
    version = _read_pointer(spark, path, pointer)
    if version is None:
        return []
    rows = spark.read.parquet(f"{path.rstrip('/')}/{version}").collect()  # buckets x runs
    return [(r.bucket, r.run, r.newest) for r in rows]


def _read_runs(spark: SparkSession, path: str, runs: Sequence[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{r}" for r in runs])


def read_snapshot(spark: SparkSession, path: str, view: FeatureView, schema, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest row per key of the committed state."""
    runs = [run for _, run, _ in _manifest(spark, path)]
    whole = _read_runs(spark, path, runs, schema) if runs else spark.createDataFrame([], schema)
    return latest_per_key(whole, view.keys, view.ts, tiebreak)


def _write_runs(rows: DataFrame, path: str, name: str) -> dict[int, str]:
    """``rows`` (with ``__bucket``) as one folder per bucket."""
    spark, below = rows.sparkSession, f"runs/{name}-{uuid.uuid4().hex[:8]}"
    root = f"{path.rstrip('/')}/{below}"
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(root)
    fs, folder = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n.split("=")[1]): f"{below}/{n}" for n in names if n.startswith("__bucket=")}


def merge_batch(batch: DataFrame, view: FeatureView, path: str, *, name: str, buckets: int, tiebreak: Sequence[str] = (),
                now: dt.datetime | None = None, max_runs: int = MAX_RUNS, keep_versions: int = 3) -> dict[str, int]:
    """One delivery into the snapshot; how many runs were added and merged."""
    spark = batch.sparkSession
    state = _manifest(spark, path)
    newest = max((n for _, _, n in state), default=None)
    seen = batch.agg(F.max(view.ts)).first()[0]
    if seen is None:
        return {"added": 0, "merged": 0}
    newest = max(newest, seen) if newest else seen
    limit = ts_literal((now or newest) - view.ttl, batch.schema[view.ts].dataType)
    schema = batch.schema
    bucket = F.pmod(F.xxhash64(*view.keys), F.lit(buckets)).cast("int").alias("__bucket")
    fresh = latest_per_key(batch.where(F.col(view.ts) >= limit), view.keys, view.ts, tiebreak)
    added = _write_runs(fresh.select("*", bucket), path, name)
    live: dict[int, list[str]] = {}
    for b, run, _ in state:
        live.setdefault(b, []).append(run)
    for b, run in added.items():
        live.setdefault(b, []).append(run)
    crowded = {b: runs for b, runs in live.items() if len(runs) > max_runs}
    if crowded:
        whole = _read_runs(spark, path, [r for runs in crowded.values() for r in runs], schema)
        one = latest_per_key(whole, view.keys, view.ts, tiebreak)
        for b, run in _write_runs(one.select("*", bucket), path, f"{name}-merged").items():
            live[b] = [run]
    manifest = f"manifests/{name}-{uuid.uuid4().hex[:8]}"
    rows = [(b, run, newest) for b, runs in sorted(live.items()) for run in runs]
    spark.createDataFrame(rows, "bucket int, run string, newest " + schema[view.ts].dataType.simpleString()).coalesce(1).write.parquet(
        f"{path.rstrip('/')}/{manifest}")
    _write_pointer(spark, path, manifest)
    _drop_old(spark, path, keep_versions)
    return {"added": len(added), "merged": len(crowded)}


def _drop_old(spark: SparkSession, path: str, keep: int) -> None:
    """Remove manifests before the ``keep`` newest, and runs only they list."""
    names = _pointers(spark, path) or []
    if len(names) <= keep:
        return
    needed = {run for n in names[-keep:] for _, run, _ in _manifest(spark, path, n)}
    for n in names[:-keep]:
        gone = [run for _, run, _ in _manifest(spark, path, n) if run not in needed]
        for part in (*gone, _read_pointer(spark, path, n), f"_pointers/{n}"):
            fs, p = _fs(spark, f"{path.rstrip('/')}/{part}")
            fs.delete(p, True)


def run_bucketed(spark: SparkSession, view: FeatureView, offline_path: str, snapshot_path: str, *, schema,
                 tiebreak: Sequence[str] = (), checkpoint: str | None = None, now: dt.datetime | None = None,
                 buckets: int | None = None, max_runs: int = MAX_RUNS, keep_versions: int = 3) -> None:
    """Every offline file published since the last run goes into the snapshot;
    ``buckets`` must stay what it was when the snapshot began."""
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/buckets-{view.name}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch, view, snapshot_path, name=f"epoch-{epoch}", buckets=buckets, tiebreak=tiebreak, now=now,
                    max_runs=max_runs, keep_versions=keep_versions)

    query = (spark.readStream.schema(schema).parquet(offline_path).writeStream.foreachBatch(merge)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
