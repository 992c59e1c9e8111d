"""Incremental materialization as a Structured Streaming job.

``readStream`` over the published offline folder, ``trigger(availableNow)``
processes every file not seen before and stops; ``foreachBatch`` merges each
micro-batch into the online snapshot with the same newest-per-key rule as the
batch path, so a late row with an older timestamp never replaces a newer one.
The stream checkpoint lives in the cluster's shared checkpoint folder, so a
lost executor or driver restart resumes from the last committed batch.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import (FeatureView, _write_pointer, current_path, drop_old_versions, latest_per_key,
                               ts_literal)
from ..session import ensure_checkpoint_dir


def run_available_now(spark: SparkSession, view: FeatureView, offline_path: str, snapshot_path: str, *,
                      schema, tiebreak: Sequence[str] = (), checkpoint: str | None = None,
                      now: dt.datetime | None = None, keep_versions: int = 3) -> None:
    """Bring the snapshot at ``snapshot_path`` up to date with every offline
    file published since the last run.  Rows older than the view's time to
    live before ``now`` are not materialized, as in the batch path; unless
    given, ``now`` is the newest event time seen so far.  The last
    ``keep_versions`` snapshots stay on disk."""
    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/materialize-{view.name}"

    def merge(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        live = current_path(session, snapshot_path)
        seen = batch if live is None else batch.select(view.ts).unionByName(session.read.parquet(live).select(view.ts))
        at = now or seen.agg({view.ts: "max"}).first()[0]
        if at is None:
            return
        fresh = batch.where(batch[view.ts] >= ts_literal(at - view.ttl, batch.schema[view.ts].dataType))
        fresh = latest_per_key(fresh, view.keys, view.ts, tiebreak)
        if live is not None:
            current = session.read.parquet(live)
            fresh = latest_per_key(current.unionByName(fresh.select(*current.columns)),
                                   view.keys, view.ts, tiebreak)
        # a new version folder, then the pointer flip: readers never see a
        # half-written snapshot, and a retried epoch just writes another version
        version = f"epoch={epoch_id}-{uuid.uuid4().hex[:8]}"
        fresh.write.mode("errorifexists").parquet(f"{snapshot_path.rstrip('/')}/{version}")
        _write_pointer(session, snapshot_path, version)
        drop_old_versions(session, snapshot_path, keep_versions)

    query = (spark.readStream.schema(schema).parquet(offline_path)
             .writeStream.foreachBatch(merge)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
