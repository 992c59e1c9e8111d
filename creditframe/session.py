"""Spark session defaults and lineage helpers.

The engine never owns the cluster: on a real deployment the session comes
from the platform and every setting below is only a default for settings the
platform left unset.  Tests and ``bench.py`` build a local session through
:func:`get_spark`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults chosen for a shuffle-heavy, per-applicant workload.  AQE coalesces
# the small post-aggregate partitions and splits skewed join partitions at
# run time; ANSI stays on so silent overflow / bad casts surface as errors.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A dimension is broadcast only below this size; everything else shuffles.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "creditframe") -> SparkSession:
    """Return the active session, or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("CREDITFRAME_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is None:
        shuffle_partitions = 8 if master.startswith("local") else 2000
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CREDITFRAME_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """One JVM on one machine (``local``, ``local[n]``)?"""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only set one when it is unset.

    On a cluster the setting names a shared folder (HDFS / object store) that
    survives executor loss.  A machine-local temporary folder is used only
    when nothing was configured and the master is a single local JVM, as in
    tests; elsewhere executors would write to disks of their own, so a
    missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not is_local(sc.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
    if not configured:
        configured = tempfile.mkdtemp(prefix="creditframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where an iterative plan would otherwise grow without bound.  Never a
    local checkpoint: those die with the executor that holds them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back.

    For what several branches of a plan read: it is computed once, its size is
    known to the optimizer, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task where each of them costs much more than reading it.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows dealt evenly over as many tasks as there are
    shuffle partitions, or more, so that none gets over ``TASK_ROWS``.

    For steps that cost much per row: the sizes in bytes by which Spark joins
    small partitions would leave such rows to a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // TASK_ROWS)))
