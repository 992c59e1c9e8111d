"""Feature store on Parquet.

A feature view is a key, an event-time column and a typed feature schema.
The *offline* table holds every published row; the *online snapshot* holds
the newest row per key, kept current by incremental materialization.

Newest-per-key is ``row_number() = 1`` over the key, newest first: the limit
runs before the shuffle, so a key with a third of all rows crosses it as one
row per map task, and an older late row can never replace a newer one.
Publishing writes a new version folder and commits it by adding a numbered
pointer file; pointers are never replaced, so readers never see a half-written
table and a crash never loses the live one.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entity:
    """The join key of a view (``SK_ID_CURR``, INT64)."""
    name: str
    join_keys: tuple[str, ...]


@dataclass(frozen=True)
class FeatureView:
    """Key, event time, typed features, time-to-live, source path."""
    name: str
    entity: Entity
    features: T.StructType
    ts: str = "event_timestamp"
    ttl: dt.timedelta = dt.timedelta(days=36500)
    source: str | None = None
    tags: dict = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return list(self.entity.join_keys)

    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.features.fields]

    def schema(self) -> T.StructType:
        key_fields = [T.StructField(k, T.LongType(), False) for k in self.keys]
        return T.StructType(key_fields + list(self.features.fields)
                            + [T.StructField(self.ts, T.TimestampType(), True)])


@dataclass(frozen=True)
class FeatureService:
    """A named bundle of views; its feature list is the model input."""
    name: str
    views: tuple[FeatureView, ...]

    def feature_names(self) -> list[str]:
        return [n for v in self.views for n in v.feature_names]


# ------------------------------------------------------------- publishing
def project_to_view(df: DataFrame, view: FeatureView) -> DataFrame:
    """Select and cast exactly the view's columns, in view order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in view.schema().fields])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, table_path: str) -> list[str] | None:
    """Names of the committed pointer files in order; None if there never was
    one.  A pointer folder without pointers means that they were lost."""
    fs, folder = _fs(spark, f"{table_path.rstrip('/')}/_pointers")
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    names = [n for n in names if not n.startswith((".", "_"))]
    if not names:
        raise RuntimeError(f"{table_path} has versions but its pointers are gone")
    return names


def _read_pointer(spark: SparkSession, table_path: str, name: str | None = None) -> str | None:
    """Version named by the newest pointer (or by the pointer ``name``)."""
    names = [name] if name else _pointers(spark, table_path)
    if names is None:
        return None
    fs, p = _fs(spark, f"{table_path.rstrip('/')}/_pointers/{names[-1]}")
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine()
    finally:
        stream.close()


def _write_pointer(spark: SparkSession, table_path: str, version_dir: str) -> None:
    """Commit a version: a pointer file of the next number is written aside
    and renamed into place.  No earlier pointer is touched, so a crash at any
    point leaves the last committed version live."""
    names = _pointers(spark, table_path) or []
    number = int(names[-1].split("-")[0]) + 1 if names else 0
    name = f"{number:012d}-{uuid.uuid4().hex}"
    fs, final = _fs(spark, f"{table_path.rstrip('/')}/_pointers/{name}")
    _, aside = _fs(spark, f"{table_path.rstrip('/')}/_aside/{name}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(version_dir.encode("utf-8")))
    finally:
        out.close()
    fs.mkdirs(final.getParent())
    if not fs.rename(aside, final):
        raise RuntimeError(f"could not commit {version_dir} at {table_path}")


def drop_old_versions(spark: SparkSession, table_path: str, keep: int) -> None:
    """Remove the folders and pointers of all but the ``keep`` newest versions."""
    for name in (_pointers(spark, table_path) or [])[:-keep]:
        version = _read_pointer(spark, table_path, name)
        for part in (version, f"_pointers/{name}"):
            fs, p = _fs(spark, f"{table_path.rstrip('/')}/{part}")
            fs.delete(p, True)


def current_path(spark: SparkSession, table_path: str) -> str | None:
    """Folder of the live version of a published table (None if unpublished)."""
    v = _read_pointer(spark, table_path)
    return None if v is None else f"{table_path.rstrip('/')}/{v}"


def read_published(spark: SparkSession, table_path: str) -> DataFrame:
    path = current_path(spark, table_path)
    if path is None:
        raise FileNotFoundError(f"nothing published at {table_path}")
    return spark.read.parquet(path)


def publish(df: DataFrame, view: FeatureView, table_path: str, *, verify: bool = True,
            allow_empty: bool = False) -> dict:
    """Project to the view, compare with the live schema, write a new
    version, verify it, then commit its pointer.

    ``recreated`` tells whether the schema changed (the source dropped and
    recreated its table then); rows are always fully replaced.  A version that
    reads back another number of rows than ``df`` has, or none, is not
    committed.
    """
    spark = df.sparkSession
    out = project_to_view(df, view)
    live = current_path(spark, table_path)
    shape = lambda sc: [(f.name, f.dataType) for f in sc.fields]  # noqa: E731  (nullability not compared)
    recreated = live is None or shape(spark.read.parquet(live).schema) != shape(out.schema)
    version = f"version={dt.datetime.now(dt.timezone.utc).strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
    target = f"{table_path.rstrip('/')}/{version}"
    # rows are counted by the write itself, so the source runs once
    sent_rows = Observation()
    out.observe(sent_rows, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(target)
    result = {"recreated": recreated, "path": target}
    if verify:
        sent, result["rows"] = sent_rows.get["n"], spark.read.parquet(target).count()
        if result["rows"] != sent or not (sent or allow_empty):
            raise RuntimeError(f"{target} holds {result['rows']} rows of {sent}; not committed")
    _write_pointer(spark, table_path, version)
    return result


# ------------------------------------------------------- materialization
def ts_literal(value: dt.datetime, dtype: T.DataType):
    """A time literal of the column's own type (local-time columns compare
    against local-time literals; no session-zone shift)."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest row per key; equal timestamps resolved by the largest ``tiebreak``."""
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak])
    return df.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")


def materialize(source: DataFrame, view: FeatureView, *, start: dt.datetime | None, end: dt.datetime,
                snapshot: DataFrame | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows with ``start < ts <= end`` (all up to ``end`` when
    ``start`` is None), reduced to the newest per key and merged into the
    previous snapshot.  Rows older than ``end - ttl`` are not materialized."""
    ts = F.col(view.ts)
    dtype = source.schema[view.ts].dataType
    window = ts <= ts_literal(end, dtype)
    if start is not None:
        window &= ts > ts_literal(start, dtype)
    window &= ts >= ts_literal(end - view.ttl, dtype)
    fresh = latest_per_key(source.where(window), view.keys, view.ts, tiebreak)
    if snapshot is None:
        return fresh
    return latest_per_key(snapshot.unionByName(fresh.select(*snapshot.columns)), view.keys, view.ts, tiebreak)


def lookup(snapshot: DataFrame, entities: DataFrame, view: FeatureView, *, now: dt.datetime,
           features: Sequence[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """Features for many entities at once.

    A row older than ``now - ttl`` counts as absent; absent, null and NaN
    values become ``fill`` (0.0 as the serving client did).  ``found`` tells
    whether the entity had a live row.
    """
    feats = list(features or view.feature_names)
    live = snapshot.where(F.col(view.ts) >= ts_literal(now - view.ttl, snapshot.schema[view.ts].dataType)).select(
        *view.keys, *feats, F.lit(True).alias("found"))
    out = entities.join(live, view.keys, "left")
    exprs = {"found": F.coalesce(F.col("found"), F.lit(False))}
    if fill is not None:
        for f in feats:
            c = F.col(f)
            if not isinstance(snapshot.schema[f].dataType, T.NumericType):
                continue  # text features stay null when absent
            if isinstance(snapshot.schema[f].dataType, (T.DoubleType, T.FloatType)):
                c = F.nanvl(c, F.lit(None).cast("double"))
            exprs[f] = F.coalesce(c, F.lit(fill).cast(snapshot.schema[f].dataType))
    return out.withColumns(exprs)
