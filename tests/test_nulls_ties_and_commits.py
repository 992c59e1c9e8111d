"""Null groups and labels, ties, one-class input, all-null columns, commits."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditframe import session
from creditframe.operators import analysis, clean, impute, ml, ordered, profile, store
from creditframe.sources import io


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, None if i % 10 == 0 else i % 2, float(i % 7)) for i in range(100)]
    return spark.createDataFrame(rows, "id long, y int, x double")


def test_null_labels_keep_their_rows(labelled):
    split = ml.stratified_split(labelled, "id", "y", (0.8, 0.2))
    assert split.count() == 100 and split.where("y is null").count() == 10
    folds = ml.stratified_folds(labelled, "id", "y", 5)
    assert folds.count() == 100
    per = {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert all(per[None, f] == 2 for f in range(5))


def test_null_groups_have_quartiles_and_ranks(labelled):
    got = {r.y: r for r in profile.describe(labelled, ["x"], by=["y"]).collect()}
    assert got[None]["count"] == 10 and got[None]["median"] == 3.0
    ranks = ordered.percent_rank_le(labelled, "x", by=["y"])
    assert ranks.count() == 100 and ranks.where("pct_rank is null").count() == 0


def test_repeated_keys_are_ranked_once_each(spark):
    df = spark.createDataFrame([(1, 0)] * 6 + [(2, 0)] * 4, "id long, y int")
    assert sorted(r["count"] for r in ml.stratified_folds(df, "id", "y", 5).groupBy("fold").count().collect()) == [2] * 5


@pytest.mark.parametrize("buckets", [1, 2, 7, 64, 300])
def test_running_totals_with_any_number_of_buckets(spark, buckets):
    df = spark.createDataFrame([(float(v), 1) for v in range(500)], "v double, w int")
    got = ordered.running_totals(df, "v", ["w"], buckets=buckets).collect()
    assert all(r.w_before == r.v and r.w_total == 500 for r in got)


def test_cumulative_share_of_ties(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1.0), ("d", 1.0)], "name string, v double")
    got = {r.name: r.cumulative_share for r in analysis.cumulative_share(df, "v").collect()}
    assert got == {"c": 0.5, "d": 1.0, "a": 1.0, "b": 1.0}


def test_one_class_metrics_are_null(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.1, 0), ("b", 0.9, 1)], "g string, p double, y int")
    got = {r.g: (r.auc, r.average_precision) for r in ml.auc_ap(df, "p", "y", by=["g"]).collect()}
    assert got["a"][0] is None and got["b"] == (1.0, 1.0)
    assert all(r.tpr is None for r in ml.roc_curve(df.where("g = 'a'"), "p", "y").collect())


def test_integer_median_may_be_a_half(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert sorted(r.x for r in impute.fill_median(df, ["x"]).collect()) == [1.0, 1.5, 2.0]


def test_all_null_column_has_no_variance_to_drop(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None)], "a int, b int, c int")
    assert clean.drop_constant_columns(df)[1] == ["b"]


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert {r.x: (r["count"], round(r.share, 4)) for r in profile.value_counts(df, "x").collect()} == {
        "a": (2, 0.6667), "b": (1, 0.3333)}
    assert profile.value_counts(df, "x", dropna=False).count() == 3


def test_codes_follow_sorted_values(spark):
    values = ["", "a", "aaaaaaab", "aaaaaaaa", "é", "Z", "zz", "aaaaaa", None]
    df = spark.createDataFrame([(v,) for v in values] * 2, "x string")
    got = {r.value: r.code for r in impute.fit_label_codes(df, ["x"]).collect()}
    want = sorted((v if v is not None else "missing" for v in values), key=lambda v: v.encode())
    assert got == {v: float(i) for i, v in enumerate(want)}
    assert impute.label_encode(df, ["x"]).where("x is null").count() == 0


def test_every_requested_feature_is_analysed(spark):
    df = spark.createDataFrame([tuple(float(i + j) for j in range(20)) for i in range(6)], [f"f{j}" for j in range(20)])
    names = df.columns
    assert analysis.analyze("distribution", df, names)["statistics"].count() == 20
    shares = analysis.analyze("composition", df, names)["chart_data"]
    assert {r.feature for r in shares.collect()} == set(names)
    timed = df.withColumn("ts", F.lit(dt.datetime(2024, 1, 1)))
    assert analysis.analyze("trend", timed, names, ts="ts")["chart_data"].count() == 20


def test_ad_hoc_sql_is_not_cut(spark):
    assert io.run_sql(spark, {"t_range": spark.range(3000).toDF("i")}, "select * from t_range").count() == 3000


def test_only_a_local_master_may_use_a_local_folder():
    assert session.is_local("local") and session.is_local("local[4]")
    assert not session.is_local("yarn") and not session.is_local("local-cluster[2,1,1024]")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


VIEW = store.FeatureView("v", store.Entity("e", ("k",)), T.StructType([T.StructField("x", T.DoubleType())]), ts="ts",
                         ttl=dt.timedelta(days=10))


def _frame(spark, keys, x):
    return spark.createDataFrame([(k, x, dt.datetime(2024, 1, 1)) for k in keys], "k long, x double, ts timestamp")


def test_a_crash_before_the_commit_loses_nothing(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="cf-commit-")
    store.publish(_frame(spark, range(100), 1.0), VIEW, root)

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(store, "_write_pointer", crash)
        with pytest.raises(OSError):
            store.publish(_frame(spark, range(5), 2.0), VIEW, root)
    assert store.read_published(spark, root).count() == 100
    store.publish(_frame(spark, range(5), 3.0), VIEW, root)
    assert store.read_published(spark, root).count() == 5
    with pytest.raises(RuntimeError, match="not committed"):
        store.publish(_frame(spark, [1], 1.0).limit(0), VIEW, root)
    assert store.read_published(spark, root).count() == 5
    store.drop_old_versions(spark, root, 1)
    assert store.read_published(spark, root).count() == 5


def test_lost_pointers_are_an_error(spark):
    root = tempfile.mkdtemp(prefix="cf-lost-")
    assert store.current_path(spark, root) is None
    store.publish(_frame(spark, [1, 2], 1.0), VIEW, root)
    fs, folder = store._fs(spark, f"{root}/_pointers")
    for status in fs.listStatus(folder):
        fs.delete(status.getPath(), False)
    with pytest.raises(RuntimeError, match="pointers are gone"):
        store.current_path(spark, root)


def test_stream_applies_the_time_to_live(spark):
    from creditframe.streaming.materialize import run_available_now
    offline, snap, ck = (tempfile.mkdtemp(prefix=p) for p in ("cf-off-", "cf-snap-", "cf-ck-"))
    df = spark.createDataFrame([(1, 1.0, dt.datetime(2024, 1, 1)), (2, 2.0, dt.datetime(2023, 1, 1))],
                               "k long, x double, ts timestamp")
    df.write.mode("append").parquet(offline)
    run_available_now(spark, VIEW, offline, snap, schema=df.schema, checkpoint=ck, now=dt.datetime(2024, 1, 2))
    assert [r.k for r in store.read_published(spark, snap).collect()] == [1]


@pytest.mark.parametrize("accuracy", [20, 10000])
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_bracketed_quantiles_are_exact(spark, accuracy, method):
    import numpy as np
    rng = np.random.default_rng(5)
    n = 5000
    x, y = rng.normal(size=n).round(2), np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 30, n))
    g = np.where(rng.random(n) < 0.9, 1, 2)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), g.tolist())), "x double, y double, g int")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    names = ["q00", "q01", "q25", "q50", "q99", "q100"]

    def want(v):
        v = np.sort(v)
        if method == "linear":
            return np.quantile(v, qs)
        return v[[int((len(v) - 1) * q + 0.5) for q in qs]]

    for r in ordered.quantiles(df, ["x", "y"], qs, method=method, accuracy=accuracy).collect():
        assert np.allclose([r[k] for k in names], want({"x": x, "y": y}[r.feature]))
    for r in ordered.quantiles(df, ["x", "y"], qs, by=["g"], method=method, accuracy=accuracy).collect():
        assert np.allclose([r[k] for k in names], want({"x": x, "y": y}[r.feature][g == r.g]))
