"""Splits, metrics, scoring, explanations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditframe.operators import ml
from creditframe.operators.explain import explain, explanation_text, linear_contributions
from creditframe.operators.score import fallback_score, human_scenario, project_features, score, validate_features


@pytest.fixture()
def labelled(spark):
    rng = np.random.default_rng(11)
    n = 600
    x1 = rng.normal(size=n)
    x2 = rng.normal(size=n)
    y = (x1 + 0.5 * x2 + rng.normal(scale=0.8, size=n) > 0.8).astype(int)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "y": y}))


def test_split_exact_and_stable(spark, labelled):
    a = ml.stratified_split(labelled, "id", "y", (0.6, 0.2, 0.2), seed=1)
    b = ml.stratified_split(labelled.repartition(5), "id", "y", (0.6, 0.2, 0.2), seed=1)
    assert rows(a, "id", "split") == rows(b, "id", "split")
    counts = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    n1 = labelled.where("y = 1").count()
    assert counts[(1, 0)] == round(0.6 * n1) and counts[(1, 1)] == round(0.8 * n1) - round(0.6 * n1)
    folds = ml.stratified_folds(labelled, "id", "y", 5).groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 2


def test_auc_ap_roc_match_brute_force(spark):
    s = np.array([0.1, 0.4, 0.35, 0.8, 0.4, 0.9, 0.2, 0.4])
    y = np.array([0, 0, 1, 1, 1, 1, 0, 0])
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    r = ml.auc_ap(df, "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert r["auc"] == pytest.approx(auc)
    # average precision over distinct thresholds, high to low
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        gain = (y[s == t] == 1).sum() / y.sum()
        ap += gain * tp / sel.sum()
    assert r["average_precision"] == pytest.approx(ap)
    roc = ml.roc_curve(df, "s", "y").orderBy(F.col("threshold").desc()).collect()
    assert roc[-1]["fpr"] == 1.0 and roc[-1]["tpr"] == 1.0


def test_confusion(spark):
    df = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.2, 1), (0.1, 0)], "p double, y int")
    r = ml.confusion_metrics(df, "p", "y").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1) and r["f1"] == 0.5


def test_class_weights(spark, labelled):
    w = ml.class_weights(labelled, "y").groupBy("y").agg(F.sum("weight").alias("s")).collect()
    assert w[0]["s"] == pytest.approx(w[1]["s"])


def test_logistic_contributions_add_up(spark, labelled):
    model = ml.logistic(["x1", "x2"], "y", max_iter=100).fit(labelled)
    c = linear_contributions(model, labelled, ["x1", "x2"], keep=["id"])
    p = ml.predictions(model, labelled, "id", "y").select("id", F.col("probability").alias("p2"))
    joined = explain(c, ["x1", "x2"], keep=["id"]).join(p, "id").select("probability", "p2").collect()
    assert all(abs(a - b) < 1e-6 for a, b in ((r[0], r[1]) for r in joined))
    txt = explanation_text(explain(c, ["x1", "x2"], keep=["id"])).first()["explanation"]
    assert "X1" in txt or "X2" in txt
    top = explain(c, ["x1", "x2"], keep=["id"], top_n=1).first()
    assert len(top["top_contributions"]) == 1


def test_scoring_paths(spark, labelled):
    model = ml.logistic(["x1", "x2"], "y", max_iter=50).fit(labelled)
    req = spark.createDataFrame([("a", {"x1": 1.0}), ("b", {"x1": 1.0, "x2": 0.0, "zz": 3.0})],
                                "name string, m map<string,double>")
    s = rows(score(model, req, ["x1", "x2"], keep=["name"], map_col="m"), "name", "probability")
    assert s[0][1] == pytest.approx(s[1][1])               # absent x2 -> 0.0
    v = {r["name"]: r for r in validate_features(req, "m", ["x1", "x2"], important=["x2"]).collect()}
    assert not v["a"]["valid"] and v["a"]["missing_important"] == ["x2"] and v["b"]["extra_features"] == ["zz"]
    proj = project_features(spark.createDataFrame([(float("nan"),)], "x1 double"), ["x1", "x2"]).first()
    assert (proj["x1"], proj["x2"]) == (0.0, 0.0)
    human = spark.createDataFrame([(50000.0, 10000.0, 30, 0, True, False, 1, None, 0.4)],
                                  "income double, credit_amount double, age int, employment_years int, "
                                  "has_car boolean, has_realty boolean, children_count int, "
                                  "ext_source_2 double, ext_source_3 double")
    m = human_scenario(human).first()["features_map"]
    assert m["DAYS_EMPLOYED"] == 365243 and m["DAYS_BIRTH"] == -10950 and "EXT_SOURCE_2" not in m
    assert fallback_score(human_scenario(human), "features_map").first()["probability"] > 0.5


def test_tree_shap_additive_for_gbt(spark, labelled):
    from creditframe.operators.explain import tree_contributions
    model = ml.boosted_trees(["x1", "x2"], "y", rounds=8, depth=3).fit(labelled)
    c = tree_contributions(model, labelled, ["x1", "x2"], keep=["id"])
    p = ml.predictions(model, labelled, "id", "y").select("id", F.col("probability").alias("p2"))
    got = explain(c, ["x1", "x2"], keep=["id"]).join(p, "id").select("probability", "p2").collect()
    assert all(abs(a - b) < 1e-9 for a, b in got)
    # x1 carries most of the signal in this fixture
    imp = c.select(F.avg(F.abs("contrib__x1")).alias("a"), F.avg(F.abs("contrib__x2")).alias("b")).first()
    assert imp["a"] > imp["b"]


def test_tree_shap_forest_sums_to_probability(spark, labelled):
    from creditframe.operators.explain import tree_contributions
    model = ml.random_forest(["x1", "x2"], "y", trees=5, depth=3).fit(labelled)
    c = tree_contributions(model, labelled, ["x1", "x2"], keep=["id"])
    p = ml.predictions(model, labelled, "id", "y").select("id", F.col("probability").alias("p2"))
    got = explain(c, ["x1", "x2"], keep=["id"]).join(p, "id").select("probability", "p2").collect()
    assert all(abs(a - b) < 1e-6 for a, b in got)


def test_models_score_in_a_session_that_observed(spark, labelled):
    from pyspark.sql import Observation
    from creditframe.operators.score import positive_probability
    seen = Observation()
    labelled.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 600
    for pipeline in (ml.logistic(["x1", "x2"], "y", max_iter=5), ml.random_forest(["x1", "x2"], "y", trees=2, depth=2)):
        # copies, as a search over parameters makes them, are no different
        for fitted in (pipeline.fit(labelled), pipeline.copy().fit(labelled)):
            p = [r.p for r in fitted.transform(labelled).select(positive_probability().alias("p")).collect()]
            assert len(p) == 600 and all(0 <= v <= 1 for v in p)


def test_split_rows_are_not_dealt_by_label(spark):
    rows_ = spark.range(20_000, numPartitions=6).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = ml.stratified_split(rows_, "id", "y", (0.7, 0.3))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 4000
    counts = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts == {(0, 0): 9333, (0, 1): 4000, (1, 0): 4667, (1, 1): 2000}


def test_spread_deals_by_number_of_rows(spark, monkeypatch):
    from creditframe import session
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(1000, numPartitions=1)
    assert session.spread(df, 1000).rdd.getNumPartitions() == n
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    dealt = session.spread(df, 1000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 75


def test_tree_contributions_of_long_paths_are_the_same(spark, labelled, monkeypatch):
    from creditframe.operators import explain as X
    model = ml.boosted_trees(["x1", "x2"], "y", rounds=3, depth=4).fit(labelled)
    gaps = labelled.withColumn("x2", F.when(F.col("id") % 5 > 0, F.col("x2")))
    names = ["contrib__x1", "contrib__x2", "margin"]
    table = rows(X.tree_contributions(model, gaps, ["x1", "x2"], keep=["id"]), "id", *names)
    monkeypatch.setattr(X, "TABLE_BITS", 0)
    met = rows(X.tree_contributions(model, gaps, ["x1", "x2"], keep=["id"]), "id", *names)
    assert table == met and len(met) == 600
    monkeypatch.undo()
    # no pattern is sought among the rows of a batch where all were solved before
    monkeypatch.setattr(X.np, "unique", None)
    solved = X._solved(2.0, np.array([[0.0, np.inf, 0.25], [-np.inf, 1.0, 0.5]]))
    got = solved(np.array([3, 0, 3]))
    assert got.shape == (2, 3) and np.allclose(got.sum(axis=0), [2 - 0.25, -0.25, 2 - 0.25])
