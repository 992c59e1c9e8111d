"""kNN against brute force, isolation forest on planted outliers, SMOTE."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditframe.operators.knn import knn_neighbours, knn_target_mean
from creditframe.operators.outliers import average_path, forest_table, isolation_forest
from creditframe.operators.resample import smote


def brute_knn_mean(pdf, dims, label, k, exclude_self):
    pts = pdf.groupby(dims).agg(cnt=(label, "size"), ys=(label, "sum")).reset_index()
    out = {}
    for _, row in pdf.iterrows():
        p = pts.copy()
        if exclude_self:
            own = np.logical_and.reduce([p[d] == row[d] for d in dims])
            p.loc[own, "cnt"] -= 1
            p.loc[own, "ys"] -= row[label]
            p = p[p.cnt > 0]
        p["d2"] = sum((p[d] - row[d]) ** 2 for d in dims)
        p = p.sort_values(["d2", *dims])
        before = p.cnt.cumsum() - p.cnt
        take = np.minimum(p.cnt, k - before).clip(lower=0)
        out[row["id"]] = float((take * p.ys / p.cnt).sum() / k)
    return pd.Series(out)


@pytest.mark.parametrize("k,exclude_self,cells", [(5, False, None), (12, True, None), (3, False, 7)])
def test_knn_grid_with_ties(spark, k, exclude_self, cells):
    rng = np.random.default_rng(2)
    n = 240
    x = np.round(rng.normal(size=(n, 2)) * 2) / 2          # a coarse lattice: many ties
    x[:80] = [0.0, 0.0]                                     # a third of rows on one point
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "y": rng.integers(0, 2, n)})
    got = knn_target_mean(spark.createDataFrame(pdf), "id", ["a", "b"], "y", k, exclude_self=exclude_self,
                          out="m", cells=cells).toPandas().set_index("id")["m"].sort_index()
    exp = brute_knn_mean(pdf, ["a", "b"], "y", k, exclude_self).sort_index()
    assert np.allclose(got.values, exp.values, atol=1e-12)


def test_knn_far_outlier_needs_wide_search(spark):
    pdf = pd.DataFrame({"id": range(61), "a": [float(i % 10) for i in range(60)] + [1000.0],
                        "b": [float(i // 10) for i in range(60)] + [1000.0], "y": [0] * 60 + [1]})
    got = knn_target_mean(spark.createDataFrame(pdf), "id", ["a", "b"], "y", 4, out="m").toPandas()
    exp = brute_knn_mean(pdf, ["a", "b"], "y", 4, False)
    assert np.allclose(got.set_index("id")["m"].sort_index().values, exp.sort_index().values)


def test_knn_neighbours(spark):
    pdf = pd.DataFrame({"id": range(5), "a": [0.0, 1.0, 3.0, 6.0, 6.0], "b": [0.0] * 5})
    nb = {r["id"]: [x["a"] for x in r["neighbours"]]
          for r in knn_neighbours(spark.createDataFrame(pdf), "id", ["a", "b"], 2).collect()}
    assert nb[0] == [1.0, 3.0] and nb[3] == [3.0, 1.0]      # identical point 6.0 is not its own neighbour


def test_isolation_forest_planted(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(1000, 3)), rng.normal(size=(10, 3)) * 0.5 + 12])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["id"] = np.arange(len(pdf))
    out = isolation_forest(spark.createDataFrame(pdf), "id", ["a", "b", "c"], contamination=0.05).toPandas()
    assert set(out.nsmallest(10, "outlier_score")["id"]) == set(range(1000, 1010))
    assert abs((out["outlier_label"] == -1).sum() - 0.05 * len(pdf)) <= 2
    again = isolation_forest(spark.createDataFrame(pdf).repartition(3), "id", ["a", "b", "c"]).toPandas()
    assert np.allclose(out.sort_values("id")["outlier_score"].values, again.sort_values("id")["outlier_score"].values)


def test_forest_table_holds_every_row_of_the_samples(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(700, 2)), columns=["a", "x.y"]).round(1)
    pdf["id"] = [f"k{i}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    nodes = forest_table(df, "id", ["a", "x.y"], trees=7, sample_size=64).toPandas()
    again = forest_table(df.repartition(5), "id", ["a", "x.y"], trees=7, sample_size=64).toPandas()
    order = ["tree", "node"]
    pd.testing.assert_frame_equal(nodes.sort_values(order).reset_index(drop=True),
                                  again.sort_values(order).reset_index(drop=True))
    size = {(r.tree, r.node): r.size_ for r in nodes.rename(columns={"size": "size_"}).itertuples()}
    assert all(size[t, 1] == 64 for t in range(7))
    for r in nodes.itertuples():
        assert r.node < 2 ** 7
        if r.feature >= 0:
            left, right = size[r.tree, 2 * r.node], size[r.tree, 2 * r.node + 1]
            assert left > 0 and right > 0 and left + right == size[r.tree, r.node]
        else:
            assert (r.tree, 2 * r.node) not in size
    # the scores are the mean path lengths over that table
    cuts = {(r.tree, r.node): (r.feature, r.threshold) for r in nodes.itertuples()}
    want = {}
    for row in pdf.itertuples(index=False):
        total = 0.0
        for t in range(7):
            node = 1
            while cuts[t, node][0] >= 0:
                f, cut = cuts[t, node]
                node = 2 * node + (row[f] >= cut)
                total += 1
            total += average_path([size[t, node]])[0]
        want[row.id] = -2.0 ** (-total / 7 / average_path([64])[0])
    got = isolation_forest(df, "id", ["a", "x.y"], trees=7, sample_size=64).toPandas().set_index("id")["outlier_score"]
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and len(got) == len(want)


def test_forest_of_few_equal_or_no_rows(spark):
    one = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, a double")
    nodes = forest_table(one, "id", ["a"], trees=3).collect()
    assert sorted((r.tree, r.node, r.feature, r["size"]) for r in nodes) == [(t, 1, -1, 2) for t in range(3)]
    assert {r.outlier_label for r in isolation_forest(one, "id", ["a"], trees=3).collect()} == {1}
    assert forest_table(one.limit(0), "id", ["a"], trees=3).count() == 0
    assert isolation_forest(one.limit(0), "id", ["a"], trees=3).count() == 0


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(120), "a": rng.normal(size=120), "b": rng.normal(size=120),
                        "y": [1] * 20 + [0] * 100})
    out = smote(spark.createDataFrame(pdf), "id", ["a", "b"], "y", k=5, seed=7)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 100, 1: 100}
    syn = out.where("synthetic").toPandas()
    mino = pdf[pdf.y == 1]
    assert syn.a.between(mino.a.min(), mino.a.max()).all() and syn.b.between(mino.b.min(), mino.b.max()).all()
    assert (syn.id < 0).all() and syn.id.is_unique
    again = smote(spark.createDataFrame(pdf).repartition(4), "id", ["a", "b"], "y", k=5, seed=7)
    assert sorted(map(tuple, again.where("synthetic").select("id", "a").collect())) == \
        sorted(map(tuple, out.where("synthetic").select("id", "a").collect()))


def test_knn_refines_jointly_dense_cells(spark):
    # points on a diagonal: every marginal is uniform, the joint density is not
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": np.arange(n) / 7.0, "b": np.arange(n) / 7.0,
                        "y": (np.arange(n) % 3 == 0).astype(int)})
    got = knn_target_mean(spark.createDataFrame(pdf), "id", ["a", "b"], "y", 6, out="m").toPandas()
    exp = brute_knn_mean(pdf, ["a", "b"], "y", 6, False)
    assert np.allclose(got.set_index("id")["m"].sort_index().values, exp.sort_index().values)


def test_places_on_the_curve_are_found_by_blocks_of_rows(spark):
    from creditframe.operators.knn import _curve
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(2000)], "a double, b double")
    out = _curve(df, ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    z = {r.a: r["__z"] for r in out.collect()}
    assert len(z) == 2000 and z[0.0] == 0 and max(z.values()) < 1 << 20
