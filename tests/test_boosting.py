"""Histogram boosting against a plain leaf-wise version; patience; search."""

import heapq
import math
import random

import numpy as np
import pytest

from creditframe.operators import boosting as B
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c d"]


def frame(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.choice([None, float("nan"), *map(float, range(12))]), rng.gauss(0, 1)
        c = float(rng.randrange(4))
        z = (0 if a is None or a != a else a / 4 - 1.5) + b * (1 if c < 2 else -1)
        out.append((i, a, b, c, int(rng.random() < 1 / (1 + math.exp(-2 * z))), rng.choice([1.0, 2.0]), i % 3))
    return out


@pytest.fixture(scope="module")
def binned(spark):
    df = spark.createDataFrame(frame(), "id long, a double, b double, `c d` double, y int, w double, fold int").repartition(3)
    return B.bin_features(df, FEATURES, "id", "y", weight="w", group="fold", max_bins=12)


def plain_bins(binned):
    rows = []
    for r in frame():
        rows.append([0 if v is None or v != v else 1 + sum(e < v for e in binned.edges[j]) for j, v in enumerate(r[1:4])])
    return np.array(rows)


def plain_train(bins, y, w, n_bins, p, rounds):
    """[[(node path, feature, bin, gain)], ...] and margins, one node at a time."""
    margin = np.full(len(y), math.log(np.sum(w * y) / np.sum(w * (1 - y))))
    out = []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * prob * (1 - prob)
        shrunk = lambda x: math.copysign(max(abs(x) - p.reg_alpha, 0), x)
        score = lambda i: shrunk(g[i].sum()) ** 2 / (h[i].sum() + p.reg_lambda)

        def best(i):
            top = None
            for f in range(bins.shape[1]):
                for t in range(n_bins - 1):
                    left, right = i[bins[i, f] <= t], i[bins[i, f] > t]
                    if min(len(left), len(right)) < max(1, p.min_child_samples) or min(h[left].sum(), h[right].sum()) < p.min_child_weight:
                        continue
                    gain = score(left) + score(right) - score(i)
                    if gain > max(p.min_split_gain, 1e-12) and (top is None or gain > top[0] + 1e-9 * max(1, abs(top[0]))):
                        top = (gain, f, t, left, right)
            return top

        heap, leaves, splits = [], {"": np.arange(len(y))}, []
        if found := best(leaves[""]):
            heapq.heappush(heap, (-found[0], "", found))
        while heap and len(leaves) < p.num_leaves:
            _, path, (gain, f, t, left, right) = heapq.heappop(heap)
            del leaves[path]
            splits.append((path, f, t, round(gain, 6)))
            for side, i in (("L", left), ("R", right)):
                leaves[path + side] = i
                if len(path) + 1 < p.max_depth and (found := best(i)):
                    heapq.heappush(heap, (-found[0], path + side, found))
        for i in leaves.values():
            margin[i] += -p.learning_rate * shrunk(g[i].sum()) / (h[i].sum() + p.reg_lambda)
        out.append(sorted(splits))
    return out, margin


def paths(tree):
    name, out = {0: ""}, []
    for i, left in enumerate(tree.left):
        if left >= 0:
            name[left], name[left + 1] = name[i] + "L", name[i] + "R"
            out.append((name[i], tree.feature[i], tree.bin[i], round(tree.gain[i], 6)))
    return sorted(out)


@pytest.mark.parametrize("p", [B.Params(num_leaves=6, max_depth=4, learning_rate=0.3, min_child_samples=5),
                               B.Params(num_leaves=9, max_depth=8, learning_rate=0.2, min_child_samples=1, reg_alpha=0.5,
                                        reg_lambda=2.0, min_split_gain=0.3)])
def test_trees_equal_plain_leaf_wise_growth(binned, p, monkeypatch):
    monkeypatch.setattr(B, "KEEP_EVERY", 2)
    rows = frame()
    y, w = np.array([r[4] for r in rows], float), np.array([r[5] for r in rows])
    bins = plain_bins(binned)
    want, margin = plain_train(bins, y, w, binned.n_bins, p, 3)
    model, = B.train(binned, [(B.replace(p, n_estimators=3), -1)])
    assert [paths(t) for t in model.trees] == want
    assert np.allclose(model.margin_of(bins), margin)
    assert model.base == pytest.approx(math.log(np.sum(w * y) / np.sum(w * (1 - y))))


def test_predict_and_leaf_columns(spark, binned):
    model, = B.train(binned, [(B.Params(num_leaves=5, n_estimators=2, learning_rate=0.3, min_child_samples=5), -1)])
    df = spark.createDataFrame(frame(), "id long, a double, b double, `c d` double, y int, w double, fold int")
    margin = F.lit(model.base)
    for t in model.trees:
        margin = margin + F.element_at(F.array(*map(F.lit, t.value)), model.leaf_column(t) + 1)
    got = model.predict(df.withColumn("m", margin)).collect()
    assert all(r.probability == pytest.approx(1 / (1 + math.exp(-r.m))) for r in got) and len(got) == len(frame())
    nodes = model.table(spark).collect()
    assert sum(r.n for r in nodes if r["left"] < 0 and r.round == 1) == len(got)


def test_patience_stops_and_keeps_the_best(binned):
    p = B.Params(num_leaves=4, n_estimators=60, learning_rate=0.5, min_child_samples=5)
    model, = B.train(binned, [(p, 0)], patience=3)
    assert model.stopped and len(model.history) == model.best_round + 3 < 60
    assert model.history[model.best_round - 1] == max(model.history) > 0.7
    assert len(model.used()) == model.best_round
    held = [i for i, r in enumerate(frame()) if r[6] == 0]
    score, y = model.margin_of(plain_bins(binned)[held]), np.array([frame()[i][4] for i in held])
    step = np.rint(B.AUC_STEPS / (1 + np.exp(-score)))
    pairs = [(a > b) + (a == b) / 2 for a in step[y == 1] for b in step[y == 0]]
    assert model.history[model.best_round - 1] == pytest.approx(np.mean(pairs))


def test_training_goes_on_where_it_stopped(binned):
    p = B.Params(num_leaves=4, n_estimators=4, learning_rate=0.3, min_child_samples=5)
    whole, = B.train(binned, [(p, 1)])
    half = B.train(binned, [(B.replace(p, n_estimators=2), 1)])
    rest, = B.train(binned, [(p, 1)], start=half)
    assert [paths(t) for t in rest.trees] == [paths(t) for t in whole.trees]
    assert rest.history == pytest.approx(whole.history)


def test_models_share_passes_without_meeting(binned):
    ps = [(B.Params(num_leaves=4, n_estimators=3, learning_rate=0.3, min_child_samples=5, subsample=0.7, subsample_freq=1,
                    colsample_bytree=0.7, seed=s), g) for s, g in ((1, 0), (1, 1), (2, 0))]
    together = B.train(binned, ps)
    for one, m in zip(ps, together):
        alone, = B.train(binned, [one])
        assert [paths(t) for t in alone.trees] == [paths(t) for t in m.trees]
    assert paths(together[0].trees[0]) != paths(together[2].trees[0])


def test_search_space_and_best(spark, binned):
    for p in B.draws_of(B.SPACE, 200, seed=3):
        assert all(s.low <= getattr(p, k) <= s.high for k, s in B.SPACE.items())
        assert isinstance(p.num_leaves, int)
    logs = [math.log10(p.reg_alpha) for p in B.draws_of(B.SPACE, 2000)]
    assert abs(np.mean(logs) + 1.5) < 0.1       # log-uniform between 1e-4 and 10
    space = dict(B.SPACE) | {"n_estimators": [3], "min_child_samples": B.Integers(2, 10)}
    table, best = B.random_search(binned, space, draws=3, folds=3)
    rows = table.collect()
    assert len(rows) == 3 and sum(r.is_best for r in rows) == 1
    top = next(r for r in rows if r.is_best)
    assert top.mean_auc == max(r.mean_auc for r in rows) and best.num_leaves == top.num_leaves


def test_odd_tables(spark):
    shape = "id long, a double, y int"
    none = B.bin_features(spark.createDataFrame([], shape), ["a"], "id", "y")
    assert B.train(none, [(B.Params(), -1)])[0].trees == []
    same = B.bin_features(spark.createDataFrame([(i, None, i % 2) for i in range(9)] + [(1, 2.0, None)], shape), ["a"], "id", "y")
    model, = B.train(same, [(B.Params(n_estimators=2), -1)])
    assert [t.left for t in model.trees] == [[-1], [-1]] and same.rows.count() == 9
