"""The passage classifier: gradients, whole bags, edge cases, held-out accuracy."""

import random

import numpy as np
import pytest

from creditframe.llm import passages
from pyspark.sql import functions as F


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "Éon", "thing", "under", "way", "went,", "down", "hill.", "is", "and", "a"]
    out = []
    for i in range(n):
        k = rng.choice([5, 40, 200, 700])
        good = [rng.choice(words) for _ in range(k)]
        if i % 3 == 0:      # a part of the document is junk
            at = rng.randrange(k)
            good[at:at + 60] = [rng.choice(["BUY!!", "x | y", "%%%&", "spam spam"]) for _ in range(60)]
        out.append((i, " ".join(good), int(i % 3 != 0)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(corpus(300, 1), "doc_id long, text string, quality int")
    return passages.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"), F.col("doc_id") % 5 != 0)


def direct(model, text):
    """Score of one text by the definition, all passages at once."""
    x = np.concatenate([passages.describe([p])[0] for p in passages.parts((text or "").encode())])
    q = model.weights
    z = np.zeros(passages.CODES)
    if len(x):
        _, h, _, _, e = model.encode(x)
        a = np.exp(e - e.max())
        z = (a / a.sum()) @ h
    return 1 / (1 + np.exp(-(z @ q["c"] + q["d"][0])))


def test_held_out_accuracy(spark, model):
    rows = corpus(300, 1)
    found = {r.row.doc_id: r.score for r in passages.score(
        spark.createDataFrame(rows, "doc_id long, text string, quality int"), model).collect()}
    held = [(found[i] >= 0.5) == bool(q) for i, _, q in rows if i % 5 == 0]
    assert sum(held) / len(held) > 0.95


def test_scores_follow_the_definition(spark, model, monkeypatch):
    texts = [t for _, t, _ in corpus(12, 5)] + ["", None, "  \n", "é" * 500, "word " * 3000, "one"]
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, `row` string, `a.b c` double")
    found = {r.row.doc_id: r for r in passages.score(rows.repartition(3), model).collect()}
    for i, t in enumerate(texts):
        assert found[i].score == pytest.approx(direct(model, t), abs=1e-5)
        assert found[i].n_passages == -(-len((t or "").split()) // passages.PASSAGE)
        assert (found[i].focus is None) == (not (t or "").split())


def test_long_text_in_parts(model):
    text = " ".join(f"w{i % 50}" for i in range(20_000))
    small = passages.parts(text.encode(), 1000)
    assert b"".join(small) == text.encode() and max(map(len, small)) < 1100
    x = np.concatenate([passages.describe([p])[0] for p in small])
    _, h, _, _, e = model.encode(x)
    sums = passages._Sums()
    for i in range(0, len(x), 7):
        sums.add(h[i:i + 7], e[i:i + 7])
    a = np.exp(e - e.max())
    assert np.allclose(sums.code / sums.total, (a / a.sum()) @ h, atol=1e-5)
    assert sums.focus == int(np.argmax(e)) and sums.n == len(x)


def test_describe_by_hand():
    x, of = passages.describe([b"", b"AB ab ab, ab", b" \n", b"z"])
    assert of.tolist() == [1, 3]
    shapes = x[0, -passages._SHAPES:]
    assert shapes[1] == pytest.approx(9 / 4) and shapes[3] == pytest.approx(1 / 4)      # mean size, upper-case words
    assert shapes[6] == pytest.approx(3 / 4) and shapes[7] == 0 and shapes[8] == pytest.approx(1 / 4)      # distinct; ab ab, ab
    assert x[0, ord("a")] == pytest.approx(3 / 9)
    assert x[0, 129:129 + passages.HASHED].sum() == pytest.approx(1)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    model = passages.Model.blank()
    model.weights = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in model.weights.items()}
    x = rng.standard_normal((9, passages.FEATURES))
    bag, target = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 0.3])

    def loss():
        out = 0.0
        for j in range(3):
            _, h, _, _, e = model.encode(x[bag == j])
            a = np.exp(e - e.max())
            o = (a / a.sum()) @ h @ model.weights["c"] + model.weights["d"][0]
            out += np.log1p(np.exp(o)) - target[j] * o
        return out / 3 + passages.DECAY / 2 * sum((model.weights[k] ** 2).sum() for k in "WVU")

    grad = passages._gradient(model, x, bag, target)
    for k, v in model.weights.items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        keep, step = v[i], 1e-5
        v[i] = keep + step
        up = loss()
        v[i] = keep - step
        down = loss()
        v[i] = keep
        assert grad[k][i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def test_labels_odd_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (None, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    model = passages.fit(docs, labels)
    assert passages.score(docs, model).count() == 4
    none = passages.fit(docs, labels.limit(0))
    assert {r.score for r in passages.score(docs, none).collect()} == {0.5}
    assert passages.score(docs.limit(0), none).collect() == []
