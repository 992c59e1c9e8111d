"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each) with one label.
Every passage is described by what holds for any language - shares of its
characters, hashed words, repetition, word shapes - and encoded by a learned
layer.  Gated attention, learned from document labels only, weighs the
passages; the weighted sum of their codes is the document's representation,
and a logistic unit scores it (Ilse, Tomczak and Welling, 2018).

Scale: ``fit`` learns from at most about ``TRAIN_DOCS`` labelled rows, taken by
a threshold on a hash of the id, and ``BAG`` passages of each, taken evenly
over the text (documented bounds: a classifier may learn from a sample); only
their features, 2 bytes a number, reach the driver.  ``score`` is one narrow
pass over whole texts: attention is summed as a running softmax, text parts of
``PART`` bytes at a time, so memory does not depend on a text's length.  No
text is shuffled; the model (under 100 kB) is the only thing broadcast.

Edge cases: null, empty and blank texts are empty bags, whose representation
is zero; rows with one id all use the labels of that id, several labels of an
id are averaged, null labels and null ids teach nothing; without labelled rows
every score is 0.5; an empty table gives an empty result; result columns stand
beside ``row``, so no column name clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 64
PART = 1 << 20
TRAIN_DOCS = 6000
BAG = 256
HASHED = 128
CODES, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.004, 1e-4
SEED = 42
_BYTES = 129            # one bin a 7-bit character, one for all longer ones
_SHAPES = 10
FEATURES = _BYTES + HASHED + _SHAPES
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True


def parts(text: bytes, size: int = PART) -> list[bytes]:
    """``text`` cut at white space into parts of about ``size`` bytes."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, which text it is of), in order."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _BLANK[data] if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(start):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    # words are dealt to passages of their text
    first_of = np.flatnonzero(np.r_[True, np.diff(of) != 0])
    place = np.arange(len(start)) - np.repeat(first_of, np.diff(np.r_[first_of, len(start)]))
    fresh = place % PASSAGE == 0
    passage = np.cumsum(fresh) - 1
    n = int(passage[-1]) + 1
    n_words = np.bincount(passage, minlength=n).astype(np.float32)
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    inside = np.flatnonzero(~blank)
    chars = data[inside]
    n_chars = np.bincount(passage, weights=size, minlength=n)
    bins = np.bincount(passage[word] * _BYTES + np.minimum(chars, 128), minlength=n * _BYTES).reshape(n, _BYTES)
    power = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
    h = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * power[(inside - start[word]) & 63],
                        np.cumsum(size) - size)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(40)).astype(np.int64) % HASHED
    words = np.bincount(passage * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED)
    mean = lambda x: np.bincount(passage, weights=x, minlength=n) / n_words
    order = np.lexsort((h, passage))
    distinct = np.r_[True, (np.diff(h[order]) != 0) | (np.diff(passage[order]) != 0)]
    same = lambda k: np.r_[np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (passage[k:] == passage[:-k])]
    upper = np.add.reduceat(_UPPER[chars].astype(np.int64), np.cumsum(size) - size)
    letters = np.add.reduceat(_LETTER[chars].astype(np.int64), np.cumsum(size) - size)
    line_end = data[np.minimum(end, len(data) - 1)] == 10
    shapes = [np.log1p(n_words), mean(size), np.sqrt(np.maximum(mean(size.astype(float) ** 2) - mean(size) ** 2, 0)),
              mean((upper > 1) & (upper == letters)), mean(_UPPER[data[start]]), mean(~_LETTER[data[end - 1]]),
              np.bincount(passage[order], weights=distinct, minlength=n) / n_words, mean(same(1)), mean(same(2)), mean(line_end)]
    x = np.concatenate([bins / n_chars[:, None], words / n_words[:, None], np.stack(shapes, 1)], 1).astype(np.float32)
    return x, of[fresh]


# ------------------------------------------------------------------ the model
@dataclass
class Model:
    """Weights of the network and the scale of its inputs."""
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def blank() -> "Model":
        rng = np.random.default_rng(SEED)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), {
            "W": draw(FEATURES, CODES), "b": np.zeros(CODES, np.float32), "V": draw(CODES, GATES),
            "U": draw(CODES, GATES), "w": draw(GATES), "c": np.zeros(CODES, np.float32), "d": np.zeros(1, np.float32)})

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inputs, codes, both halves of the gate, attention score)."""
        q = self.weights
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ q["W"] + q["b"])
        t, g = np.tanh(h @ q["V"]), 1 / (1 + np.exp(-(h @ q["U"])))
        return x, h, t, g, (t * g) @ q["w"]


def _gradient(model: Model, x: np.ndarray, bag: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss over bags 0..n-1; ``bag`` is sorted."""
    q, n = model.weights, len(target)
    x, h, t, g, e = model.encode(x)
    starts = np.searchsorted(bag, np.arange(n))
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    out = ((1 / (1 + np.exp(-(z @ q["c"] + q["d"][0]))) - target) / n).astype(np.float32)
    dz = out[:, None] * q["c"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    gate = de[:, None] * q["w"]
    dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ q["V"].T + dg @ q["U"].T) * (1 - h * h)
    grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out,
            "d": out.sum(keepdims=True)}
    return {k: v + DECAY * q[k] if k in "WVU" else v for k, v in grad.items()}


def train(x: np.ndarray, bag: np.ndarray, target: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Model of bags 0..n-1 (``bag`` sorted, every bag filled) by Adam."""
    model = Model.blank()
    if not len(target):
        return model
    model.mean = x.mean(0)
    model.scale = x.std(0) + 1e-3
    share = np.clip(target.mean(), 0.01, 0.99)
    model.weights["d"][0] = np.log(share / (1 - share))
    starts = np.append(np.searchsorted(bag, np.arange(len(target))), len(bag))
    rng = np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    s = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, steps = 0, epochs * -(-len(target) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for i in range(0, len(order), BATCH):
            bags = order[i:i + BATCH]
            rows = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in bags])
            within = np.repeat(np.arange(len(bags)), starts[bags + 1] - starts[bags])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, grad in _gradient(model, x[rows], within, target[bags]).items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                model.weights[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id: str = "doc_id", text: str = "text",
        label: str = "quality", docs_limit: int = TRAIN_DOCS) -> Model:
    """Model of ``labels`` (0 to 1) over the texts of ``docs``; ``learn`` (over
    the labels' columns) says which labels may teach."""
    rows = labels if learn is None else labels.filter(learn)
    known = rows.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id}`").isNotNull()).groupBy(
        F.col(f"`{id}`").alias("id")).agg(F.avg(F.col(f"`{label}`").cast("double")).alias("target"))
    n = known.count()
    # a threshold on a hash of the id takes about ``docs_limit`` of them
    h = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)).alias("h")
    sample = known.select("id", "target", h).filter(F.col("h") < int((1 << 30) * min(1.0, docs_limit / max(n, 1))))
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # at most about ``docs_limit`` ids and numbers
    chosen = texts.join(F.broadcast(sample), "id").select("h", "target", F.xxhash64("text").alias("tie"), "text")

    def run(batches):
        for b in batches:
            out = {"h": [], "tie": [], "target": [], "x": []}
            for h, target, tie, t in zip(*[b.column(i).to_pylist() for i in range(4)]):
                x = np.concatenate([describe([p])[0] for p in parts((t or "").encode())])
                if len(x):
                    x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), BAG)).astype(int))]
                    for k, v in (("h", h), ("tie", tie), ("target", target), ("x", x.astype("<f2").tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("h", pa.int64()), ("tie", pa.int64()), ("target", pa.float64()), ("x", pa.binary())]))

    got = chosen.mapInArrow(run, "h long, tie long, target double, x binary").toArrow().sort_by(
        [("h", "ascending"), ("tie", "ascending")]).to_pydict()
    bags = [np.frombuffer(x, "<f2").reshape(-1, FEATURES) for x in got["x"]]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, FEATURES), np.float32)
    return train(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array(got["target"], np.float32))


class _Sums:
    """Running softmax-weighted sums of one document's passage codes."""

    def __init__(self):
        self.top, self.total, self.code, self.n, self.focus, self.best = -np.inf, 0.0, np.zeros(CODES), 0, None, -np.inf

    def add(self, h: np.ndarray, e: np.ndarray) -> None:
        i = int(np.argmax(e))
        if e[i] > self.best:
            self.best, self.focus = float(e[i]), self.n + i
        top = max(self.top, float(e[i]))
        old = np.exp(self.top - top)
        a = np.exp(e.astype(np.float64) - top)
        self.total = self.total * old + a.sum()
        self.code = self.code * old + a @ h
        self.top = top
        self.n += len(e)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (struct of all columns), ``score``, ``n_passages``, ``focus``
    (the passage that weighs most, from 0) and ``focus_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        q = model.weights
        for b in batches:
            sums = [_Sums() for _ in range(b.num_rows)]
            group, owner, held = [], [], 0

            def flush():
                x, of = describe(group)
                if len(of):
                    _, h, _, _, e = model.encode(x)
                    cuts = np.flatnonzero(np.r_[True, np.diff(of) != 0, True])
                    for i, j in zip(cuts[:-1], cuts[1:]):
                        sums[owner[of[i]]].add(h[i:j], e[i:j])

            for i, t in enumerate(b.column(1).cast(pa.binary())):
                for part in parts(t.as_py() or b""):
                    group.append(part)
                    owner.append(i)
                    held += len(part)
                    if held >= PART:
                        flush()
                        group, owner, held = [], [], 0
            if group:
                flush()
            code = np.array([s.code / s.total if s.n else s.code for s in sums]).reshape(len(sums), CODES)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(1 / (1 + np.exp(-(code @ q["c"] + q["d"][0].astype(np.float64))))),
                pa.array([s.n for s in sums], pa.int64()), pa.array([s.focus for s in sums], pa.int64()),
                pa.array([float(np.exp(s.best - s.top) / s.total) if s.n else None for s in sums], pa.float64())],
                ["row", "score", "n_passages", "focus", "focus_weight"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    shape = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()),
                          T.StructField("focus", T.LongType()), T.StructField("focus_weight", T.DoubleType())])
    return rows.mapInArrow(run, shape)
