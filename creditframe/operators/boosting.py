"""Boosted trees from gradient histograms (M3), patience (M6), random search (M4).

A feature table is binned once (``bin_features``: quantile edges from one
aggregate, one byte a value, written to the shared checkpoint folder).  A tree
grows from histograms: every pass over the binned table sums gradient, hessian
and rows per (model, node, feature, bin) inside the tasks and by one Spark
aggregate; only these cells - at most nodes x features x bins a model, never
rows - reach the driver, which finds the best splits.

Growth is leaf-wise with a limit on leaves: the leaf with the largest gain is
split next.  Passes look ahead: all leaves that can still be among the chosen
are split at once, and the order of gains then decides which of them the tree
keeps, so a tree of 31 leaves needs about as many passes as it has levels.

Several models (folds and draws of a search) share the binned table and every
pass; each has its own margins, kept as a column and written every
``KEEP_EVERY`` rounds.  In between margins follow from the trees since then,
so a lost executor costs a pass.  Validation rows of a model are those of its
``held`` group; their AUC per round comes with the first pass of the next
round, and a model stops after ``patience`` rounds without a better one.

Edge cases: null and NaN values are a bin of their own, left of all others;
rows without a label are left out; null weights count as 1; null groups are
trained on by all; a table without rows gives a model without trees.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .ordered import _n_below

MAX_BINS = 64
KEEP_EVERY = 20
#: AUC is taken over probabilities in steps of 1 / AUC_STEPS.
AUC_STEPS = 1 << 12


@dataclass(frozen=True)
class Params:
    """The 12 searched parameters, by the names the trainers share, and a seed."""
    num_leaves: int = 31
    max_depth: int = 7
    learning_rate: float = 0.05
    n_estimators: int = 500
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    min_split_gain: float = 0.0
    subsample_freq: int = 0
    seed: int = 42


# --------------------------------------------------------------------- binning
@dataclass(frozen=True)
class Binned:
    """``rows``: h, y, w, grp, bins; ``edges`` per feature, ascending: bin b
    holds values in (edge[b - 2], edge[b - 1]], bin 0 nulls."""
    rows: DataFrame
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]

    @property
    def n_bins(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2


def _value(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


def quantile_edges(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> tuple[tuple[float, ...], ...]:
    """Distinct approximate quantiles of every feature, from one aggregate."""
    probs = [i / (max_bins - 1) for i in range(1, max_bins - 1)]
    row = df.agg(*[F.percentile_approx(_value(f), probs, 20 * max_bins).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return tuple(tuple(sorted(set(row[i] or []))) for i in range(len(features)))


def bin_features(df: DataFrame, features: Sequence[str], key: str, label: str, *, weight: str | None = None,
                 group: str | None = None, max_bins: int = MAX_BINS, edges: Sequence[Sequence[float]] | None = None) -> Binned:
    """The binned table of ``df``; ``group`` numbers the folds or splits."""
    df = df.filter(F.col(f"`{label}`").isNotNull())
    edges = tuple(map(tuple, edges)) if edges is not None else quantile_edges(df, features, max_bins)
    assert max(map(len, edges), default=0) < 126
    bins = []
    for f, e in zip(features, edges):
        v = _value(f)
        below = _n_below(F.array(*map(F.lit, e)), v, len(e)) if e else F.lit(0)
        bins.append(F.when(v.isNull(), 0).otherwise(1 + below).cast("tinyint"))
    path = scratch_path(df.sparkSession, "binned")
    df.select(F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), F.col(f"`{label}`").cast("double").alias("y"),
              (F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"),
              (F.coalesce(F.col(f"`{group}`").cast("int"), F.lit(-1)) if group else F.lit(-1)).alias("grp"),
              F.array(*bins).alias("bins")).write.parquet(path)
    return Binned(df.sparkSession.read.parquet(path), tuple(features), edges)


# ----------------------------------------------------------------------- trees
@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root, ``left`` is -1 for a leaf."""
    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    up: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    g: list[float] = field(default_factory=lambda: [0.0])
    h: list[float] = field(default_factory=lambda: [0.0])
    n: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, i: int, feature: int, bin: int, gain: float) -> int:
        """Number of the left child; the right one follows it."""
        self.feature[i], self.bin[i], self.gain[i] = feature, bin, gain
        self.left[i] = len(self.left)
        for _ in range(2):
            for name, empty in (("feature", 0), ("bin", 0), ("left", -1), ("up", i), ("depth", self.depth[i] + 1),
                                ("gain", 0.0), ("g", 0.0), ("h", 0.0), ("n", 0), ("value", 0.0)):
                getattr(self, name).append(empty)
        return self.left[i]

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row of ``bins``."""
        feature, bin, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(max(self.depth)):
            go = left[node] >= 0
            node = np.where(go, left[node] + (bins[rows, feature[node]] > bin[node]), node)
        return node

    def kept(self, split: set[int]) -> "Tree":
        """The tree in which only the nodes of ``split`` are split."""
        out, at = Tree(), [(0, 0)]
        for old, new in at:
            for name in ("g", "h", "n", "value"):
                getattr(out, name)[new] = getattr(self, name)[old]
            if old in split:
                first = out.split(new, self.feature[old], self.bin[old], self.gain[old])
                at += [(self.left[old], first), (self.left[old] + 1, first + 1)]
        return out


def _shrunk(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _score(g, h, p: Params):
    return _shrunk(g, p.reg_alpha) ** 2 / np.maximum(h + p.reg_lambda, 1e-12)


def leaf_value(g: float, h: float, p: Params) -> float:
    return float(-p.learning_rate * _shrunk(g, p.reg_alpha) / max(h + p.reg_lambda, 1e-12))


def best_split(cells: np.ndarray, columns: Iterable[int], p: Params) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node from its histogram
    (feature, bin, [g, h, n]); equal gains go to the first feature and bin."""
    columns = list(columns)
    left = np.cumsum(cells[columns], 1)[:, :-1]
    whole = cells[columns[0]].sum(0)
    right = whole - left
    gain = (_score(left[..., 0], left[..., 1], p) + _score(right[..., 0], right[..., 1], p) - _score(whole[0], whole[1], p))
    fine = ((np.minimum(left[..., 2], right[..., 2]) >= max(1, p.min_child_samples))
            & (np.minimum(left[..., 1], right[..., 1]) >= p.min_child_weight) & (gain > max(p.min_split_gain, 1e-12)))
    if not fine.any():
        return None
    gain = np.where(fine, gain, -np.inf)
    top = gain.max()
    # sums differ in the last digits from run to run
    f, b = np.argwhere(gain >= top - 1e-9 * max(1.0, abs(top)))[0]
    return float(top), columns[f], int(b)


class _Growing:
    """One tree of one model while it grows."""

    def __init__(self, p: Params, columns: list[int]):
        self.p, self.columns, self.tree = p, columns, Tree()
        self.best: dict[int, tuple[float, int, int] | None] = {}
        self.ask = [0]              # nodes whose histogram the next pass brings

    def learn(self, cells: dict[int, np.ndarray]) -> None:
        """Histograms of ``ask``; splits what may be chosen, or ends."""
        t, p = self.tree, self.p
        for i in self.ask:
            c = cells.get(i)
            g, h, n = c[self.columns[0]].sum(0) if c is not None else (0.0, 0.0, 0)
            t.g[i], t.h[i], t.n[i], t.value[i] = float(g), float(h), int(round(n)), leaf_value(g, h, p)
            self.best[i] = best_split(c, self.columns, p) if c is not None and t.depth[i] < p.max_depth else None
        chosen, able = self.chosen()
        self.ask = []
        for i in able[:p.num_leaves - 1 - len(chosen)]:
            first = t.split(i, self.best[i][1], self.best[i][2], self.best[i][0])
            self.ask += [first, first + 1]

    def chosen(self) -> tuple[set[int], list[int]]:
        """Nodes that leaf-wise growth splits as far as it can tell, and the
        nodes to split ahead: first the one it comes to next."""
        t, leaves, done = self.tree, [0], set()
        by_gain = lambda i: (-self.best[i][0], i)
        while len(done) < self.p.num_leaves - 1:
            able = [i for i in leaves if self.best.get(i)]
            if not able:
                break
            i = min(able, key=by_gain)
            if t.left[i] < 0:
                ahead = [j for j, x in self.best.items() if x and t.left[j] < 0 and j != i]
                return done, [i, *sorted(ahead, key=by_gain)]
            done.add(i)
            leaves.remove(i)
            leaves += [t.left[i], t.left[i] + 1]
        return done, []

    def finished(self) -> Tree:
        return self.tree.kept(self.chosen()[0])


# ---------------------------------------------------------------------- models
@dataclass
class Boosted:
    """Trees of one model, its start margin and the validation AUC per round."""
    params: Params
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    trees: list[Tree]
    history: list[float]
    best_round: int
    stopped: bool

    def used(self) -> list[Tree]:
        """The trees up to the best round."""
        return self.trees[:self.best_round]

    def margin_of(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.used():
            out += np.array(t.value)[t.route(bins)]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a node: round, node, up, depth, feature, threshold (null
        values go left), gain, g, h, n, value."""
        rows = []
        for r, t in enumerate(self.trees, 1):
            for i, left in enumerate(t.left):
                f = t.feature[i]
                edge = self.edges[f][t.bin[i] - 1] if left >= 0 and 0 < t.bin[i] <= len(self.edges[f]) else None
                rows.append((r, i, t.up[i], left, t.depth[i], self.features[f] if left >= 0 else None, edge,
                             t.gain[i] if left >= 0 else None, t.g[i], t.h[i], t.n[i], t.value[i]))
        return spark.createDataFrame(rows, "round int, node int, up int, `left` int, depth int, feature string, threshold double, "
                                           "gain double, g double, h double, n long, value double")

    def leaf_column(self, tree: Tree) -> Column:
        """Leaf number of a row from its feature values, in built-in expressions."""
        def at(i: int) -> Column:
            if tree.left[i] < 0:
                return F.lit(i)
            f, b = tree.feature[i], tree.bin[i]
            v = _value(self.features[f])
            right = v.isNotNull() if b == 0 else F.coalesce(v > F.lit(float(self.edges[f][b - 1])), F.lit(False))
            return F.when(right, at(tree.left[i] + 1)).otherwise(at(tree.left[i]))
        return at(0)

    def predict(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """``df`` with the probability of label 1 (one narrow pass)."""
        values = F.array(*[_value(f) for f in self.features])
        model = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            m = model.value
            n = len(m.features)
            for b in batches:
                x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                bins = np.stack([np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left"))
                                 for j, e in enumerate(m.edges)], 1) if n else np.zeros((b.num_rows, 0), int)
                p = 1 / (1 + np.exp(-m.margin_of(bins)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["row", "p"])

        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), values.alias("x"))
        shape = T.StructType([packed.schema["row"], T.StructField("p", T.DoubleType())])
        return packed.mapInArrow(run, shape).select("row.*", F.col("p").alias(out))


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys, another sequence for every seed."""
    x = h.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


@dataclass
class _Pass:
    """What tasks need: per model its params, trees since the margins were
    written, the growing tree, the nodes asked for, and what to sample."""
    params: list[Params]
    held: list[int]
    margin_at: list[int]        # place in the margins column, -1: none yet
    base: list[float]
    since: list[list[Tree]]
    growing: list[Tree | None]
    ask: list[list[int]]
    round: int
    judge: list[bool]
    n_bins: int
    n_features: int


def _rows_of(batch: pa.RecordBatch, n_features: int):
    h, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
    grp = batch.column(3).to_numpy(zero_copy_only=False)
    bins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
    margins = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_columns > 5 else None
    return h, y, w, grp, bins, margins


def _margin(job: _Pass, m: int, bins: np.ndarray, margins) -> np.ndarray:
    out = np.full(len(bins), job.base[m]) if margins is None or job.margin_at[m] < 0 else margins[:, job.margin_at[m]].copy()
    for t in job.since[m]:
        out += np.array(t.value)[t.route(bins)]
    return out


def _sum_cells(job: _Pass, batches) -> Iterable[pa.RecordBatch]:
    """Partial histograms of all models: (model, cell, g, h, n)."""
    width = job.n_features * job.n_bins
    hist = {m: np.zeros((len(a) * width, 3)) for m, a in enumerate(job.ask) if a}
    ranks = {m: np.zeros((AUC_STEPS + 1, 2)) for m, j in enumerate(job.judge) if j}
    for b in batches:
        h, y, w, grp, bins, margins = _rows_of(b, job.n_features)
        for m, p in enumerate(job.params):
            if m not in hist and m not in ranks:
                continue
            prob = 1 / (1 + np.exp(-_margin(job, m, bins, margins)))
            if m in ranks:
                mine = grp == job.held[m]
                step = np.rint(prob[mine] * AUC_STEPS).astype(int)
                for side, label in enumerate((y[mine] > 0.5, y[mine] <= 0.5)):
                    ranks[m][:, side] += np.bincount(step[label], minlength=AUC_STEPS + 1)
            if m not in hist:
                continue
            slot_of = np.full(len(job.growing[m].left), -1)
            slot_of[job.ask[m]] = np.arange(len(job.ask[m]))
            slot = slot_of[job.growing[m].route(bins)]
            take = (slot >= 0) & ((grp != job.held[m]) | (job.held[m] < 0))
            if p.subsample < 1 and p.subsample_freq > 0:
                take &= _uniform(h, p.seed + 7919 * ((job.round - 1) // p.subsample_freq)) < p.subsample
            at = np.flatnonzero(take)
            if not len(at):
                continue
            g, hess = w[at] * (prob[at] - y[at]), w[at] * prob[at] * (1 - prob[at])
            for f in range(job.n_features):
                cell = slot[at] * width + f * job.n_bins + bins[at, f]
                size = len(hist[m])
                for k, x in enumerate((g, hess, None)):
                    hist[m][:, k] += np.bincount(cell, weights=x, minlength=size)
    for m, x in hist.items():
        cell = np.flatnonzero(x[:, 2])
        yield pa.RecordBatch.from_pydict({"model": np.full(len(cell), m, np.int32), "cell": cell.astype(np.int64),
                                          "g": x[cell, 0], "h": x[cell, 1], "n": x[cell, 2].astype(np.int64)})
    for m, x in ranks.items():
        cell = np.flatnonzero(x.sum(1))
        yield pa.RecordBatch.from_pydict({"model": np.full(len(cell), m, np.int32), "cell": -1 - cell.astype(np.int64),
                                          "g": x[cell, 0], "h": x[cell, 1], "n": np.ones(len(cell), np.int64)})


def auc_of_steps(pos: np.ndarray, neg: np.ndarray) -> float:
    """AUC from positives and negatives per ascending score; nan with one class."""
    below = np.cumsum(neg) - neg
    whole = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / whole) if whole else math.nan


def train(binned: Binned, models: Sequence[tuple[Params, int]], *, patience: int | None = None,
          start: Sequence[Boosted] | None = None) -> list[Boosted]:
    """One model per (params, held group); -1 holds nothing out.

    ``start`` goes on from models trained before on the same binned table
    (``n_estimators`` counts the trees of both runs).
    """
    spark, rows = binned.rows.sparkSession, binned.rows
    n_features, n_bins, count = len(binned.features), binned.n_bins, len(models)
    params, held = [p for p, _ in models], [g for _, g in models]
    sums = rows.groupBy("grp").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("w")).collect()  # one a group
    out = []
    for m, (p, g) in enumerate(models):
        pos, all_ = (sum(r[c] for r in sums if g < 0 or r.grp != g) for c in ("p", "w"))
        share = min(max(pos / all_, 1e-6), 1 - 1e-6) if all_ else 0.5
        was = start[m] if start else None
        out.append(Boosted(p, binned.features, binned.edges, was.base if was else math.log(share / (1 - share)),
                           list(was.trees) if was else [], list(was.history) if was else [], was.best_round if was else 0, False))
    since: list[list[Tree]] = [list(b.trees) for b in out]
    at, state = [-1] * count, rows
    live = set(range(count)) if sums else set()
    judge = [False] * count
    done = [len(b.trees) for b in out]

    def run_pass(growing: list[_Growing | None], round_: int):
        job = _Pass(params, held, at, [b.base for b in out], since, [g.tree if g else None for g in growing],
                    [g.ask if g else [] for g in growing], round_, list(judge), n_bins, n_features)
        shared = spark.sparkContext.broadcast(job)
        cells = state.mapInArrow(lambda batches: _sum_cells(shared.value, batches),
                                 "model int, cell long, g double, h double, n long")
        # at most (nodes x features x bins + AUC_STEPS) cells a model
        got = cells.groupBy("model", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        model, cell = got.column("model").to_numpy(), got.column("cell").to_numpy()
        value = np.stack([got.column(c).to_numpy().astype(float) for c in ("g", "h", "n")], 1)
        return model, cell, value

    while live:
        growing: list[_Growing | None] = [None] * count
        for m in sorted(live):
            if done[m] < params[m].n_estimators:
                rng = random.Random(f"{params[m].seed}:{done[m]}")
                k = max(1, round(params[m].colsample_bytree * n_features))
                growing[m] = _Growing(params[m], sorted(rng.sample(range(n_features), k)))
        while any(g and g.ask for g in growing) or any(judge):
            model, cell, value = run_pass(growing, max((done[m] for m in live), default=0) + 1)
            for m in range(count):
                mine = model == m
                if judge[m]:
                    rank = mine & (cell < 0)
                    order = np.argsort(-cell[rank], kind="stable")
                    _judged(out[m], auc_of_steps(*value[rank][order][:, :2].T), patience)
                    judge[m] = False
                    if out[m].stopped:
                        live.discard(m)
                        growing[m] = None
                if growing[m] and growing[m].ask:
                    x = np.zeros((len(growing[m].ask), n_features, n_bins, 3))
                    hist = mine & (cell >= 0)
                    x.reshape(-1, 3)[cell[hist]] = value[hist]
                    growing[m].learn(dict(zip(growing[m].ask, x)))
        for m in sorted(live):
            if growing[m] is None:
                live.discard(m)
                continue
            tree = growing[m].finished()
            out[m].trees.append(tree)
            since[m].append(tree)
            done[m] += 1
            if held[m] >= 0:
                judge[m] = True
            else:
                out[m].best_round = len(out[m].trees)
        if max((len(s) for s in since), default=0) >= KEEP_EVERY:
            state = _with_margins(state, rows, params, held, at, [b.base for b in out], since, n_bins, n_features)
            at, since = list(range(count)), [[] for _ in out]
    return out


def _judged(model: Boosted, auc: float, patience: int | None) -> None:
    """The stopping rule: round r is best while no later AUC is larger."""
    model.history.append(auc)
    best = max((a for a in model.history if not math.isnan(a)), default=math.nan)
    model.best_round = next((i for i, a in enumerate(model.history, 1) if a == best), len(model.history))
    model.stopped = patience is not None and len(model.history) - model.best_round >= patience


def _with_margins(state, rows, params, held, at, base, since, n_bins, n_features) -> DataFrame:
    spark = rows.sparkSession
    job = _Pass(params, held, list(at), base, [list(s) for s in since], [None] * len(params), [[]] * len(params), 0, [], n_bins, n_features)
    shared = spark.sparkContext.broadcast(job)

    def run(batches):
        job = shared.value
        for b in batches:
            _, _, _, _, bins, margins = _rows_of(b, job.n_features)
            x = np.stack([_margin(job, m, bins, margins) for m in range(len(job.params))], 1)
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))],
                                             ["h", "y", "w", "grp", "bins", "margins"])

    path = scratch_path(spark, "margins")
    state.mapInArrow(run, "h long, y double, w double, grp int, bins array<tinyint>, margins array<double>").write.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------- search
@dataclass(frozen=True)
class Integers:
    """Uniform integers in [low, high)."""
    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randrange(self.low, self.high)


@dataclass(frozen=True)
class Uniform:
    """Uniform numbers in [low, high)."""
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return self.low + (self.high - self.low) * rng.random()


@dataclass(frozen=True)
class LogUniform:
    """Numbers whose logarithm is uniform in [log low, log high)."""
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(math.log(self.low) + (math.log(self.high) - math.log(self.low)) * rng.random())


#: The 12-parameter space of the published search.
SPACE: Mapping[str, Integers | Uniform | LogUniform] = {
    "num_leaves": Integers(15, 50), "max_depth": Integers(3, 12), "learning_rate": LogUniform(0.01, 0.2),
    "n_estimators": Integers(100, 1500), "min_child_samples": Integers(50, 500),
    "min_child_weight": LogUniform(1e-4, 1e-1), "subsample": Uniform(0.6, 1.0), "colsample_bytree": Uniform(0.6, 1.0),
    "reg_alpha": LogUniform(1e-4, 10), "reg_lambda": LogUniform(1e-4, 10), "min_split_gain": LogUniform(1e-4, 1e-1),
    "subsample_freq": Integers(1, 10)}


def draws_of(space: Mapping, draws: int, seed: int = 42) -> list[Params]:
    """``draws`` parameter sets; a space may also hold lists to choose from."""
    rng = random.Random(seed)
    out = []
    for _ in range(draws):
        out.append(replace(Params(seed=seed), **{k: v.draw(rng) if hasattr(v, "draw") else rng.choice(list(v))
                                                 for k, v in space.items()}))
    return out


def random_search(binned: Binned, space: Mapping = SPACE, *, draws: int = 10, folds: int = 5, seed: int = 42,
                  patience: int | None = None, models_at_once: int = 50) -> tuple[DataFrame, Params]:
    """M4: (one row a draw, the best parameters).  ``grp`` of the binned table
    is the fold.  All models of up to ``models_at_once`` (draw, fold) pairs
    share every pass; a draw's AUC is the mean over folds at their best rounds
    with ``patience``, at the last round without."""
    sets = draws_of(space, draws, seed)
    pairs = [(d, k) for d in range(draws) for k in range(folds)]
    auc = {}
    for i in range(0, len(pairs), models_at_once):
        block = pairs[i:i + models_at_once]
        for pair, model in zip(block, train(binned, [(sets[d], k) for d, k in block], patience=patience)):
            auc[pair] = max(model.history, default=math.nan) if patience else (model.history or [math.nan])[-1]
    names = [k for k in space]
    rows = []
    for d, p in enumerate(sets):
        each = [auc[d, k] for k in range(folds)]
        rows.append((d, *[float(getattr(p, n)) for n in names], float(np.mean(each)), float(np.std(each))))
    best = min(range(draws), key=lambda d: (-rows[d][-2], d))
    spark = binned.rows.sparkSession
    shape = ", ".join(["draw int", *[f"{n} double" for n in names], "mean_auc double", "std_auc double"])
    return spark.createDataFrame(rows, shape).withColumn("is_best", F.col("draw") == best), sets[best]
