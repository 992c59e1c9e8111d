"""Per-row explanations.

For a logistic model the contribution of feature i to the log-odds of one
row is ``coef_i * (x_i - mean_i)``; with the base ``intercept + sum coef_i
mean_i`` they add up exactly to the row's margin (what TreeSHAP gives for a
linear model with independent features).  Contributions are columns, the
top-n by absolute probability impact is an array sort per row: all JVM-side,
no Python per row.  Tree models use exact path-dependent TreeSHAP, one array
step per leaf and batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import impact_direction, impact_strength, logistic, pretty_name
from ..session import cut_lineage, spread

#: Longest path (distinct features) of which every pattern is solved at once.
TABLE_BITS = 8


def linear_contributions(model, df: DataFrame, features: Sequence[str], *, keep: Sequence[str] = (),
                         means: dict[str, float] | None = None) -> DataFrame:
    """Log-odds contributions per feature plus ``base_logodds`` and ``margin``.

    ``means`` defaults to the feature means of ``df`` (one aggregate row).
    """
    lr = model.stages[-1] if hasattr(model, "stages") else model
    coef = lr.coefficients.toArray().tolist()
    intercept = float(lr.intercept)
    if means is None:
        row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
        means = {f: float(row[f] or 0.0) for f in features}
    base = intercept + sum(c * means[f] for c, f in zip(coef, features))
    contrib = {f"contrib__{f}": F.lit(c) * (F.coalesce(F.col(f).cast("double"), F.lit(means[f])) - F.lit(means[f]))
               for c, f in zip(coef, features)}
    out = df.select(*keep, *features).withColumns(contrib).withColumn("base_logodds", F.lit(base))
    margin = F.col("base_logodds")
    for f in features:
        margin = margin + F.col(f"contrib__{f}")
    return out.withColumn("margin", margin)


def contributions(model, df: DataFrame, features: Sequence[str], *, keep: Sequence[str] = (),
                  means: dict[str, float] | None = None) -> DataFrame:
    """M11 for whichever model: :func:`linear_contributions` for one with
    coefficients (``means`` is its background), else :func:`tree_contributions`."""
    fitted = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(fitted, "coefficients"):
        return linear_contributions(model, df, features, keep=keep, means=means)
    return tree_contributions(model, df, features, keep=keep)


def explain(contribs: DataFrame, features: Sequence[str], *, keep: Sequence[str] = (), top_n: int = 20,
            top_side: int = 5) -> DataFrame:
    """Per row: base probability, probability, the top-n features by
    absolute probability impact ``expit(base + s) - expit(base)``, and the
    five strongest raising and lowering ones."""
    base = F.col("base_logodds")
    items = F.array(*[F.struct(
        (logistic(base + F.col(f"contrib__{f}")) - logistic(base)).alias("impact"),
        F.col(f"contrib__{f}").alias("impact_logodds"),
        F.lit(f).alias("feature"),
        F.col(f).cast("double").alias("value")) for f in features])
    ranked = F.array_sort(items, lambda a, b: F.when(F.abs(a["impact"]) > F.abs(b["impact"]), -1)
                          .when(F.abs(a["impact"]) < F.abs(b["impact"]), 1)
                          .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1)
                          .otherwise(0))
    top = F.slice(ranked, 1, top_n)
    return contribs.select(
        *keep,
        logistic(base).alias("base_probability"),
        logistic(F.col("margin")).alias("probability"),
        top.alias("top_contributions"),
        F.slice(F.filter(top, lambda x: x["impact"] > 0), 1, top_side).alias("top_positive"),
        F.slice(F.filter(top, lambda x: x["impact"] < 0), 1, top_side).alias("top_negative"))


def explanation_text(explained: DataFrame, n: int = 5) -> DataFrame:
    """A readable sentence per row from the top factors."""
    top = F.slice(F.col("top_contributions"), 1, n)
    parts = F.transform(top, lambda x: F.format_string(
        "%s %s %s risk (impact: %+.1f percentage points)",
        pretty_name(x["feature"]), impact_strength(x["impact"]),
        F.when(x["impact"] > 0, "increases").otherwise("decreases"), x["impact"] * 100))
    head = F.format_string("Base default probability %.1f%%, this applicant %.1f%%. ",
                           F.col("base_probability") * 100, F.col("probability") * 100)
    return explained.withColumn("explanation", F.concat(head, F.concat_ws("; ", parts))) \
        .withColumn("top_factor_direction", impact_direction(F.col("top_contributions")[0]["impact"]))


# ------------------------------------------------------------ tree models
def forest_arrays(model) -> tuple[list[dict], list[float], str]:
    """Node tables of a fitted Spark GBT or random-forest classifier (read
    once on the driver; size is bounded by the model, not by the data).

    Returns per-tree dicts of numpy arrays (feature, threshold, left, right,
    value, cover), the tree weights, and the output kind: ``'logodds'`` for
    GBT (log-odds = 2 * weighted sum of trees) or ``'probability'`` for a
    forest (mean of the trees' class-1 leaf frequencies).
    """
    clf = model.stages[-1] if hasattr(model, "stages") else model
    kind = "logodds" if hasattr(clf, "getLossType") or type(clf).__name__.startswith("GBT") else "probability"
    tables = []
    for tree in clf.trees:
        feat, thr, left, right, value, cover = [], [], [], [], [], []

        def visit(node) -> int:
            me = len(feat)
            feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); value.append(0.0)
            stats = node.impurityStats()
            cover.append(float(stats.count()))
            if kind == "probability":
                s = list(stats.stats())
                value[me] = (s[1] / sum(s)) if len(s) > 1 and sum(s) > 0 else 0.0
            else:
                value[me] = float(node.prediction())
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                feat[me] = int(split.featureIndex())
                thr[me] = float(split.threshold())
                left[me] = visit(node.leftChild())
                right[me] = visit(node.rightChild())
            return me

        visit(tree._java_obj.rootNode())
        tables.append({k: np.array(v) for k, v in
                       zip(("feature", "threshold", "left", "right", "value", "cover"),
                           (feat, thr, left, right, value, cover))})
    weights = [float(w) for w in clf.treeWeights] if kind == "logodds" else [1.0 / len(tables)] * len(tables)
    return tables, weights, kind


def _leaf_paths(t: dict) -> list[tuple]:
    """For every leaf: its value, the distinct features of its path, and per
    feature the interval ``(low, high]`` the path asks for and the share of
    cover that the path keeps at its splits."""
    out = []

    def walk(j: int, asked: dict):
        if t["left"][j] < 0:
            out.append((t["value"][j], list(asked), np.array([asked[f] for f in asked]).reshape(-1, 3)))
            return
        f, cut = int(t["feature"][j]), t["threshold"][j]
        low, high, share = asked.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((t["left"][j], (low, min(high, cut))), (t["right"][j], (max(low, cut), high))):
            walk(child, asked | {f: (*bounds, share * t["cover"][child] / t["cover"][j])})

    walk(0, {})
    return out


def _path_shap(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Path-dependent TreeSHAP (Lundberg, Erion and Lee, 2018) of one leaf of
    value 1: ``inside`` (patterns x features) tells which intervals hold a
    row.  A feature's attribution sums over the sets of the other features,
    which a polynomial in the set size collects."""
    n, m = inside.shape
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for f in range(m):
        sums = np.zeros((n, m))
        sums[:, 0] = 1.0
        for g in range(m):
            if g != f:
                grown = sums * share[g]
                grown[:, 1:] += sums[:, :-1] * inside[:, g:g + 1]
                sums = grown
        out[:, f] = (inside[:, f] - share[f]) * (sums @ weight)
    return out


def _solved(value: float, asked: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Attributions of a leaf of ``value``, one array a feature of its path, by
    the numbers of patterns (bit i: interval i holds the row).  Short paths
    have few patterns, all solved once; of longer ones those that occur are."""
    m, share = len(asked), asked[:, 2]

    def solve(patterns: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(value * _path_shap((patterns[:, None] >> np.arange(m) & 1).astype(float), share).T)

    if m <= TABLE_BITS:
        table = solve(np.arange(1 << m))
        return lambda pattern: np.take(table, pattern, axis=1)

    def met(pattern: np.ndarray) -> np.ndarray:
        patterns, inverse = np.unique(pattern, return_inverse=True)
        return solve(patterns)[:, inverse]
    return met


def tree_contributions(model, df: DataFrame, features: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """M11 for tree ensembles: per-row path-dependent TreeSHAP, in the same
    column layout as :func:`linear_contributions` (``contrib__<f>``,
    ``base_logodds``, ``margin``) so :func:`explain` applies unchanged.

    GBT attributions are in log-odds (exact: base + sum = the model's
    log-odds).  Forest attributions are in probability; they are mapped to
    log-odds space around the base for ranking and text.  The leaves' paths
    are shipped with the function (bounded by the model); rows are written,
    dealt evenly by their number, and stream through ``mapInPandas`` in Arrow
    batches, all rows of a batch per leaf at once.
    """
    tables, weights, kind = forest_arrays(model)
    leaves = [(f, b, _solved(w * v, b)) for t, w in zip(tables, weights) for v, f, b in _leaf_paths(t) if f]
    feats = list(features)
    scale = 2.0 if kind == "logodds" else 1.0
    base = sum(w * float((t["value"] * t["cover"])[t["left"] < 0].sum() / t["cover"][0]) for t, w in zip(tables, weights))

    def run(batches):
        for pdf in batches:
            x = [pdf[f].to_numpy(dtype="float64") for f in feats]
            out = np.zeros((len(feats), len(pdf)))
            for features_of, asked, solved in leaves:
                # which intervals of the path hold a row, as the bits of a
                # number; a missing value goes right at every split
                pattern = np.zeros(len(pdf), dtype=np.int64)
                for i, (f, (low, high, _)) in enumerate(zip(features_of, asked)):
                    inside = ~(x[f] <= low)
                    if high < np.inf:
                        inside &= x[f] <= high
                    pattern |= inside.astype(np.int64) << i
                for f, part in zip(features_of, solved(pattern)):
                    out[f] += part
            res = pdf[list(keep)].copy() if keep else pd.DataFrame(index=pdf.index)
            for i, f in enumerate(feats):
                res[f] = pdf[f].astype("float64")
                res[f"contrib__{f}"] = out[i] * scale
            yield res

    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
                       + [f"`{f}` double" for f in feats] + [f"`contrib__{f}` double" for f in feats])
    src = cut_lineage(df.select(*keep, *[F.col(f).cast("double").alias(f) for f in feats]))
    out = spread(src, src.count()).mapInPandas(run, schema)
    if kind == "logodds":
        base_col = F.lit(base * scale)
        margin = base_col
        for f in feats:
            margin = margin + F.col(f"contrib__{f}")
        return out.withColumn("base_logodds", base_col).withColumn("margin", margin)
    # forest: probability-space attributions, expressed around the base log-odds
    p0 = min(max(base, 1e-12), 1 - 1e-12)
    total = F.lit(base)
    for f in feats:
        total = total + F.col(f"contrib__{f}")
    p = F.least(F.greatest(total, F.lit(1e-12)), F.lit(1 - 1e-12))
    out = out.withColumn("base_logodds", F.lit(log(p0 / (1 - p0)))).withColumn("margin", F.log(p / (1 - p)))
    return out
