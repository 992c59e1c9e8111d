"""Splits, class weights, models and metrics.

Splits are decided by a seeded hash of the key, never by a global shuffle or
sort: the same row lands in the same split on any cluster, any partitioning.
Exact per-stratum sizes come from thresholds on that hash, found by counting.

Models are Spark ML estimators; metrics are aggregates over per-score counts,
so an exact AUC on billions of rows is a group-by plus a running sum.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, materialize, spread
from .clean import with_scalars
from .ordered import join_null_safe, running_totals
from .score import positive_probability


# ------------------------------------------------------------------ splits
_BITS, _STEP = 60, 12
#: A boundary bucket of at most so many rows is ordered; a larger one is cut again.
_BOUNDARY_ROWS = 20_000


def _key_hash(key: str, seed: int) -> Column:
    """60-bit seeded hash of the key: the first 15 hex digits of
    ``md5(key:seed)``, which any engine can recompute."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, key: str, label: str, fractions: Sequence[float] = (0.8, 0.2), *,
                     seed: int = 42, exact: bool = True, out: str = "split") -> DataFrame:
    """K2: split index per row (0 = first fraction), stratified by label.

    ``exact``: within each label the rows in the order of a seeded hash are
    cut at ``round(fraction * count)``, so split sizes per stratum are exact;
    otherwise the hash itself is
    thresholded (no pass over the data).
    """
    shares = [sum(fractions[:i + 1]) for i in range(len(fractions) - 1)]
    if not exact:
        u = _key_hash(key, seed) / float(1 << _BITS)
        return df.withColumn(out, sum(((u >= F.lit(s)).cast("int") for s in shares), F.lit(0)))
    return _cut_by_hash(df, key, label, lambda n: [math.floor(n * s + 0.5) for s in shares], seed, out)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, *, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """K3: fold 0..k-1 per row; within each label the rows in the order of a
    seeded hash are cut into k runs of equal length (+-1 row)."""
    return _cut_by_hash(df, key, label, lambda n: [j * (n // k) + min(j, n % k) for j in range(1, k)], seed, out)


def _cut_by_hash(df: DataFrame, key: str, label: str, cuts_of: Callable[[int], list[int]], seed: int, out: str) -> DataFrame:
    """``out``: how many of the cuts of its label lie at or below the row.

    No rank of all rows is taken.  A histogram over the leading bits of the
    hash (4096 buckets a label) tells in which bucket each cut falls; only
    those buckets are written and looked into, bit by bit until one holds few
    rows, whose order gives the (hash, key) of the first row behind the cut.
    Every row is then decided by a compare with the thresholds of its label.
    The driver sees labels x 4096 counts and labels x cuts thresholds.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{label}`").alias("y"), _key_hash(key, seed).alias("h"), F.col(f"`{key}`").alias("k"))
    shift = _BITS - _STEP
    counts: dict = {}
    for r in rows.groupBy("y", F.shiftright("h", shift).alias("b")).count().collect():
        counts.setdefault(r.y, {})[r.b] = r["count"]
    wanted = []         # (label, cut, leading bits, rows of that bucket before the cut)
    for y, held in counts.items():
        n = sum(held.values())
        for j, c in enumerate(cuts_of(n)):
            if c < n:
                wanted.append((y, j, *_bucket_of(held, c)))
    fields = {"y": rows.schema["y"].dataType, "cut": T.IntegerType(), "b": T.LongType(), "rest": T.LongType()}
    shape = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])

    def inside(rows, shift):
        """(y, cut, b, rest, h, k) of the rows in the wanted buckets."""
        near = spark.createDataFrame(wanted, shape)
        return join_null_safe(rows.withColumn("b", F.shiftright("h", shift)), near, ["y", "b"])

    near = materialize(_in_buckets(rows, shift, {(y, b) for y, _, b, _ in wanted}), "split-bounds") if wanted else rows
    while wanted and shift:
        sizes = inside(near, shift).groupBy("cut", "y").count().agg(F.max("count")).first()[0] or 0
        if sizes <= _BOUNDARY_ROWS:
            break
        held = {}
        for r in inside(near, shift).groupBy("y", "cut", "rest", F.shiftright("h", shift - _STEP).alias("b2")).count().collect():
            held.setdefault((r.y, r.cut, r.rest), {})[r.b2] = r["count"]
        wanted = [(y, cut, *_bucket_of(h, rest)) for (y, cut, rest), h in held.items()]
        shift -= _STEP
    at = []
    if wanted:
        order = Window.partitionBy("y", "cut").orderBy("h", "k")
        found = inside(near, shift).withColumn("place", F.row_number().over(order) - 1).withColumn(
            "run", F.min("place").over(Window.partitionBy("y", "cut", "h", "k"))).filter("place = rest")
        at = [(r.y, (r.h, r.k, r.rest - r.run)) for r in found.select("y", "h", "k", "rest", "run").collect()]
    by_label = [(y, [t for z, t in at if z == y]) for y in counts]
    bounds = spark.createDataFrame(by_label, T.StructType([
        T.StructField("__y", fields["y"]), T.StructField("__cuts", T.ArrayType(T.StructType([
            T.StructField("h", T.LongType()), T.StructField("k", rows.schema["k"].dataType), T.StructField("into", T.LongType())])))]))
    placed = df.withColumn("__h", _key_hash(key, seed))
    # the thresholds come from the driver and are sent to the rows: dealt by
    # label, the rows of a label would meet in one task
    joined = placed.join(F.broadcast(bounds), placed[f"`{label}`"].eqNullSafe(bounds["__y"]))
    k, h = F.col(f"`{key}`"), F.col("__h")
    behind = F.filter("__cuts", lambda c: (c["h"] < h) | ((c["h"] == h) & (
        F.coalesce(c["k"] < k, c["k"].isNull() & k.isNotNull()) | (c["k"].eqNullSafe(k) & (c["into"] == 0)))))
    done, extra = joined.withColumn(out, F.size(behind)), ["__h", "__y", "__cuts"]
    if not any(into for _, (_, _, into) in at):
        return done.drop(*extra)
    # a cut falls among rows that share a key: those rows alone are numbered
    among = F.filter("__cuts", lambda c: (c["h"] == h) & c["k"].eqNullSafe(k) & (c["into"] > 0))
    ties = done.filter(F.size(among) > 0).withColumn("__t", F.row_number().over(
        Window.partitionBy(f"`{label}`", "__h", f"`{key}`").orderBy("__h")) - 1)
    ties = ties.withColumn(out, F.col(out) + F.size(F.filter(among, lambda c: c["into"] <= F.col("__t")))).drop("__t")
    return done.filter(F.size(among) == 0).unionByName(ties).drop(*extra)


def _in_buckets(rows: DataFrame, shift: int, buckets: set) -> DataFrame:
    """Rows whose (y, leading bits of h) is one of ``buckets`` (labels x cuts)."""
    hit = F.lit(False)
    for y, b in buckets:
        hit = hit | (F.col("y").eqNullSafe(F.lit(y)) & (F.shiftright("h", shift) == b))
    return rows.filter(hit)


def _bucket_of(held: Mapping[int, int], c: int) -> tuple[int, int]:
    """Bucket in which place ``c`` falls, and its place there."""
    for b in sorted(held):
        if c < held[b]:
            return b, c
        c -= held[b]
    raise ValueError(c)


def _hash_rank(df: DataFrame, key: str, label: str | None, seed: int) -> DataFrame:
    """0-based rank of each row by seeded hash within its label, and the
    label's row count (distributed; rows of one hash follow their key)."""
    h = df.withColumn("__h", F.xxhash64(F.col(key).cast("string"), F.lit(seed))).withColumn("__one", F.lit(1))
    rt = running_totals(h, "__h", ["__one"], by=[label] if label else [], tiebreak=[key])
    return rt.withColumnRenamed("__one_before", "__rank").withColumnRenamed("__one_total", "__n").drop("__one")


def class_weights(df: DataFrame, label: str, *, mode: str = "balanced", out: str = "weight") -> DataFrame:
    """K5: ``balanced`` gives n / (2 n_class) per class; ``pos_ratio`` gives
    positives the weight neg / pos and negatives 1 (``scale_pos_weight``)."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("long")).alias("__pos"))
    w = with_scalars(df, counts)
    pos, n = F.col("__pos").cast("double"), F.col("__n").cast("double")
    neg = n - pos
    if mode == "pos_ratio":
        weight = F.when(F.col(label) == 1, neg / pos).otherwise(F.lit(1.0))
    else:
        weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * neg))
    return w.withColumn(out, weight).drop("__n", "__pos")


# ------------------------------------------------------------------ models
class _Pipeline(Pipeline):
    """A pipeline whose models carry no training summary.

    The summary of a logistic model or a forest holds the session, and is
    shipped with every scoring task; a session in which an ``Observation`` was
    used (``store.publish``) cannot be shipped.
    """

    def _fit(self, dataset: DataFrame):
        model = super()._fit(dataset)
        for stage in model.stages:
            if getattr(stage, "hasSummary", False):
                stage._java_obj.setSummary(dataset.sparkSession._jvm.scala.Option.empty())
        return model


def _pipeline(features: Sequence[str], clf) -> Pipeline:
    return _Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features",
                                             handleInvalid="keep"), clf])


def logistic(features: Sequence[str], label: str, *, weight: str | None = None, max_iter: int = 2000,
             reg: float = 0.0) -> Pipeline:
    """M1: logistic regression (class weights through ``weight``)."""
    clf = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg,
                             standardization=True, **({"weightCol": weight} if weight else {}))
    return _pipeline(features, clf)


def optimality(model, df: DataFrame, features: Sequence[str], label: str, *, weight: str | None = None,
               reg: float = 0.0, tolerance: float = 1e-3) -> DataFrame:
    """M1: certificate of a fitted logistic model: per term its coefficient,
    the gradient of the weighted loss (mean over the weights, features in units of
    their standard deviation, ridge ``reg`` as the solver scales it) and whether it is within ``tolerance``.

    The loss is convex, so a gradient of zero is the optimum.  One aggregate
    for the deviations and one for the gradient, whatever the number of rows;
    a constant feature has no gradient.  Rows with a null label are left out.
    """
    lr = model.stages[-1] if hasattr(model, "stages") else model
    coef = [float(c) for c in lr.coefficients]
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{label}`").cast("double").alias("y"), (F.col(f"`{weight}`") if weight else F.lit(1.0)).cast("double").alias("w"),
        *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    margin = F.lit(float(lr.intercept))
    for i, c in enumerate(coef):
        margin = margin + F.lit(c) * F.col(f"x{i}")
    off = F.col("w") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("y"))
    total, n = F.sum("w"), range(len(coef))
    # deviations over the weighted rows, as the solver standardizes
    spread = rows.agg(*[F.try_divide(F.sum(F.col("w") * F.col(f"x{i}")), total).alias(f"m{i}") for i in n])
    sums = with_scalars(rows, spread).agg(
        F.try_divide(F.sum(off), total).alias("g"),
        *[F.try_divide(F.sum(off * (F.col(f"x{i}") - F.col(f"m{i}"))), total).alias(f"g{i}") for i in n],
        *[F.sqrt(F.try_divide(F.sum(F.col("w") * (F.col(f"x{i}") - F.col(f"m{i}")) ** 2), total)).alias(f"s{i}") for i in n])
    terms = [F.struct(F.lit("(intercept)").alias("term"), F.lit(float(lr.intercept)).alias("coefficient"), F.col("g").alias("gradient"))]
    terms += [F.struct(F.lit(f).alias("term"), F.lit(c).alias("coefficient"), F.coalesce(
        F.try_divide(F.col(f"g{i}"), F.col(f"s{i}")) + F.lit(reg * c) * F.col(f"s{i}"), F.lit(0.0)).alias("gradient"))
        for i, (f, c) in enumerate(zip(features, coef))]
    return sums.select(F.inline(F.array(*terms))).withColumn("optimal", F.abs("gradient") <= F.lit(tolerance))


def random_forest(features: Sequence[str], label: str, *, weight: str | None = None, trees: int = 100,
                  depth: int = 10, seed: int = 42) -> Pipeline:
    """M2: random forest (100 trees, depth 10)."""
    clf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                 seed=seed, **({"weightCol": weight} if weight else {}))
    return _pipeline(features, clf)


def boosted_trees(features: Sequence[str], label: str, *, weight: str | None = None, rounds: int = 500,
                  rate: float = 0.05, depth: int = 7, seed: int = 42, validation: str | None = None,
                  tol: float = 0.01, subsample: float = 1.0) -> Pipeline:
    """M3 / M6: gradient-boosted trees; with ``validation`` (a boolean
    column) training stops early when the validation loss stops improving."""
    kw = {"weightCol": weight} if weight else {}
    if validation:
        kw.update(validationIndicatorCol=validation, validationTol=tol)
    clf = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth,
                        seed=seed, subsamplingRate=subsample, **kw)
    return _pipeline(features, clf)


def random_search(pipeline: Pipeline, space: Mapping[str, Sequence], *, draws: int, label: str,
                  fold_col: str, seed: int = 42, parallelism: int = 4):
    """M4: ``draws`` random parameter sets from ``space`` (values per
    parameter name of the last stage), scored by cross-validated AUC over a
    precomputed fold column.  Returns the ``CrossValidator``; ``.fit(df)`` runs it."""
    clf = pipeline.getStages()[-1]
    rng = random.Random(seed)
    maps = []
    for _ in range(draws):
        maps.append({clf.getParam(name): rng.choice(list(values)) for name, values in space.items()})
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                          parallelism=parallelism, seed=seed)


def predictions(model, df: DataFrame, key: str, label: str | None, threshold: float = 0.5) -> DataFrame:
    """``key, label, probability, class`` for export."""
    out = model.transform(df)
    cols = [key] + ([label] if label else [])
    return out.select(*cols, positive_probability().alias("probability")).withColumn(
        "predicted", (F.col("probability") >= threshold).cast("int"))


def feature_importances(model, features: Sequence[str]) -> DataFrame:
    """Global importance per feature, largest first (tree models:
    split-gain importance; linear models: absolute coefficients)."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
    spark = SparkSession.getActiveSession()
    rows = list(zip(features, [float(v) for v in vals]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


# ----------------------------------------------------------------- metrics
def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (the only shuffle of every
    rank metric; identical scores are merged map-side)."""
    y = F.col(label).cast("long")
    return df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def auc_ap(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """M7: exact ROC AUC (ties count half) and average precision per group.

    AUC = sum over scores of pos(s) * (neg below s + neg(s) / 2) / (P N);
    AP = sum over thresholds (high to low) of recall gain * precision.
    """
    sc = score_counts(df, score, label, by)
    # one pass, high to low: negatives strictly below s = N - above - at s
    d = running_totals(sc, score, ["pos", "neg"], by=by, descending=True)
    below = F.col("neg_total") - F.col("neg_before") - F.col("neg")
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    g = d.groupBy(*by) if by else d.groupBy()
    # a group with one class only has no AUC (null)
    out = g.agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                     F.max("pos_total") * F.max("neg_total")).alias("auc"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("pos_total") * tp / (tp + fp))
              .otherwise(F.lit(0.0))).alias("average_precision"))
    return out


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """M9: (threshold, fpr, tpr) at every distinct score, high to low."""
    sc = score_counts(df, score, label)
    d = running_totals(sc, score, ["pos", "neg"], descending=True)
    return d.select(F.col(score).alias("threshold"),
                    F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"),
                    F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"))


def confusion_metrics(df: DataFrame, prob: str, label: str, *, threshold: float = 0.5,
                      by: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """M8: TP/FP/FN/TN, precision, recall, F1 and accuracy per group."""
    yhat = (F.col(prob) >= threshold) if inclusive else (F.col(prob) > threshold)
    y = F.col(label) == 1
    g = df.groupBy(*by) if by else df.groupBy()
    m = g.agg(F.count_if(yhat & y).alias("tp"), F.count_if(yhat & ~y).alias("fp"),
              F.count_if(~yhat & y).alias("fn"), F.count_if(~yhat & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    return m.withColumns({
        "precision": prec, "recall": rec,
        "f1": F.try_divide(2 * prec * rec, prec + rec),
        "accuracy": (tp + tn) / (tp + tn + fp + fn),
    })


def overfit_check(metrics: DataFrame, *, split: str = "split", auc: str = "auc", train="train",
                  validation="validation", limit: float = 0.05) -> DataFrame:
    """Train AUC minus validation AUC, flagged above ``limit``."""
    w = metrics.groupBy().pivot(split, [train, validation]).agg(F.first(auc))
    return w.select((F.col(train) - F.col(validation)).alias("auc_gap")).withColumn(
        "overfit", F.col("auc_gap") > limit)


def best_model(metrics: DataFrame, model: str = "model", auc: str = "auc") -> DataFrame:
    """The row with the highest AUC (ties by name)."""
    return metrics.orderBy(F.col(auc).desc(), F.col(model)).limit(1)


def adversarial_validation(train: DataFrame, test: DataFrame, features: Sequence[str], *,
                           key: str, seed: int = 42, trees: int = 100, top: int = 10) -> dict:
    """Can a model tell train rows from test rows?

    O4 (union with an origin flag) -> E1 (codes of text columns, null as a
    category) -> I4 (-999 fill) -> K2 (70/30 split) -> random forest -> M7 AUC
    and M13 top drifting features.  AUC above 0.8 is a strong shift, above 0.6
    a moderate one.
    """
    from .analysis import union_with_flag
    from .impute import fill_constant, label_encode
    both = union_with_flag(train.select(key, *features), test.select(key, *features), "is_train")
    text = [f for f in features if both.schema[f].dataType.simpleString() == "string"]
    both = label_encode(both, text, null_token="nan") if text else both
    both = fill_constant(both, -999.0, list(features))
    both = materialize(both, "adversarial")
    both = cut_lineage(spread(stratified_split(both, key, "is_train", (0.7, 0.3), seed=seed), both.count()))
    model = random_forest(features, "is_train", trees=trees, depth=6, seed=seed).fit(both.where("split = 0"))
    held = model.transform(both.where("split = 1")).withColumn("p", positive_probability())
    auc = auc_ap(held, "p", "is_train").select("auc")
    level = F.when(F.col("auc") > 0.8, "strong").when(F.col("auc") > 0.6, "moderate").otherwise("none")
    return {"auc": auc.withColumn("shift", level),
            "top_features": feature_importances(model, features).limit(top)}
