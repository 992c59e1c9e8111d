"""Metrics, scoring and model queries.

``labels`` carries 0/1 outcomes for documents; a document's score is its
length scaled to [0, 1] (a plain division, identical in every engine).
Applicant models train on the customer history features of ``j1``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import risk_band3, risk_band4, risk_class, round_all
from ..operators import ml
from ..operators.impute import fit_medians
from ..operators.explain import explain, explanation_text, linear_contributions
from ..operators.score import (fallback_score, fallback_score_grouped, human_scenario, positive_probability, project_features,
                               validate_features, what_if)
from ..sources.tables import table
from .children import applicant_history
from .registry import register

LABELLED_SQL = """(SELECT l.doc_id, l.quality, l.toxic, least(d.n_chars / 20000.0::DOUBLE, 1.0::DOUBLE) AS score
                   FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def labelled(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", "quality", "toxic", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))


@register("m7_auc", f"""
WITH s AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM {LABELLED_SQL} GROUP BY score),
a AS (SELECT score, pos, neg,
             coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
             sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
      FROM s)
SELECT round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
       round(sum(CASE WHEN pos > 0 THEN pos / (SELECT sum(pos) FROM s) * tp / (tp + fp) ELSE 0.0 END), 6)
         AS average_precision
FROM a
""", "M7")
def m7_auc(spark, sf_dir):
    return round_all(ml.auc_ap(labelled(spark, sf_dir), "score", "quality"), 6)


@register("m9_roc", f"""
WITH s AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM {LABELLED_SQL} GROUP BY score)
SELECT score AS threshold,
       round(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER (), 6) AS fpr,
       round(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER (), 6) AS tpr
FROM s
""", "M9")
def m9_roc(spark, sf_dir):
    return round_all(ml.roc_curve(labelled(spark, sf_dir), "score", "quality"), 6)


@register("m8_confusion", f"""
SELECT toxic, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
       round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
             / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1,
       round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy
FROM (SELECT toxic,
             count(*) FILTER (WHERE score >= 0.5 AND quality = 1)::DOUBLE AS tp,
             count(*) FILTER (WHERE score >= 0.5 AND quality <> 1)::DOUBLE AS fp,
             count(*) FILTER (WHERE score < 0.5 AND quality = 1)::DOUBLE AS fn,
             count(*) FILTER (WHERE score < 0.5 AND quality <> 1)::DOUBLE AS tn
      FROM {LABELLED_SQL} GROUP BY toxic)
""", "M8")
def m8_confusion(spark, sf_dir):
    m = ml.confusion_metrics(labelled(spark, sf_dir), "score", "quality", threshold=0.5, by=["toxic"])
    m = m.withColumns({c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")})
    return round_all(m, 6)


@register("b4_band", f"""
SELECT doc_id, score,
       CAST(score >= 0.5 AS INTEGER) AS prediction,
       CASE WHEN score < 0.15 THEN 'LOW' WHEN score < 0.30 THEN 'MEDIUM' WHEN score < 0.50 THEN 'HIGH'
            ELSE 'CRITICAL' END AS risk_category,
       CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level
FROM {LABELLED_SQL}
""", "B3, B4, B5")
def b4_band(spark, sf_dir):
    d = labelled(spark, sf_dir)
    return d.select("doc_id", "score", risk_class("score", 0.5).alias("prediction"),
                    risk_band4("score").alias("risk_category"), risk_band3("score").alias("risk_level"))


@register("b8_stub", """
WITH v AS (SELECT l_orderkey, (l_quantity - 25)::DOUBLE AS x FROM lineitem)
SELECT l_orderkey,
       round(least(greatest(0.5 + 0.5 * least(greatest(avg(x) / (avg(abs(x)) + 1e-6), -1.0), 1.0), 0.0), 1.0), 6)
         AS probability
FROM v GROUP BY l_orderkey
""", "B8")
def b8_stub(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("v", (F.col("l_quantity") - 25).cast("double"))
    return round_all(fallback_score_grouped(li, "l_orderkey", "v"), 6)


@register("k5_weights", """
SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS target,
       round(CASE WHEN c_acctbal < 0 THEN n / (2.0 * pos) ELSE n / (2.0 * (n - pos)) END, 6) AS weight
FROM customer, (SELECT count(*)::DOUBLE AS n, sum(CAST(c_acctbal < 0 AS INTEGER))::DOUBLE AS pos FROM customer)
""", "K5")
def k5_weights(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return round_all(ml.class_weights(c, "target"), 6)


#: The seeded hash of the splits, as DuckDB computes it.
_HASHED_SQL = """(SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS target,
    ('0x' || substr(md5(c_custkey::VARCHAR || ':42'), 1, 15))::BIGINT AS h FROM customer)"""
_RANKED_SQL = f"""(SELECT c_custkey, target, row_number() OVER (PARTITION BY target ORDER BY h, c_custkey) - 1 AS place,
    count(*) OVER (PARTITION BY target) AS n FROM {_HASHED_SQL})"""


@register("k2_split", f"""
SELECT c_custkey, target, (CASE WHEN place < floor(n * 0.6::DOUBLE + 0.5) THEN 0 WHEN place < floor(n * (0.6::DOUBLE + 0.2::DOUBLE) + 0.5)
       THEN 1 ELSE 2 END)::INTEGER AS split
FROM {_RANKED_SQL}
""", "K2 (every row)")
def k2_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return ml.stratified_split(c, "c_custkey", "target", (0.6, 0.2, 0.2), seed=42)


@register("k3_folds", f"""
SELECT c_custkey, target, (SELECT count(*) FROM range(1, 5) r(j) WHERE place >= j * (n // 5) + least(j, n % 5))::INTEGER AS fold
FROM {_RANKED_SQL}
""", "K3 (every row)")
def k3_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    return ml.stratified_folds(c, "c_custkey", "target", 5, seed=42)


MODEL_FEATURES = ["ORD_O_TOTALPRICE_MEAN", "ORD_O_TOTALPRICE_SUM", "ORD_O_TOTALPRICE_COUNT", "ORD_FILLED_COUNT",
                  "ORD_PRIORITY_COUNT", "ORD_FILLED_RATE", "EVT_VALUE_MEAN", "EVT_VALUE_SUM", "EVT_EVENT_ID_COUNT"]


def _training_frame(spark, sf_dir):
    h = applicant_history(spark, sf_dir).select("c_custkey", "target", *MODEL_FEATURES)
    h = h.withColumns({c: F.col(c).cast("double") for c in MODEL_FEATURES})
    return ml.stratified_split(ml.class_weights(h, "target"), "c_custkey", "target", (0.8, 0.2), seed=42)


@register("m1_logistic", None, "M1, K5, M15")
def m1_logistic(spark, sf_dir):
    d = _training_frame(spark, sf_dir)
    model = ml.logistic(MODEL_FEATURES, "target", weight="weight", max_iter=200).fit(d.where("split = 0"))
    return ml.predictions(model, d, "c_custkey", "target")


@register("m3_gbt", None, "M3, M6, M7")
def m3_gbt(spark, sf_dir):
    d = _training_frame(spark, sf_dir).withColumn("is_val", F.col("split") == 1)
    model = ml.boosted_trees(MODEL_FEATURES, "target", rounds=30, depth=4, validation="is_val").fit(d)
    p = ml.predictions(model, d, "c_custkey", "target").join(d.select("c_custkey", "split"), "c_custkey")
    metrics = ml.auc_ap(p.withColumn("split", F.when(F.col("split") == 0, "train").otherwise("validation")),
                        "probability", "target", by=["split"])
    return metrics


@register("m13_importance", None, "M2, M13, X12, W4")
def m13_importance(spark, sf_dir):
    from ..functions.expressions import feature_category
    from ..operators.analysis import cumulative_share
    d = _training_frame(spark, sf_dir)
    model = ml.random_forest(MODEL_FEATURES, "target", trees=20, depth=5).fit(d.where("split = 0"))
    imp = ml.feature_importances(model, MODEL_FEATURES).withColumn("category", feature_category(F.col("feature")))
    return cumulative_share(imp, "importance")


@register("m11_contrib", None, "M11, M12, X5, X6, X11, O2")
def m11_contrib(spark, sf_dir):
    d = _training_frame(spark, sf_dir)
    model = ml.logistic(MODEL_FEATURES, "target", weight="weight", max_iter=200).fit(d.where("split = 0"))
    contrib = linear_contributions(model, d, MODEL_FEATURES, keep=["c_custkey"])
    return explanation_text(explain(contrib, MODEL_FEATURES, keep=["c_custkey"], top_n=5)).select(
        "c_custkey", "base_probability", "probability", "explanation", "top_factor_direction")


def _drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"),
        F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("double").alias("day_no"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    return ml.adversarial_validation(o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus = 'O'"),
                                     ["price", "day_no", "priority"], key="o_orderkey", trees=20)


@register("m14_adversarial", None, "M14, O4, E1, I4, K2")
def m14_adversarial(spark, sf_dir):
    return _drift(spark, sf_dir)["auc"]


@register("m14_drift", None, "M14 (the features that differ most)")
def m14_drift(spark, sf_dir):
    return _drift(spark, sf_dir)["top_features"]


@register("p14_project", """
SELECT c_custkey, coalesce(c_acctbal, 0.0) AS c_acctbal, 0.0::DOUBLE AS MISSING_FEATURE,
       c_nationkey::DOUBLE AS c_nationkey
FROM customer
""", "P14")
def p14_project(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return project_features(c, ["c_acctbal", "MISSING_FEATURE", "c_nationkey"], keep=["c_custkey"])


def _requests(spark, sf_dir):
    """One request map per customer from its history features; customers
    without events send no EVT_* entries."""
    h = applicant_history(spark, sf_dir)
    entries = [F.struct(F.lit(c), F.col(c).cast("double")) for c in MODEL_FEATURES]
    arr = F.filter(F.array(*entries), lambda e: ~(e["col1"].startswith("EVT_") & (F.col("EVT_EVENT_ID_COUNT") == 0)))
    return h.select("c_custkey", F.map_from_entries(arr).alias("features_map"))


N_EVENT_FEATURES = sum(c.startswith("EVT_") for c in MODEL_FEATURES)


@register("p15_validate", f"""
SELECT c.c_custkey, false AS valid,
       CASE WHEN e.user_id IS NULL THEN {N_EVENT_FEATURES} + 1 ELSE 1 END AS n_missing,
       CASE WHEN e.user_id IS NULL THEN 1 ELSE 0 END AS n_missing_important
FROM customer c LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON c.c_custkey = e.user_id
""", "P15")
def p15_validate(spark, sf_dir):
    v = validate_features(_requests(spark, sf_dir), "features_map", MODEL_FEATURES + ["UNUSED"],
                          important=["EVT_VALUE_SUM"])
    return v.select("c_custkey", "valid", F.size("missing_features").alias("n_missing"),
                    F.size("missing_important").alias("n_missing_important"))


@register("b6_what_if", None, "B1, B6, B5")
def b6_what_if(spark, sf_dir):
    d = _training_frame(spark, sf_dir)
    model = ml.logistic(MODEL_FEATURES, "target", weight="weight", max_iter=200).fit(d.where("split = 0"))
    req = _requests(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("name"), "features_map",
                                          (F.pmod("c_custkey", F.lit(2)) == 0).alias("fill_missing_with_median"))
    return what_if(model, req, MODEL_FEATURES, medians=fit_medians(d, MODEL_FEATURES))


@register("b7_human", """
WITH t AS (SELECT c_custkey, abs(c_acctbal) AS inc, c_nationkey * 1000.0::DOUBLE AS cred,
                  -(20 + c_custkey % 50) * 365.0::DOUBLE AS birth,
                  CASE WHEN c_custkey % 7 > 0 THEN -(c_custkey % 7) * 365.0::DOUBLE ELSE 365243.0::DOUBLE END AS work,
                  (c_custkey % 3)::DOUBLE AS kids, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS car
           FROM customer),
r AS (SELECT *, CASE WHEN cred > 0 THEN (CASE WHEN inc > 0 THEN cred / inc ELSE 10.0::DOUBLE END) END AS ratio FROM t),
s AS (SELECT c_custkey, CASE WHEN ratio IS NULL THEN 8 ELSE 9 END AS n,
             inc + cred + birth + work + kids + car + 1.0::DOUBLE + 0.5::DOUBLE + coalesce(ratio, 0.0::DOUBLE) AS total,
             inc + cred - birth + abs(work) + kids + car + 1.0::DOUBLE + 0.5::DOUBLE + coalesce(ratio, 0.0::DOUBLE) AS size
      FROM r)
SELECT c_custkey, n AS n_features,
       round(least(greatest(0.5::DOUBLE + 0.5::DOUBLE * least(greatest((total / n) / (size / n + 1e-6::DOUBLE), -1.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 6) AS probability
FROM s
""", "B7, B8")
def b7_human(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.abs("c_acctbal").alias("income"), (F.col("c_nationkey") * 1000.0).alias("credit_amount"),
        (20 + F.pmod("c_custkey", F.lit(50))).alias("age"), F.pmod("c_custkey", F.lit(7)).alias("employment_years"),
        (F.col("c_mktsegment") == "AUTOMOBILE").alias("has_car"), F.lit(True).alias("has_realty"),
        F.pmod("c_custkey", F.lit(3)).alias("children_count"), F.lit(None).cast("double").alias("ext_source_2"),
        F.lit(0.5).alias("ext_source_3"))
    out = fallback_score(human_scenario(c), "features_map")
    return out.select("c_custkey", F.size("features_map").alias("n_features"), F.round("probability", 6).alias("probability"))


@register("m11_tree_contrib", None, "M11, M12, M3 (TreeSHAP)")
def m11_tree_contrib(spark, sf_dir):
    from ..operators.explain import tree_contributions
    d = _training_frame(spark, sf_dir)
    model = ml.boosted_trees(MODEL_FEATURES, "target", rounds=20, depth=4).fit(d.where("split = 0"))
    contrib = tree_contributions(model, d, MODEL_FEATURES, keep=["c_custkey"])
    return explanation_text(explain(contrib, MODEL_FEATURES, keep=["c_custkey"], top_n=5)).select(
        "c_custkey", "base_probability", "probability", "explanation", "top_factor_direction")


@register("b5_band", f"""
SELECT doc_id, score * 100 AS score_pct,
       CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
       CASE WHEN score * 100 > 1 THEN (CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.6 THEN 'Medium' ELSE 'High' END)
            ELSE (CASE WHEN score * 100 < 0.3 THEN 'Low' WHEN score * 100 < 0.6 THEN 'Medium' ELSE 'High' END)
       END AS risk_level_from_pct
FROM {LABELLED_SQL}
""", "B5 (0-1 and 0-100 scales)")
def b5_band(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("score_pct", F.col("score") * 100)
    return d.select("doc_id", "score_pct", risk_band3("score").alias("risk_level"),
                    risk_band3("score_pct", percent_scale=True).alias("risk_level_from_pct"))


@register("m11_sums_to_margin", "SELECT c_custkey, true AS linear_adds_up, true AS trees_add_up FROM customer",
          "M11 (base and contributions add up to each model's own log-odds)")
def m11_sums_to_margin(spark, sf_dir):
    from ..operators.explain import tree_contributions
    d = _training_frame(spark, sf_dir)
    linear = ml.logistic(MODEL_FEATURES, "target", weight="weight", max_iter=200).fit(d.where("split = 0"))
    trees = ml.boosted_trees(MODEL_FEATURES, "target", rounds=10, depth=3).fit(d.where("split = 0"))

    def adds_up(contrib, model, name):
        odds = model.transform(d).select("c_custkey", positive_probability().alias("p"))
        total = F.col("base_logodds")
        for f in MODEL_FEATURES:
            total = total + F.col(f"contrib__{f}")
        return contrib.join(odds, "c_custkey").select(
            "c_custkey", (F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) - F.col("p")) < 1e-6).alias(name))

    a = adds_up(linear_contributions(linear, d, MODEL_FEATURES, keep=["c_custkey"]), linear, "linear_adds_up")
    b = adds_up(tree_contributions(trees, d, MODEL_FEATURES, keep=["c_custkey"]), trees, "trees_add_up")
    return a.join(b, "c_custkey")


@register("m10_overfit", f"""
WITH t AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, score, quality FROM {LABELLED_SQL}),
s AS (SELECT split, score, sum(quality) AS pos, sum(1 - quality) AS neg FROM t GROUP BY split, score),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
a AS (SELECT split, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY split),
g AS (SELECT max(auc) FILTER (WHERE split = 'train') - max(auc) FILTER (WHERE split = 'validation') AS gap FROM a)
SELECT round(gap, 6) AS auc_gap, gap > 0.05 AS overfit, (SELECT split FROM a ORDER BY auc DESC, split LIMIT 1) AS best FROM g
""", "M10, M7 by group")
def m10_overfit(spark, sf_dir):
    t = labelled(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train"))
    auc = ml.auc_ap(t, "score", "quality", by=["split"]).select("split", "auc")
    check = ml.overfit_check(auc)
    best = ml.best_model(auc, model="split")
    return check.select(F.round("auc_gap", 6).alias("auc_gap"), "overfit",
                        best.select("split").scalar().alias("best"))


@register("b2_score_by_id", """
WITH i AS (SELECT c_custkey FROM customer UNION ALL SELECT -c_custkey - 1 FROM customer WHERE c_custkey % 10 = 0)
SELECT c_custkey, CASE WHEN c_custkey > 0 AND c_custkey % 3 <> 0 THEN 'ok' ELSE 'not_found' END AS status,
       c_custkey > 0 AND c_custkey % 3 <> 0 AS scored, true AS class_follows
FROM i
""", "B2, D6, J6 (errors stay with their row)")
def b2_score_by_id(spark, sf_dir):
    """Scores by key from the online snapshot: a third of the customers have
    expired rows, some requested keys were never there."""
    import datetime as dt

    from ..operators.score import score_by_id
    from ..operators.store import Entity, FeatureView
    from pyspark.sql import types as T
    d = _training_frame(spark, sf_dir)
    model = ml.logistic(MODEL_FEATURES, "target", weight="weight", max_iter=50).fit(d.where("split = 0"))
    view = FeatureView("history", Entity("customer", ("c_custkey",)),
                       T.StructType([T.StructField(f, T.DoubleType()) for f in MODEL_FEATURES]), ts="ts", ttl=dt.timedelta(days=7))
    now = dt.datetime(2024, 1, 20)
    at = F.when(F.col("c_custkey") % 3 == 0, F.lit(dt.datetime(2024, 1, 1))).otherwise(F.lit(dt.datetime(2024, 1, 19)))
    snapshot = applicant_history(spark, sf_dir).select(
        "c_custkey", *[F.col(f).cast("double").alias(f) for f in MODEL_FEATURES], at.alias("ts"))
    known = table(spark, sf_dir, "customer").select("c_custkey")
    ids = known.unionByName(known.where("c_custkey % 10 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey")))
    out = score_by_id(model, snapshot, ids, view, now=now)
    p = F.col("probability")
    return out.select("c_custkey", "status", p.isNotNull().alias("scored"), F.coalesce(
        (F.col("prediction") == risk_class("probability", 0.5)) & (F.col("risk_category") == risk_band4("probability"))
        & p.between(0, 1), p.isNull() & F.col("prediction").isNull()).alias("class_follows"))
