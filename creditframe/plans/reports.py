"""Reports, chart data and explained scenarios.

Contributions come from models trained here, which SQL cannot repeat; their
twins state what must hold for every applicant whatever the model: how many
factors there are, that they are ranked, and that base and contributions give
the model's own probability.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import logistic, round_all
from ..operators import analysis as an
from ..operators import ml
from ..operators.impute import fit_medians
from ..operators.score import positive_probability, what_if
from ..sources.tables import cents, orders, table
from .children import applicant_history
from .models import MODEL_FEATURES, N_EVENT_FEATURES, _requests, _training_frame
from .profiling import MATRIX_COLS, ORDERS_BY_LABEL, _li_paid, _orders_by_label, a25_sql
from .registry import register


def _trained(spark, sf_dir, **how):
    d = _training_frame(spark, sf_dir)
    return d, ml.logistic(MODEL_FEATURES, "target", weight="weight", **how).fit(d.where("split = 0"))


def _ranked(items: Column) -> Column:
    """Whether an array of contributions goes from strong to weak."""
    impact = F.transform(items, lambda c: F.abs(c["impact"]))
    return F.forall(F.sequence(F.lit(1), F.size(items) - 1), lambda i: F.get(impact, i - 1) >= F.get(impact, i))


def _gives(items: Column, base: Column, probability: Column) -> Column:
    """Whether base and contributions give the probability."""
    total = F.aggregate(items, F.log(base / (1 - base)), lambda s, c: s + c["impact_logodds"])
    return F.abs(logistic(total) - probability) < 1e-6


# ------------------------------------------------------------ O9
@register("o9_comparison", f"""
WITH long AS (UNPIVOT ({ORDERS_BY_LABEL}) ON o_totalprice, day_no INTO NAME feature VALUE value)
SELECT target, feature, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS count
FROM long GROUP BY target, feature
""", "O9 (comparison)")
def o9_comparison(spark, sf_dir):
    out = an.analyze("comparison", _orders_by_label(spark, sf_dir), ["o_totalprice", "day_no"], label="target")
    return round_all(out["statistics"], 4)


@register("o9_correlation", f"""
SELECT feature_x, feature_y, corr, CASE WHEN abs(corr) > 0.7 THEN 'strong' WHEN abs(corr) > 0.4 THEN 'moderate' ELSE 'weak' END
       || CASE WHEN corr > 0 THEN ' positive' ELSE ' negative' END AS insight
FROM ({a25_sql})
""", "O9 (correlation, X10)")
def o9_correlation(spark, sf_dir):
    out = an.analyze("correlation", _li_paid(spark, sf_dir), MATRIX_COLS)["statistics"]
    # the sentence is "0.812 (strong positive)"
    return out.withColumn("insight", F.regexp_extract("insight", r"\((.*)\)", 1))


@register("o9_trend", """
SELECT 'o_totalprice' AS feature, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS period, o_orderstatus,
       sum(o_totalprice)::BIGINT AS value
FROM @ORDERS GROUP BY ALL
""", "O9 (trend by series)")
def o9_trend(spark, sf_dir):
    out = an.analyze("trend", orders(spark, sf_dir), ["o_totalprice"], ts="o_orderdate", compare_groups="o_orderstatus")
    return out["chart_data"].withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@register("o9_composition", """
WITH c AS (SELECT 'o_orderstatus' AS feature, o_orderstatus::VARCHAR AS category, count(*) AS value FROM orders GROUP BY ALL
           UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL)
SELECT feature, category, value, round(value * 100.0::DOUBLE / sum(value) OVER (PARTITION BY feature), 6) AS share_pct FROM c
""", "O9 (composition)")
def o9_composition(spark, sf_dir):
    out = an.analyze("composition", table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return round_all(out["chart_data"], 6)


@register("o9_percentile", """
WITH c AS (SELECT c_custkey, round(c_acctbal * 100)::BIGINT::DOUBLE AS balance, nullif(c_nationkey, 0)::DOUBLE AS nation FROM customer),
long AS (UNPIVOT c ON balance, nation INTO NAME feature VALUE value)
SELECT c_custkey, feature, value,
       round(100.0::DOUBLE * count(*) OVER (PARTITION BY feature ORDER BY value) / count(*) OVER (PARTITION BY feature), 6) AS percentile
FROM long
""", "O9 (percentile), A21")
def o9_percentile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", cents("c_acctbal").alias("balance"), F.expr("nullif(c_nationkey, 0)").alias("nation"))
    out = an.analyze("percentile", c, ["balance", "nation"], key="c_custkey", applicants=c)
    return round_all(out["statistics"], 6)


@register("o9_risk_breakdown", f"""
SELECT c_custkey, {len(MODEL_FEATURES)}::BIGINT AS n_factors, true AS ranked, true AS directed, true AS adds_up FROM customer
""", "O9 (risk breakdown of every applicant), M11, M12")
def o9_risk_breakdown(spark, sf_dir):
    d, model = _trained(spark, sf_dir, max_iter=50)
    out = an.analyze("risk_breakdown", d, MODEL_FEATURES, key="c_custkey", applicants=d, model=model)
    told, bars = out["statistics"], out["chart_data"]
    odds = model.transform(d).select("c_custkey", positive_probability().alias("p"))
    checked = told.join(odds, "c_custkey").select(
        "c_custkey", _ranked(F.col("top_contributions")).alias("ranked"),
        _gives(F.col("top_contributions"), F.col("base_probability"), F.col("p")).alias("adds_up"))
    drawn = bars.groupBy("c_custkey").agg(
        F.count_distinct("rank").alias("n_factors"),
        F.min((F.col("direction") == "increases risk") == (F.col("impact") > 0)).alias("directed"))
    return checked.join(drawn, "c_custkey")


# ------------------------------------------------------------ A27
@register("a27_report", """
WITH c AS (SELECT c_custkey, round(c_acctbal * 100)::BIGINT::DOUBLE AS balance, nullif(c_nationkey, 0)::DOUBLE AS nation FROM customer),
m AS (SELECT avg(balance) AS b, avg(nation) AS n FROM c),
p AS (SELECT c_custkey, round(balance / b * 100, 1) AS balance_pct, round(nation / n * 100, 1) AS nation_pct FROM c, m)
SELECT c_custkey, balance_pct + 0.0 AS balance_pct, nation_pct, CASE WHEN balance_pct > 100 THEN 'above' ELSE 'below' END AS balance_is,
       CASE WHEN nation_pct > 100 THEN 'above' WHEN nation_pct IS NOT NULL THEN 'below' END AS nation_is
FROM p
""", "A27 (summary)")
def a27_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", cents("c_acctbal").alias("balance"), F.expr("nullif(c_nationkey, 0)").alias("nation"))
    out = an.applicant_report(c, "c_custkey", c, ["balance", "nation"])
    part = {name: F.get("comparison", F.lit(i)) for i, name in enumerate(["balance", "nation"])}
    return out.select("c_custkey", *[(v["pct_of_avg"] + 0.0).alias(f"{name}_pct") for name, v in part.items()],
                      *[v["position"].alias(f"{name}_is") for name, v in part.items()])


@register("a27_risk_report", """
SELECT c_custkey, 2 AS n_compared, 5 AS n_factors, true AS same_probability, true AS class_follows, true AS told FROM customer
""", "A27 (risk focused), M11, M12, B3, B4")
def a27_risk_report(spark, sf_dir):
    d, model = _trained(spark, sf_dir, max_iter=50)
    out = an.applicant_report(d, "c_custkey", d, MODEL_FEATURES[:2], report_type="risk_focused", model=model,
                              features=MODEL_FEATURES)
    odds = model.transform(d).select("c_custkey", positive_probability().alias("p"))
    return out.join(odds, "c_custkey").select(
        "c_custkey", F.size("comparison").alias("n_compared"), F.size("top_contributions").alias("n_factors"),
        (F.abs(F.col("p") - F.col("probability")) < 1e-9).alias("same_probability"),
        (((F.col("prediction") == 1) == (F.col("probability") >= 0.5))
         & ((F.col("risk_category") == "CRITICAL") == (F.col("probability") >= 0.5))).alias("class_follows"),
        F.col("explanation").startswith("Base default probability").alias("told"))


# ------------------------------------------------------------ B6
@register("b6_explained", f"""
SELECT c.c_custkey::VARCHAR AS name, CASE WHEN e.user_id IS NULL THEN {len(MODEL_FEATURES) - N_EVENT_FEATURES}
       ELSE {len(MODEL_FEATURES)} END AS n_provided, CASE WHEN e.user_id IS NULL THEN {N_EVENT_FEATURES} ELSE 0 END AS n_filled,
       true AS ranked, true AS adds_up
FROM customer c LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON c.c_custkey = e.user_id
""", "B6, B1, B5, M11 (each scenario with its explanation)")
def b6_explained(spark, sf_dir):
    d, model = _trained(spark, sf_dir, max_iter=50)
    req = _requests(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("name"), "features_map",
                                          (F.pmod("c_custkey", F.lit(2)) == 0).alias("fill_missing_with_median"))
    medians = fit_medians(d, MODEL_FEATURES)
    how = {"medians": medians, "means": medians, "top_n": len(MODEL_FEATURES)}
    out = what_if(model, req, MODEL_FEATURES, explained=True, **how)
    plain = what_if(model, req, MODEL_FEATURES, medians=medians).select("name", F.col("probability").alias("p"))
    return out.join(plain, "name").select(
        "name", "n_provided", "n_filled", _ranked(F.col("top_contributions")).alias("ranked"),
        _gives(F.col("top_contributions"), F.col("base_probability"), F.col("p")).alias("adds_up"))


# ------------------------------------------------------------ M1
@register("m1_optimality", " UNION ALL ".join(
    f"SELECT '{t}' AS term, true AS optimal" for t in ["(intercept)", *MODEL_FEATURES]), "M1, K5 (certificate of the fit)")
def m1_optimality(spark, sf_dir):
    """The returned coefficients are a minimum of the weighted loss over the
    training rows: its gradient, summed anew over the rows, vanishes."""
    d, model = _trained(spark, sf_dir)
    return ml.optimality(model, d.where("split = 0"), MODEL_FEATURES, "target", weight="weight").select("term", "optimal")
