"""Nearest-neighbour queries (J4, K1) on the applicant table.

Applicants are placed by nation and account-balance band (thousands), which
gives many identical points and many equal distances: the tie rule of
:mod:`operators.knn` is exercised on every query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import round_all
from ..operators.knn import knn_target_mean
from ..sources.tables import applicants
from .registry import register

K = 10


def knn_frame(spark, sf_dir):
    return applicants(spark, sf_dir).select(
        "c_custkey", "target", F.col("c_nationkey").cast("double").alias("x1"),
        F.floor(F.col("c_acctbal") / 1000).cast("double").alias("x2"))


@register("k1_knn_mean", f"""
WITH c AS (SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS target, c_nationkey::DOUBLE AS x1,
                  floor(c_acctbal / 1000)::DOUBLE AS x2 FROM customer),
pts AS (SELECT x1, x2, count(*) AS cnt, sum(target)::DOUBLE AS ysum FROM c GROUP BY x1, x2),
pairs AS (SELECT q.x1 AS qx1, q.x2 AS qx2, p.x1, p.x2, p.cnt, p.ysum,
                 (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2) AS d2
          FROM pts q, pts p),
ranked AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY qx1, qx2 ORDER BY d2, x1, x2
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM pairs),
m AS (SELECT qx1, qx2, sum(least(cnt, {K} - before) * ysum / cnt) / {K} AS m FROM ranked WHERE before < {K}
      GROUP BY qx1, qx2)
SELECT c.c_custkey, round(m.m, 6) AS KNN_TARGET_MEAN
FROM c JOIN m ON c.x1 = m.qx1 AND c.x2 = m.qx2
""", "J4, K1")
def k1_knn_mean(spark, sf_dir):
    out = knn_target_mean(knn_frame(spark, sf_dir), "c_custkey", ["x1", "x2"], "target", K)
    return round_all(out, 6)


# --- four dimensions, two of them mostly filled with one value -------------
X3 = "CASE WHEN c_custkey % 9 < 5 THEN 3 ELSE c_custkey % 101 END"
X4 = "CASE WHEN c_custkey % 5 = 0 THEN 50 ELSE (c_custkey * 37) % 97 END"
K4 = 50


@register("k1_knn_mean_4d", f"""
WITH c AS (SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS target, c_nationkey::DOUBLE AS x1,
                  floor(c_acctbal / 500)::DOUBLE AS x2, ({X3})::DOUBLE AS x3, ({X4})::DOUBLE AS x4 FROM customer),
pairs AS (SELECT q.c_custkey, p.target, p.x1, p.x2, p.x3, p.x4,
                 (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2)
                 + (p.x3 - q.x3) * (p.x3 - q.x3) + (p.x4 - q.x4) * (p.x4 - q.x4) AS d2
          FROM c q, c p),
ranked AS (SELECT *, rank() OVER (PARTITION BY c_custkey ORDER BY d2, x1, x2, x3, x4) - 1 AS before,
                  count(*) OVER (PARTITION BY c_custkey, d2, x1, x2, x3, x4) AS same
           FROM pairs)
SELECT c_custkey, round(sum(target * least(1.0, ({K4} - before)::DOUBLE / same)) / {K4}, 6) AS KNN_TARGET_MEAN
FROM ranked WHERE before < {K4} GROUP BY c_custkey
""", "J4, K1 (row by row against every row)")
def k1_knn_mean_4d(spark, sf_dir):
    c = applicants(spark, sf_dir).select(
        "c_custkey", "target", F.col("c_nationkey").cast("double").alias("x1"),
        F.floor(F.col("c_acctbal") / 500).cast("double").alias("x2"),
        F.expr(X3).cast("double").alias("x3"), F.expr(X4).cast("double").alias("x4"))
    return round_all(knn_target_mean(c, "c_custkey", ["x1", "x2", "x3", "x4"], "target", K4), 6)


RESAMPLE_FEATURES = ["ORD_O_TOTALPRICE_MEAN", "ORD_O_TOTALPRICE_COUNT", "EVT_VALUE_SUM"]


@register("k4_smote", None, "K4, J4")
def k4_smote(spark, sf_dir):
    from .children import applicant_history
    from ..operators.resample import smote
    h = applicant_history(spark, sf_dir).select("c_custkey", "target", *RESAMPLE_FEATURES)
    return smote(h, "c_custkey", RESAMPLE_FEATURES, "target", k=5, seed=42)


TREES, SAMPLE, DEPTH = 100, 256, 8
_BITS_SQL = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _forest_sql() -> str:
    """The forest over the applicant history, grown level by level in SQL:
    ``r`` holds the rows, ``f`` the nodes."""
    k = range(len(RESAMPLE_FEATURES))
    xs = ", ".join(f"x{i}" for i in k)
    bits = _BITS_SQL.format
    node = "':' || tree || ':' || node || ':42'"
    value = "CASE n.feature " + " ".join(f"WHEN {i} THEN s.x{i}" for i in k) + " END"
    out = [f"""WITH o AS (SELECT o_custkey AS k, sum(o_totalprice)::DOUBLE / count(o_totalprice) AS x0,
                          count(o_totalprice)::DOUBLE AS x1 FROM @ORDERS GROUP BY o_custkey),
e AS (SELECT user_id AS k, sum(value)::DOUBLE AS x2 FROM @EVENTS GROUP BY user_id),
r AS MATERIALIZED (SELECT c_custkey AS k, CAST(c_acctbal < 0 AS INTEGER) AS target, coalesce(x0, 0.0::DOUBLE) AS x0,
                          coalesce(x1, 0.0::DOUBLE) AS x1, coalesce(x2, 0.0::DOUBLE) AS x2
                   FROM customer LEFT JOIN o ON c_custkey = o.k LEFT JOIN e ON c_custkey = e.k),
t AS (SELECT i AS tree, {bits("'a:' || i || ':42'")} % 2147483646 + 1 AS a, {bits("'b:' || i || ':42'")} % 2147483647 AS b
      FROM range({TREES}) g(i)),
s0 AS MATERIALIZED (SELECT tree, 1 AS node, {xs} FROM (
  SELECT tree, {xs}, row_number() OVER (PARTITION BY tree ORDER BY (h % 2147483647 * a + b) % 2147483647, h, k) AS place
  FROM (SELECT *, {bits("k || ':42'")} AS h FROM r), t) WHERE place <= {SAMPLE})"""]
    for d in range(DEPTH + 1):
        ranges = ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in k)
        usable = " || ".join(f"(CASE WHEN hi{i} > lo{i} THEN [{i}] ELSE []::INTEGER[] END)" for i in k) if d < DEPTH \
            else "[]::INTEGER[]"
        lo, hi = ("CASE feature " + " ".join(f"WHEN {i} THEN {b}{i}" for i in k) + " END" for b in ("lo", "hi"))
        out.append(f"""n{d} AS MATERIALIZED (
  SELECT tree, node, size, feature, CASE WHEN feature < 0 THEN 0.0::DOUBLE WHEN cut <= lo THEN hi ELSE cut END AS threshold
  FROM (SELECT *, lo + {bits("'t' || " + node)}::DOUBLE / 1152921504606846976::DOUBLE * (hi - lo) AS cut
        FROM (SELECT *, {lo} AS lo, {hi} AS hi
              FROM (SELECT *, CASE WHEN len(u) = 0 THEN -1 ELSE u[1 + least(len(u) - 1, floor(
                           {bits("'f' || " + node)}::DOUBLE / 1152921504606846976::DOUBLE * len(u))::BIGINT)] END AS feature
                    FROM (SELECT *, {usable} AS u
                          FROM (SELECT tree, node, count(*) AS size, {ranges} FROM s{d} GROUP BY tree, node))))))""")
        if d < DEPTH:
            out.append(f"""s{d + 1} AS MATERIALIZED (SELECT s.tree, 2 * s.node + CAST({value} >= n.threshold AS INTEGER) AS node, {xs}
  FROM s{d} s JOIN n{d} n ON s.tree = n.tree AND s.node = n.node WHERE n.feature >= 0)""")
    out.append("f AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(DEPTH + 1)) + ")")
    return ",\n".join(out)


def _path_sql() -> str:
    """Every row walked down every tree, one join a level."""
    value = "CASE f.feature " + " ".join(f"WHEN {i} THEN r.x{i}" for i in range(len(RESAMPLE_FEATURES))) + " END"
    c = lambda n: (f"floor((CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE)"  # noqa: E731
                   f" - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
                   " * 4294967296::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE")
    steps = [f"w0 AS (SELECT k, tree, 1 AS node FROM r, range({TREES}) g(tree))"]
    for d in range(DEPTH):
        steps.append(f"""w{d + 1} AS MATERIALIZED (SELECT w.k, w.tree, CASE WHEN f.feature < 0 THEN w.node
    ELSE 2 * w.node + CAST({value} >= f.threshold AS INTEGER) END AS node
  FROM w{d} w JOIN r ON w.k = r.k JOIN f ON w.tree = f.tree AND w.node = f.node)""")
    steps.append(f"""m AS (SELECT w.k, sum(floor(log2(w.node::DOUBLE)) + {c("f.size")}) / {TREES} AS path
  FROM w{DEPTH} w JOIN f ON w.tree = f.tree AND w.node = f.node GROUP BY w.k)""")
    steps.append(f"""p AS MATERIALIZED (SELECT k, -pow(2.0::DOUBLE, -path / (SELECT {c("v")} FROM (
    SELECT least({SAMPLE}, count(*)) AS v FROM r))) AS score FROM m)""")
    return ",\n".join(steps)


@register("p6_iforest", _forest_sql() + ",\n" + _path_sql() + """
SELECT r.k AS c_custkey, r.target, round(score, 6) AS outlier_score,
       CASE WHEN score < (SELECT quantile_cont(score, 0.05) FROM p) THEN -1 ELSE 1 END AS outlier_label
FROM p JOIN r ON p.k = r.k
""", "P6 (every score and label)")
def p6_iforest(spark, sf_dir):
    from .children import applicant_history
    from ..operators.outliers import isolation_forest
    h = applicant_history(spark, sf_dir).select("c_custkey", "target", *RESAMPLE_FEATURES)
    scored = isolation_forest(h, "c_custkey", RESAMPLE_FEATURES, trees=TREES, sample_size=SAMPLE, contamination=0.05, seed=42)
    return scored.withColumn("outlier_score", F.round("outlier_score", 6)).join(h.select("c_custkey", "target"), "c_custkey")


@register("p6_forest", _forest_sql() + """
SELECT tree::INTEGER AS tree, node::INTEGER AS node, feature::INTEGER AS feature, round(threshold, 2) AS threshold, size FROM f
""", "P6 (every node of the forest)")
def p6_forest(spark, sf_dir):
    from .children import applicant_history
    from ..operators.outliers import forest_table
    h = applicant_history(spark, sf_dir).select("c_custkey", *RESAMPLE_FEATURES)
    nodes = forest_table(h, "c_custkey", RESAMPLE_FEATURES, trees=TREES, sample_size=SAMPLE, seed=42)
    return nodes.withColumn("threshold", F.round("threshold", 2))
