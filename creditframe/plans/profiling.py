"""Imputation, encoding, profiling and analysis queries.

Customer is the applicant population (label ``c_acctbal < 0``); lineitem
supplies numeric measures; orders and events supply categories and time.
Money is in integer cents (see ``sources.tables``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import round_all
from ..operators import analysis as an
from ..operators import profile as pr
from ..operators.impute import fill_median, fill_mode, label_encode
from ..operators.ordered import percent_rank_le
from ..sources.tables import applicants, cents, events, installments, orders, table
from .children import J1_SQL, applicant_history
from .cleaning import LINEITEM_C, lineitem_c
from .registry import register

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_LONG = f"""
  UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice,
                  l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM {LINEITEM_C})
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value"""


# ---------------------------------------------------------------- impute
@register("i2_median", """
WITH b AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS d, nullif(l_tax, 0.0) AS t FROM lineitem),
m AS (SELECT median(d) AS md, median(t) AS mt FROM b)
SELECT l_orderkey, l_linenumber, round(coalesce(d, md), 6) AS l_discount, round(coalesce(t, mt), 6) AS l_tax
FROM b, m
""", "I2")
def i2_median(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return round_all(fill_median(li, ["l_discount", "l_tax"]), 6)


@register("i3_mode", """
WITH b AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p, nullif(o_orderstatus, 'P') AS s FROM orders),
mp AS (SELECT p AS v FROM b WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p ASC LIMIT 1),
ms AS (SELECT s AS v FROM b WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s ASC LIMIT 1)
SELECT o_orderkey, coalesce(p, (SELECT v FROM mp)) AS o_orderpriority,
       coalesce(s, (SELECT v FROM ms)) AS o_orderstatus
FROM b
""", "I3")
def i3_mode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return fill_mode(o, ["o_orderpriority", "o_orderstatus"])


@register("e1_label_encode", """
SELECT c_custkey,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment,
       CAST(dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS DOUBLE) AS c_nationkey
FROM customer
""", "E1, E2")
def e1_label_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return label_encode(c, ["c_mktsegment", "c_nationkey"], null_token="missing")


# --------------------------------------------------------------- profile
@register("a11_label_rate", """
SELECT count(*) AS n_rows, CAST(sum(CAST(c_acctbal < 0 AS INTEGER)) AS BIGINT) AS n_positive,
       round(avg(CAST(c_acctbal < 0 AS INTEGER)::DOUBLE), 6) AS rate
FROM customer
""", "A11")
def a11_label_rate(spark, sf_dir):
    return round_all(pr.label_rate(applicants(spark, sf_dir), "target"), 6)


@register("a12_value_counts", """
SELECT p_brand, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 6) AS share
FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5
""", "A12")
def a12_value_counts(spark, sf_dir):
    return round_all(pr.value_counts(table(spark, sf_dir, "part"), "p_brand", top_n=5), 6)


@register("a13_distinct", """
UNPIVOT (SELECT count(DISTINCT c_mktsegment) AS c_mktsegment, count(DISTINCT c_nationkey) AS c_nationkey,
                count(DISTINCT c_name) AS c_name FROM customer)
ON c_mktsegment, c_nationkey, c_name INTO NAME feature VALUE n_distinct
""", "A13")
def a13_distinct(spark, sf_dir):
    return pr.distinct_counts(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey", "c_name"])


DESCRIBE_SQL = """
WITH long AS ({long})
SELECT {by}feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75,
       round(max(value), 6) AS max
FROM long GROUP BY {by}feature
"""


@register("a14_describe", DESCRIBE_SQL.format(long=LI_LONG, by=""), "A14")
def a14_describe(spark, sf_dir):
    return round_all(pr.describe(lineitem_c(spark, sf_dir), LI_COLS), 6)


@register("a20_profile", DESCRIBE_SQL.format(by="", long="""
  UNPIVOT (SELECT CAST(round(c_acctbal * 100) AS BIGINT)::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey
           FROM customer) ON c_acctbal, c_nationkey INTO NAME feature VALUE value"""), "A20")
def a20_profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(cents("c_acctbal").alias("c_acctbal"), "c_nationkey")
    return round_all(pr.describe(c, ["c_acctbal", "c_nationkey"]), 6)


@register("a15_missing", """
WITH b AS (SELECT l_orderkey, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax,
                  nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem),
r AS (SELECT count(*) AS n, count(*) - count(l_orderkey) AS l_orderkey, count(*) - count(l_discount) AS l_discount,
             count(*) - count(l_tax) AS l_tax, count(*) - count(l_returnflag) AS l_returnflag FROM b),
long AS (UNPIVOT r ON l_orderkey, l_discount, l_tax, l_returnflag INTO NAME feature VALUE missing_count)
SELECT feature, CAST(missing_count AS BIGINT) AS missing_count, round(missing_count * 100.0::DOUBLE / n, 6) AS missing_pct
FROM long WHERE missing_count > 0
""", "A15, A16")
def a15_missing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"))
    return round_all(pr.missing_report(li), 6)


@register("a17_coverage", """
WITH base AS (SELECT count(DISTINCT c_custkey) AS nb FROM customer),
parts AS (
  SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_applicants FROM orders
  UNION ALL SELECT 'events', count(*), count(DISTINCT user_id) FROM events
  UNION ALL SELECT 'installments', count(*), count(DISTINCT o.o_custkey)
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT table_name, n_rows, n_applicants, round(n_applicants * 100.0::DOUBLE / nb, 4) AS pct_of_base,
       round(n_rows::DOUBLE / n_applicants, 4) AS avg_rows_per_applicant
FROM parts, base
""", "A17")
def a17_coverage(spark, sf_dir):
    base = table(spark, sf_dir, "customer")
    return pr.coverage(base, "c_custkey", {
        "orders": (table(spark, sf_dir, "orders"), "o_custkey"),
        "events": (table(spark, sf_dir, "events"), "user_id"),
        "installments": (installments(spark, sf_dir), "o_custkey"),
    }, digits=4)


@register("a29_duplicates", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
""", "A29")
def a29_duplicates(spark, sf_dir):
    return pr.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("a30_quality", """
WITH b AS (SELECT nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax, l_quantity,
                  CAST(l_returnflag = 'R' AS INTEGER) AS returned FROM lineitem),
d AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
      FROM (SELECT count(*) AS c FROM b GROUP BY l_discount, l_tax, l_quantity, returned))
SELECT count(*) AS n_rows,
       CAST(count(*) - count(l_discount) + count(*) - count(l_tax) + count(*) - count(l_quantity) AS BIGINT) AS missing_cells,
       CAST(sum(CASE WHEN returned = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
       CAST(sum(CASE WHEN returned = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
       3 AS n_features,
       round((count(*) - count(l_discount) + count(*) - count(l_tax) + count(*) - count(l_quantity)) * 100.0::DOUBLE
             / (count(*) * 3), 6) AS missing_pct,
       any_value(d.n_duplicates) AS n_duplicates
FROM b, d
""", "A30, A29")
def a30_quality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    out = pr.quality_summary(li, label="returned")
    return round_all(out.withColumn("n_features", F.col("n_features").cast("int")), 6)


# ---------------------------------------------------------- by label
ORDERS_BY_LABEL = """
  SELECT CAST(c.c_acctbal < 0 AS INTEGER) AS target, o.o_totalprice::DOUBLE AS o_totalprice,
         date_diff('day', DATE '1990-01-01', o.o_orderdate)::DOUBLE AS day_no
  FROM @ORDERS o JOIN customer c ON o.o_custkey = c.c_custkey"""


def _orders_by_label(spark, sf_dir):
    o = orders(spark, sf_dir)
    c = applicants(spark, sf_dir).select("c_custkey", "target")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "target", "o_totalprice",
        F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double").alias("day_no"))


@register("a18_group_stats", f"""
WITH long AS (UNPIVOT ({ORDERS_BY_LABEL}) ON o_totalprice, day_no INTO NAME feature VALUE value)
SELECT target, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS count
FROM long GROUP BY target, feature
""", "A18")
def a18_group_stats(spark, sf_dir):
    return round_all(an.group_stats(_orders_by_label(spark, sf_dir), ["o_totalprice", "day_no"], "target"), 6)


@register("a31_box_by_label", f"""
WITH long AS (UNPIVOT ({ORDERS_BY_LABEL}) ON o_totalprice, day_no INTO NAME feature VALUE value)
SELECT target, feature, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75,
       round(max(value), 6) AS max
FROM long GROUP BY target, feature
""", "A31")
def a31_box_by_label(spark, sf_dir):
    return round_all(pr.five_numbers(_orders_by_label(spark, sf_dir), ["o_totalprice", "day_no"], "target"), 6)


@register("a19_label_by_flag", """
SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS filled, round(avg(CAST(c.c_acctbal < 0 AS INTEGER)::DOUBLE), 6) AS label_mean,
       count(*) AS count
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1
""", "A19")
def a19_label_by_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("filled"))
    c = applicants(spark, sf_dir).select("c_custkey", "target")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return round_all(pr.label_by_flag(j, "filled", "target"), 6)


@register("a21_pct_rank", """
SELECT c_custkey, c_acctbal, round(cume_dist() OVER (ORDER BY c_acctbal) * 100, 6) AS pct_rank FROM customer
""", "A21")
def a21_pct_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return round_all(percent_rank_le(c, "c_acctbal"), 6)


HIST_SQL = f"""
WITH long AS ({LI_LONG}),
st AS (SELECT feature, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q25,
              quantile_cont(value, 0.75) AS q75 FROM long GROUP BY feature),
b AS (SELECT feature, greatest(mn, q25 - 1.5 * (q75 - q25)) AS lo, least(mx, q75 + 1.5 * (q75 - q25)) AS hi
      FROM st WHERE least(mx, q75 + 1.5 * (q75 - q25)) > greatest(mn, q25 - 1.5 * (q75 - q25))),
cnt AS (SELECT l.feature, CAST(floor((value - lo) / (hi - lo) * 20) + 1 AS INTEGER) AS bin, count(*) AS c
        FROM long l JOIN b ON l.feature = b.feature WHERE value BETWEEN lo AND hi GROUP BY ALL),
grid AS (SELECT feature, lo, hi, UNNEST(range(1, 21)) AS bin FROM b)
SELECT g.feature, g.bin::INTEGER AS bin, round(lo + (g.bin - 1) * ((hi - lo) / 20), 6) AS range_start,
       round(lo + g.bin * ((hi - lo) / 20), 6) AS range_end, CAST(coalesce(c, 0) AS BIGINT) AS count,
       CASE WHEN lo + (g.bin - 1) * ((hi - lo) / 20) >= 1000
            THEN CAST(CAST(round_even((lo + (g.bin - 1) * ((hi - lo) / 20)) / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'K'
            ELSE CAST(CAST(round_even(lo + (g.bin - 1) * ((hi - lo) / 20), 0) AS BIGINT) AS VARCHAR) END AS label
FROM grid g LEFT JOIN cnt ON g.feature = cnt.feature AND g.bin = cnt.bin
"""


@register("a22_histogram", HIST_SQL, "A22, X7")
def a22_histogram(spark, sf_dir):
    return an.histogram_iqr(lineitem_c(spark, sf_dir), LI_COLS, 20, digits=6)


@register("a23_histogram_minmax", """
WITH st AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
cnt AS (SELECT least(CAST(floor((l_quantity - lo) / (hi - lo) * 10) + 1 AS INTEGER), 10) AS bin, count(*) AS c
        FROM lineitem, st GROUP BY 1),
grid AS (SELECT lo, hi, UNNEST(range(1, 11)) AS bin FROM st)
SELECT 'l_quantity' AS feature, g.bin::INTEGER AS bin, round(lo + (g.bin - 1) * ((hi - lo) / 10), 6) AS range_start,
       round(lo + g.bin * ((hi - lo) / 10), 6) AS range_end, CAST(coalesce(c, 0) AS BIGINT) AS count,
       CAST(CAST(round_even(lo + (g.bin - 1) * ((hi - lo) / 10), 0) AS BIGINT) AS VARCHAR) AS label
FROM grid g LEFT JOIN cnt ON g.bin = cnt.bin
""", "A23")
def a23_histogram_minmax(spark, sf_dir):
    return an.histogram_minmax(table(spark, sf_dir, "lineitem"), ["l_quantity"], 10, digits=6)


# ----------------------------------------------------------- correlation
CORR_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_extendedprice", "l_discount")]


def _sql_corr(a: str, b: str) -> str:
    return (f"CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN corr({a}, {b}) END")


@register("a24_corr", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round({_sql_corr(a, b)}, 6) AS corr FROM {LINEITEM_C}"
    for a, b in CORR_PAIRS), "A24")
def a24_corr(spark, sf_dir):
    return round_all(an.correlations(lineitem_c(spark, sf_dir), CORR_PAIRS), 6)


MATRIX_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "paid"]
LI_PAID = (f"(SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount, l_tax, "
           f"l_extendedprice * (1 - l_discount) AS paid FROM {LINEITEM_C})")


def _li_paid(spark, sf_dir):
    li = lineitem_c(spark, sf_dir)
    return li.select(*[F.col(c).cast("double").alias(c) for c in LI_COLS],
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))


a25_sql = "\nUNION ALL\n".join(
    [f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, "
     f"round(coalesce({_sql_corr(a, b)}, 0.0), 3) + 0.0 AS corr FROM {LI_PAID}"  # -0.0 -> 0.0
     for a in MATRIX_COLS for b in MATRIX_COLS if a != b]
    + [f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in MATRIX_COLS])


@register("a25_corr_matrix", a25_sql, "A25")
def a25_corr_matrix(spark, sf_dir):
    return an.correlation_matrix(_li_paid(spark, sf_dir), MATRIX_COLS, digits=3)


@register("p11_corr_prune", f"""
WITH pairs AS (
  {" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{b}' AS feature, abs(corr({a}, {b})) AS r FROM {LI_PAID}"
                      for i, a in enumerate(MATRIX_COLS) for j, b in enumerate(MATRIX_COLS) if i < j)})
SELECT f.feature, NOT EXISTS (SELECT 1 FROM pairs p WHERE p.feature = f.feature AND p.r > 0.95) AS kept
FROM (VALUES {", ".join(f"('{c}')" for c in MATRIX_COLS)}) f(feature)
""", "P11")
def p11_corr_prune(spark, sf_dir):
    _, dropped = an.drop_correlated(_li_paid(spark, sf_dir), MATRIX_COLS, 0.95)
    rows = [(c, c not in dropped) for c in MATRIX_COLS]
    return spark.createDataFrame(rows, "feature string, kept boolean")


CORR_LABEL_FEATS = ["ORD_O_TOTALPRICE_MEAN", "ORD_O_TOTALPRICE_COUNT", "ORD_FILLED_COUNT", "EVT_VALUE_SUM",
                    "EVT_EVENT_ID_COUNT"]


@register("a26_corr_label", f"""
WITH j AS ({J1_SQL})
SELECT feature, round(corr, 6) AS corr FROM (UNPIVOT (SELECT
  {", ".join(f"{_sql_corr(f, 'target')} AS {f}" for f in CORR_LABEL_FEATS)} FROM j)
  ON {", ".join(CORR_LABEL_FEATS)} INTO NAME feature VALUE corr)
""", "A26")
def a26_corr_label(spark, sf_dir):
    j = applicant_history(spark, sf_dir)
    return round_all(an.correlation_with_label(j, CORR_LABEL_FEATS, "target"), 6)


# ------------------------------------------------------------ shaping
@register("o4_union_flag", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1 AS is_train FROM orders WHERE o_orderstatus <> 'O'
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 0 AS is_train FROM orders WHERE o_orderstatus = 'O'
""", "O4")
def o4_union_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where(F.col("o_orderstatus") != "O").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    b = o.where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                      "o_totalprice", "o_orderdate")
    return an.union_with_flag(a, b, "is_train")


@register("o5_unpivot", """
UNPIVOT (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT)::DOUBLE AS c_acctbal,
                c_nationkey::DOUBLE AS c_nationkey FROM customer)
ON c_acctbal, c_nationkey INTO NAME variable VALUE value
""", "O5")
def o5_unpivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", cents("c_acctbal").cast("double").alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return an.to_long(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@register("o6_pivot", """
SELECT o_orderpriority,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS BIGINT) AS F,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS BIGINT) AS O,
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS BIGINT) AS P
FROM @ORDERS GROUP BY o_orderpriority
""", "O6")
def o6_pivot(spark, sf_dir):
    s = orders(spark, sf_dir).groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    return an.to_wide(s, "o_orderpriority", "o_orderstatus", "v", ["F", "O", "P"])


@register("o7_trend", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, event_type, CAST(sum(value) AS BIGINT) AS value
FROM @EVENTS GROUP BY ALL
""", "O7")
def o7_trend(spark, sf_dir):
    t = an.trend(events(spark, sf_dir), "ts", "value", unit="day", series="event_type")
    return t.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "event_type", "value")


@register("o8_share", """
SELECT event_type, CAST(sum(value) AS BIGINT) AS value,
       round(sum(value) * 100.0::DOUBLE / (SELECT sum(value) FROM @EVENTS), 6) AS share_pct
FROM @EVENTS GROUP BY event_type
""", "O8, W7")
def o8_share(spark, sf_dir):
    return round_all(an.composition(events(spark, sf_dir), "event_type", "value"), 6)


@register("w4_cum_share", """
WITH v AS (SELECT c_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS value
           FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, value,
       round(sum(value) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(value) OVER (), 6)
         AS cumulative_share
FROM v
""", "W4")
def w4_cum_share(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(cents("c_acctbal")).alias("value"))
    return round_all(an.cumulative_share(c, "value", order_desc=True), 6)


@register("w5_waterfall", """
WITH s AS (SELECT CAST(day(ts) AS INTEGER) AS step,
                  CAST(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END) AS BIGINT) AS value
           FROM @EVENTS GROUP BY 1)
SELECT step, value,
       CAST(coalesce(sum(value) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(sum(value) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
FROM s
""", "W5")
def w5_waterfall(spark, sf_dir):
    e = events(spark, sf_dir)
    signed = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value"))
    s = e.groupBy(F.dayofmonth("ts").alias("step")).agg(F.sum(signed).alias("value"))
    out = an.waterfall(s, "step", "value")
    return out.select("step", "value", F.col("start").cast("long"), F.col("end").cast("long"))


FUNNEL_STEPS = {"view": 1, "click": 2, "purchase": 3}


@register("w6_funnel", """
WITH s AS (SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS step,
                  count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1)
SELECT step, users, round(users * 100.0::DOUBLE / (SELECT users FROM s WHERE step = 1), 6) AS pct_of_first FROM s
""", "W6")
def w6_funnel(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    step = F.create_map(*[x for k, v in FUNNEL_STEPS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    s = e.where(F.col("event_type").isin(list(FUNNEL_STEPS))).groupBy(step.alias("step")).agg(
        F.count_distinct("user_id").alias("users"))
    return round_all(an.funnel(s, "step", "users"), 6)


@register("a16_missing_tables", """
WITH li AS (SELECT count(*) AS n, count(*) - count(nullif(l_discount, 0.0)) AS l_discount,
                   count(*) - count(nullif(l_tax, 0.0)) AS l_tax, 0 AS l_orderkey FROM lineitem),
od AS (SELECT count(*) AS n, count(*) - count(nullif(o_orderpriority, '5-LOW')) AS o_orderpriority,
              0 AS o_orderkey FROM orders),
long AS (
  SELECT 'lineitem' AS table_name, feature, missing_count, n
  FROM (UNPIVOT li ON l_discount, l_tax, l_orderkey INTO NAME feature VALUE missing_count)
  UNION ALL
  SELECT 'orders', feature, missing_count, n
  FROM (UNPIVOT od ON o_orderpriority, o_orderkey INTO NAME feature VALUE missing_count))
SELECT table_name, feature, CAST(missing_count AS BIGINT) AS missing_count,
       round(missing_count * 100.0::DOUBLE / n, 6) AS missing_pct
FROM long WHERE missing_count > 0
""", "A16")
def a16_missing_tables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    od = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return round_all(pr.missing_by_table({"lineitem": li, "orders": od}), 6)


@register("a27_vs_population", """
WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT)::DOUBLE AS c_acctbal,
                  c_nationkey::DOUBLE AS c_nationkey FROM customer),
long AS (UNPIVOT c ON c_acctbal, c_nationkey INTO NAME feature VALUE value),
m AS (SELECT feature, avg(value) AS pop_mean FROM long GROUP BY feature)
SELECT c_custkey, long.feature, value, round(pop_mean, 6) AS pop_mean,
       round(round(value / nullif(pop_mean, 0) * 100, 1), 6) + 0.0 AS pct_of_avg,  -- -0.0 -> 0.0
       CASE WHEN round(value / nullif(pop_mean, 0) * 100, 1) > 100 THEN 'above'
            WHEN round(value / nullif(pop_mean, 0) * 100, 1) IS NOT NULL THEN 'below' END AS position
FROM long JOIN m ON long.feature = m.feature
""", "A27, J5")
def a27_vs_population(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", cents("c_acctbal").cast("double").alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"))
    ids = c.select("c_custkey")          # every applicant: the whole population report
    out = an.report_vs_population(c, "c_custkey", ids, ["c_acctbal", "c_nationkey"])
    return out.withColumn("pop_mean", F.round("pop_mean", 6)).withColumn("pct_of_avg", F.round("pct_of_avg", 6))
