"""Cleaning queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import round_all
from ..operators.clean import (cap_percentiles, days_range_report, iqr_outliers, iqr_summary,
                               out_of_range_counts, replace_sentinel)
from ..sources.tables import cents, events, installments, orders, table
from .registry import register

LINEITEM_C = ("(SELECT * REPLACE (CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice) "
              "FROM lineitem)")


def lineitem_c(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", cents("l_extendedprice"))


@register("p1_sentinel", """
SELECT l_returnflag, l_linestatus, count(*) AS n_rows,
       count(nullif(l_discount, 0.0)) AS n_discount,
       round(avg(nullif(l_discount, 0.0)), 6) AS avg_discount
FROM lineitem GROUP BY l_returnflag, l_linestatus
""", "P1")
def p1_sentinel(spark, sf_dir):
    # a zero discount is the "no value" placeholder here, as 365243 days was
    li = replace_sentinel(table(spark, sf_dir, "lineitem"), ["l_discount"], sentinel=0.0)
    out = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("l_discount").alias("n_discount"),
        F.avg("l_discount").alias("avg_discount"))
    return round_all(out, 6)


@register("p3_cap", """
WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi
           FROM @ORDERS)
SELECT o_orderkey, round(CASE WHEN o_totalprice IS NULL THEN NULL
                              ELSE least(greatest(o_totalprice::DOUBLE, lo), hi) END, 4) AS o_totalprice
FROM @ORDERS, b
""", "P3")
def p3_cap(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    return round_all(cap_percentiles(o, ["o_totalprice"], 0.01, 0.99, method="linear"), 4)


IQR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("p5_iqr", f"""
WITH long AS (
  UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice,
                  l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM {LINEITEM_C})
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
      FROM long GROUP BY feature),
b AS (SELECT feature, q25, q75, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lower_bound,
             q75 + 1.5 * (q75 - q25) AS upper_bound FROM q)
SELECT b.feature, round(q25, 6) AS q25, round(q75, 6) AS q75, round(iqr, 6) AS iqr,
       round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
       CAST(sum(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       round(sum(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 ELSE 0 END) * 100.0::DOUBLE
             / count(*), 6) AS outlier_pct
FROM b JOIN long ON b.feature = long.feature
GROUP BY b.feature, q25, q75, iqr, lower_bound, upper_bound
""", "P4, P5")
def p5_iqr(spark, sf_dir):
    return round_all(iqr_summary(lineitem_c(spark, sf_dir), IQR_COLS, 1.5), 6)


@register("p4_iqr_rows", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM @EVENTS)
SELECT event_id, value,
       round(q25 - 1.5 * (q75 - q25), 4) AS lower_bound, round(q75 + 1.5 * (q75 - q25), 4) AS upper_bound
FROM @EVENTS, b
WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)
""", "P4")
def p4_iqr_rows(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "value")
    return round_all(iqr_outliers(ev, "value", multiplier=1.5), 4)


@register("p18_days_range", """
SELECT 'DAYS_DIFF' AS feature, min(dd) AS min, max(dd) AS max,
       CAST(sum(CASE WHEN dd > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
FROM (SELECT CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS DOUBLE) AS dd
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
""", "P18, P13")
def p18_days_range(spark, sf_dir):
    rows = installments(spark, sf_dir).withColumnRenamed("days_diff", "DAYS_DIFF")
    return days_range_report(rows, needle="DAYS")


@register("p19_out_of_range", """
SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n_below, count(*) FILTER (WHERE c_acctbal > 9000) AS n_above
FROM customer
""", "P19")
def p19_out_of_range(spark, sf_dir):
    return out_of_range_counts(table(spark, sf_dir, "customer"), "c_acctbal", 0, 9000)
