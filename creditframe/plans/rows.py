"""Row-feature queries over lineitem (F1-F3) and the repeatable sample (O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import (round_all, row_count_flags, row_max, row_mean, row_min, row_std, safe_div)
from ..operators.analysis import repeatable_sample
from ..sources.tables import cents, table
from .registry import register


@register("f1_ratio", """
SELECT l_orderkey, l_linenumber,
       round(CAST(round(l_extendedprice * 100) AS BIGINT) / nullif(l_quantity, 0), 6) AS PRICE_PER_UNIT,
       round(l_tax / nullif(l_discount, 0), 6) AS TAX_DISCOUNT_RATIO,
       round(l_extendedprice * (1 - l_discount) / nullif(l_extendedprice, 0), 6) AS PAID_SHARE
FROM lineitem
""", "F1, X3")
def f1_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return round_all(li.select(
        "l_orderkey", "l_linenumber",
        safe_div(cents("l_extendedprice"), F.col("l_quantity")).alias("PRICE_PER_UNIT"),   # cents per unit
        safe_div("l_tax", "l_discount").alias("TAX_DISCOUNT_RATIO"),     # a zero discount gives null
        safe_div(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")).alias("PAID_SHARE")),
        6)


ROW_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS d, nullif(l_tax, 0.0) AS t,
                  l_quantity / 100.0 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round((coalesce(d, 0) + coalesce(t, 0) + coalesce(q, 0))
             / nullif(CAST(d IS NOT NULL AS INTEGER) + CAST(t IS NOT NULL AS INTEGER) + CAST(q IS NOT NULL AS INTEGER), 0), 6)
         AS ROW_MEAN,
       round((coalesce(d, 0) + coalesce(t, 0) + coalesce(q, 0)) / 3.0, 6) AS ROW_MEAN_ZERO,
       round(greatest(d, t, q), 6) AS ROW_MAX, round(least(d, t, q), 6) AS ROW_MIN,
       round(CASE WHEN (d IS NOT NULL)::INT + (t IS NOT NULL)::INT + (q IS NOT NULL)::INT >= 2 THEN
         sqrt((coalesce(pow(d - m, 2), 0) + coalesce(pow(t - m, 2), 0) + coalesce(pow(q - m, 2), 0))
              / ((d IS NOT NULL)::INT + (t IS NOT NULL)::INT + (q IS NOT NULL)::INT - 1)) END, 6) AS ROW_STD
FROM (SELECT *, (coalesce(d, 0) + coalesce(t, 0) + coalesce(q, 0))
               / nullif((d IS NOT NULL)::INT + (t IS NOT NULL)::INT + (q IS NOT NULL)::INT, 0) AS m FROM r)
"""


@register("f2_row_stats", ROW_SQL, "F2, X2")
def f2_row_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"),
        F.nullif("l_tax", F.lit(0.0)).alias("t"), (F.col("l_quantity") / 100.0).alias("q"))
    cols = ["d", "t", "q"]
    return round_all(li.select("l_orderkey", "l_linenumber",
                               row_mean(cols).alias("ROW_MEAN"), row_mean(cols, "zero").alias("ROW_MEAN_ZERO"),
                               row_max(cols).alias("ROW_MAX"), row_min(cols).alias("ROW_MIN"),
                               row_std(cols).alias("ROW_STD")), 6)


@register("f3_row_count", """
SELECT l_orderkey, l_linenumber,
       CAST(l_returnflag = 'R' AS INTEGER) + CAST(l_linestatus = 'F' AS INTEGER)
         + coalesce(CAST(nullif(l_discount, 0.0) > 0.05 AS INTEGER), 0) AS FLAG_COUNT
FROM lineitem
""", "F3")
def f3_row_count(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flags = [(F.col("l_returnflag") == "R").cast("int"), (F.col("l_linestatus") == "F").cast("int"),
             (F.nullif("l_discount", F.lit(0.0)) > 0.05).cast("int")]
    return li.select("l_orderkey", "l_linenumber", row_count_flags(flags).alias("FLAG_COUNT"))


@register("o3_sample", None, "O3")
def o3_sample(spark, sf_dir):
    return repeatable_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 200)
