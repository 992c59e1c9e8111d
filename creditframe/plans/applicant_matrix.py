"""Flagship: the applicant feature matrix over the supplied tables.

One lazy plan from the raw scans to one row per applicant, in the shape of
the daily feature build: base table, history aggregates (orders as bureau /
previous applications), first- and last-N history means, instalment and
past-due behaviour (lineitem), a two-hop aggregate, a sparse history
(events), derived ratios, zero fill for missing history and an event time.

Every history block is reduced to one row per applicant *before* it meets
the base, and all blocks are hash-partitioned on the applicant key, so the
joins add one exchange per block and never multiply rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.expressions import plus_div, round_all, safe_div
from ..operators.store import Entity, FeatureView
from ..sources.tables import applicants, cents
from . import children  # noqa: F401  (registers the blocks used below)
from .registry import REGISTRY, register

EVENT_TIME = dt.datetime(2024, 2, 1)

# (query, columns taken from it) in join order; keys are renamed to c_custkey
BLOCKS = [
    ("a1_child_agg", ["ORD_O_TOTALPRICE_MEAN", "ORD_O_TOTALPRICE_MIN", "ORD_O_TOTALPRICE_MAX",
                      "ORD_O_TOTALPRICE_SUM", "ORD_O_TOTALPRICE_COUNT"], "o_custkey"),
    ("a9_cond_count", ["ORD_FILLED_COUNT", "ORD_URGENT_COUNT", "ORD_FILLED_RATE"], "o_custkey"),
    ("a10_distinct", ["ORD_PRIORITY_COUNT", "ORD_STATUS_COUNT"], "o_custkey"),
    ("w2_first_last_n", ["LAST3_O_TOTALPRICE", "LAST3_DAY_NO", "LAST5_O_TOTALPRICE", "LAST10_O_TOTALPRICE",
                         "FIRST2_O_TOTALPRICE", "FIRST2_DAY_NO", "FIRST4_O_TOTALPRICE"], "o_custkey"),
    ("w3_rate_last_n", ["LAST3_FILLED", "LAST5_FILLED", "LAST10_FILLED"], "o_custkey"),
    ("a5_installments", ["INST_AMT_INSTALMENT_MEAN", "INST_AMT_INSTALMENT_SUM", "INST_AMT_INSTALMENT_MAX",
                         "INST_PAYMENT_DIFF_MEAN", "INST_PAYMENT_DIFF_SUM", "INST_PAYMENT_RATIO_MEAN",
                         "INST_PAYMENT_RATIO_MIN", "INST_DAYS_DIFF_MEAN", "INST_DAYS_DIFF_MAX",
                         "INST_LATE_PAYMENT_SUM", "INST_LATE_PAYMENT_MEAN"], "o_custkey"),
    ("a6_past_due", ["PAST_DUE_DAYS_PAST_DUE_MEAN", "PAST_DUE_DAYS_PAST_DUE_MAX", "PAST_DUE_DAYS_PAST_DUE_SUM",
                     "PAST_DUE_PAYMENT_RATIO_STD", "PAST_DUE_SEVERITY"], "o_custkey"),
    ("j2_two_hop", ["LI_L_QUANTITY_MEAN", "LI_L_QUANTITY_MAX", "LI_RETURNED_COUNT"], "o_custkey"),
]
HISTORY_PREFIXES = ("ORD_", "LAST", "FIRST", "INST_", "PAST_DUE_", "LI_", "EVT_")


def _block_sql(name: str, cols: list[str], key: str) -> str:
    return (f"{name} AS (SELECT {key} AS c_custkey, {', '.join(cols)} FROM ({REGISTRY[name].sql}))")


def _derived():
    """F1 / F4 / F6 / F7 analogues on this schema (all null-safe)."""
    return {
        # history value over own balance
        "ORDERS_TO_BALANCE": safe_div(F.col("ORD_O_TOTALPRICE_SUM"), F.col("ACCTBAL_CENTS")),
        # F11-style share of the instalment total that was not paid
        "INST_UNPAID_SHARE": safe_div(-F.col("INST_PAYMENT_DIFF_SUM"), F.col("INST_AMT_INSTALMENT_SUM")),
        # (max - mean) / (max + 1)
        "ORD_PEAK_GAP_RATIO": plus_div(F.col("ORD_O_TOTALPRICE_MAX") - F.col("ORD_O_TOTALPRICE_MEAN"),
                                       F.col("ORD_O_TOTALPRICE_MAX"), 1.0),
        # total / (monthly mean * 12 + 1)
        "ORD_YEARS_OF_INSTALMENTS": plus_div(F.col("ORD_O_TOTALPRICE_SUM"),
                                             F.col("INST_AMT_INSTALMENT_MEAN") * 12, 1.0),
        # W-trend: recent vs early behaviour
        "LAST3_TO_FIRST2": safe_div(F.col("LAST3_O_TOTALPRICE"), F.col("FIRST2_O_TOTALPRICE")),
    }


DERIVED_SQL = """
       ORD_O_TOTALPRICE_SUM / nullif(ACCTBAL_CENTS, 0) AS ORDERS_TO_BALANCE,
       -INST_PAYMENT_DIFF_SUM / nullif(INST_AMT_INSTALMENT_SUM, 0) AS INST_UNPAID_SHARE,
       (ORD_O_TOTALPRICE_MAX - ORD_O_TOTALPRICE_MEAN) / nullif(ORD_O_TOTALPRICE_MAX + 1.0, 0) AS ORD_PEAK_GAP_RATIO,
       ORD_O_TOTALPRICE_SUM / nullif(INST_AMT_INSTALMENT_MEAN * 12 + 1.0, 0) AS ORD_YEARS_OF_INSTALMENTS,
       LAST3_O_TOTALPRICE / nullif(FIRST2_O_TOTALPRICE, 0) AS LAST3_TO_FIRST2"""


def matrix_columns() -> list[str]:
    cols = [c for _, cs, _ in BLOCKS for c in cs]
    cols += ["EVT_VALUE_MEAN", "EVT_VALUE_MAX", "EVT_VALUE_SUM", "EVT_EVENT_ID_COUNT", "EVT_PURCHASE_COUNT",
             "EVT_TYPE_COUNT"]
    return cols + list(_derived())


# rounding of each column exactly as in the block's own registered query
DIGITS_4 = {"ORD_O_TOTALPRICE_MEAN", "ORD_O_TOTALPRICE_MIN", "ORD_O_TOTALPRICE_MAX", "ORD_O_TOTALPRICE_SUM",
            "LAST3_O_TOTALPRICE", "LAST5_O_TOTALPRICE", "LAST10_O_TOTALPRICE", "FIRST2_O_TOTALPRICE",
            "FIRST4_O_TOTALPRICE", "EVT_VALUE_MEAN", "EVT_VALUE_MAX", "EVT_VALUE_SUM"}


def applicant_matrix(spark, sf_dir):
    """Orders statistics in one aggregate, all first/last-N means from one
    window pass, and instalments, past-due behaviour and line quantities from
    one join of lineitem with orders and one aggregate."""
    from ..operators.aggregate import child_aggregate, count_if_equal
    from ..operators.installments import payment_behaviour
    from ..operators.sequence import first_last_means
    from ..sources.tables import events, installments, orders
    from .children import EVENTS_SPEC, ORDERS_SPEC, _orders_seq

    key = "c_custkey"
    base = applicants(spark, sf_dir).select(key, "target", "c_nationkey", cents("c_acctbal").alias("ACCTBAL_CENTS"))
    o = child_aggregate(orders(spark, sf_dir).withColumnRenamed("o_custkey", key), key, ORDERS_SPEC, post={
        "ORD_FILLED_RATE": safe_div(F.col("ORD_FILLED_COUNT"), F.col("ORD_O_TOTALPRICE_COUNT"))})
    seq = first_last_means(_orders_seq(spark, sf_dir).withColumnRenamed("o_custkey", key), key, "o_orderdate",
                           "o_orderkey",
                           last={3: ["o_totalprice", "day_no", "filled"], 5: ["o_totalprice", "filled"],
                                 10: ["o_totalprice", "filled"]},
                           first={2: ["o_totalprice", "day_no"], 4: ["o_totalprice"]})
    lines = installments(spark, sf_dir, "l_quantity", "l_returnflag").withColumnRenamed("o_custkey", key)
    pay = payment_behaviour(lines, key=key, due="amt_instalment", paid="amt_payment", days_diff="days_diff", also=[
        F.avg("l_quantity").alias("LI_L_QUANTITY_MEAN"), F.max("l_quantity").alias("LI_L_QUANTITY_MAX"),
        count_if_equal("l_returnflag", "R").alias("LI_RETURNED_COUNT")])
    ev = child_aggregate(events(spark, sf_dir).withColumnRenamed("user_id", key), key, EVENTS_SPEC)
    out = base
    for block in (o, seq, pay, ev):
        out = out.join(block, key, "left")
    wanted = matrix_columns()[: -len(_derived())]
    out = out.select(key, "target", "c_nationkey", "ACCTBAL_CENTS", *wanted)
    out = out.fillna(0, subset=wanted)      # I1: no history means zero
    out = round_all(out, 4, skip=[c for c in out.columns if c not in DIGITS_4])
    out = round_all(out, 6, skip=list(DIGITS_4))
    out = out.withColumns(_derived())
    out = round_all(out, 6, skip=[c for c in out.columns if c not in _derived()])
    return out.withColumn("event_timestamp", F.date_format(
        F.lit(EVENT_TIME.isoformat(sep=" ")).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"))


def _matrix_sql() -> str:
    blocks = ",\n".join(_block_sql(n, cs, k) for n, cs, k in BLOCKS)
    hist_cols = [c for _, cs, _ in BLOCKS for c in cs]
    ev = """ev AS (SELECT user_id AS c_custkey, round(avg(value), 4) AS EVT_VALUE_MEAN, round(max(value), 4) AS EVT_VALUE_MAX,
             CAST(sum(value) AS BIGINT) AS EVT_VALUE_SUM, count(event_id) AS EVT_EVENT_ID_COUNT,
             CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS EVT_PURCHASE_COUNT,
             count(DISTINCT event_type) AS EVT_TYPE_COUNT FROM @EVENTS GROUP BY user_id)"""
    ev_cols = ["EVT_VALUE_MEAN", "EVT_VALUE_MAX", "EVT_VALUE_SUM", "EVT_EVENT_ID_COUNT", "EVT_PURCHASE_COUNT",
               "EVT_TYPE_COUNT"]
    joins = "\n".join(f"LEFT JOIN {n} USING (c_custkey)" for n, _, _ in BLOCKS) + "\nLEFT JOIN ev USING (c_custkey)"
    filled = ",\n       ".join(f"coalesce({c}, 0) AS {c}" for c in hist_cols + ev_cols)
    derived = ",\n       ".join(f"round({line.strip().rsplit(' AS ', 1)[0]}, 6) AS {line.strip().rsplit(' AS ', 1)[1]}"
                                for line in DERIVED_SQL.strip().rstrip(",").split(",\n"))
    return f"""
WITH {blocks},
{ev},
m AS (SELECT c.c_custkey, CAST(c.c_acctbal < 0 AS INTEGER) AS target, c.c_nationkey,
             CAST(round(c.c_acctbal * 100) AS BIGINT) AS ACCTBAL_CENTS,
       {filled}
      FROM customer c
      {joins})
SELECT *, {derived},
       '{EVENT_TIME.isoformat(sep=" ")}' AS event_timestamp
FROM m
"""


register("f_applicant_matrix", _matrix_sql(),
         "F1, F6, F7, F11, J1, J2, A1, A5, A6, A9, A10, W1-W3, I1, X8 (flagship)")(applicant_matrix)

APPLICANT = Entity("applicant", ("c_custkey",))


def applicant_view():
    """The published view of the flagship matrix."""
    from pyspark.sql import types as T
    feats = T.StructType([T.StructField(c, T.DoubleType()) for c in matrix_columns()])
    return FeatureView("applicant_features", APPLICANT, feats, ts="event_timestamp")
