"""Child-table aggregates joined to the applicant.

Roles on the supplied tables: ``customer`` is the applicant, ``orders`` the
bureau / previous-application history (status ``F`` is the approved flag,
priority the type, order date the decision day), ``lineitem`` the second hop
and the instalments, ``events`` a sparse history (most customers have none,
which exercises the left join and the zero fill).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import round_all, safe_div
from ..operators.aggregate import AggSpec, attach, child_aggregate, two_hop_aggregate
from ..operators.installments import installment_aggregate, past_due_aggregate, payment_rows
from ..operators.sequence import first_last_means
from ..sources.tables import cents, applicants, events, installments, orders, table
from .registry import register

ORDERS_SPEC = AggSpec(
    prefix="ORD",
    measures={"o_totalprice": ["mean", "min", "max", "sum", "count"]},
    counts_if={"ORD_FILLED_COUNT": ("o_orderstatus", "F"),
               "ORD_URGENT_COUNT": ("o_orderpriority", "1-URGENT")},
    distinct={"ORD_PRIORITY_COUNT": "o_orderpriority", "ORD_STATUS_COUNT": "o_orderstatus"},
)

EVENTS_SPEC = AggSpec(
    prefix="EVT",
    measures={"value": ["mean", "max", "sum"], "event_id": ["count"]},
    counts_if={"EVT_PURCHASE_COUNT": ("event_type", "purchase")},
    distinct={"EVT_TYPE_COUNT": "event_type"},
)


def orders_aggregate(spark, sf_dir):
    orders_ = orders(spark, sf_dir)
    return child_aggregate(orders_, "o_custkey", ORDERS_SPEC, post={
        # approval rate on the aggregate output
        "ORD_FILLED_RATE": safe_div(F.col("ORD_FILLED_COUNT"), F.col("ORD_O_TOTALPRICE_COUNT")),
    })


@register("a1_child_agg", """
SELECT o_custkey,
       round(avg(o_totalprice), 4) AS ORD_O_TOTALPRICE_MEAN,
       round(min(o_totalprice), 4) AS ORD_O_TOTALPRICE_MIN,
       round(max(o_totalprice), 4) AS ORD_O_TOTALPRICE_MAX,
       CAST(sum(o_totalprice) AS BIGINT) AS ORD_O_TOTALPRICE_SUM,
       count(o_totalprice) AS ORD_O_TOTALPRICE_COUNT
FROM @ORDERS GROUP BY o_custkey
""", "A1")
def a1_child_agg(spark, sf_dir):
    spec = AggSpec(prefix="ORD", measures=ORDERS_SPEC.measures)
    return round_all(child_aggregate(orders(spark, sf_dir), "o_custkey", spec), 4)


@register("a9_cond_count", """
SELECT o_custkey,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS ORD_FILLED_COUNT,
       CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS ORD_URGENT_COUNT,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS ORD_FILLED_RATE
FROM @ORDERS GROUP BY o_custkey
""", "A9, F11")
def a9_cond_count(spark, sf_dir):
    spec = AggSpec(prefix="ORD", measures={"o_totalprice": ["count"]}, counts_if=ORDERS_SPEC.counts_if)
    out = child_aggregate(orders(spark, sf_dir), "o_custkey", spec, post={
        "ORD_FILLED_RATE": safe_div(F.col("ORD_FILLED_COUNT"), F.col("ORD_O_TOTALPRICE_COUNT"))})
    return round_all(out.drop("ORD_O_TOTALPRICE_COUNT"), 6)


@register("a10_distinct", """
SELECT o_custkey,
       count(DISTINCT o_orderpriority) AS ORD_PRIORITY_COUNT,
       count(DISTINCT o_orderstatus) AS ORD_STATUS_COUNT
FROM @ORDERS GROUP BY o_custkey
""", "A10")
def a10_distinct(spark, sf_dir):
    spec = AggSpec(prefix="ORD", distinct=ORDERS_SPEC.distinct)
    return child_aggregate(orders(spark, sf_dir), "o_custkey", spec)


J1_SQL = """
WITH o AS (
  SELECT o_custkey AS c_custkey,
         avg(o_totalprice) AS ORD_O_TOTALPRICE_MEAN, CAST(sum(o_totalprice) AS BIGINT) AS ORD_O_TOTALPRICE_SUM,
         count(o_totalprice) AS ORD_O_TOTALPRICE_COUNT,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS ORD_FILLED_COUNT,
         count(DISTINCT o_orderpriority) AS ORD_PRIORITY_COUNT
  FROM @ORDERS GROUP BY o_custkey),
e AS (
  SELECT user_id AS c_custkey, avg(value) AS EVT_VALUE_MEAN, max(value) AS EVT_VALUE_MAX,
         CAST(sum(value) AS BIGINT) AS EVT_VALUE_SUM, count(event_id) AS EVT_EVENT_ID_COUNT,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS EVT_PURCHASE_COUNT,
         count(DISTINCT event_type) AS EVT_TYPE_COUNT
  FROM @EVENTS GROUP BY user_id)
SELECT c.c_custkey, CAST(c.c_acctbal < 0 AS INTEGER) AS target,
       round(coalesce(o.ORD_O_TOTALPRICE_MEAN, 0), 4) AS ORD_O_TOTALPRICE_MEAN,
       round(coalesce(o.ORD_O_TOTALPRICE_SUM, 0), 4) AS ORD_O_TOTALPRICE_SUM,
       coalesce(o.ORD_O_TOTALPRICE_COUNT, 0) AS ORD_O_TOTALPRICE_COUNT,
       coalesce(o.ORD_FILLED_COUNT, 0) AS ORD_FILLED_COUNT,
       coalesce(o.ORD_PRIORITY_COUNT, 0) AS ORD_PRIORITY_COUNT,
       round(coalesce(o.ORD_FILLED_COUNT::DOUBLE / nullif(o.ORD_O_TOTALPRICE_COUNT, 0), 0), 6) AS ORD_FILLED_RATE,
       round(coalesce(e.EVT_VALUE_MEAN, 0), 4) AS EVT_VALUE_MEAN,
       round(coalesce(e.EVT_VALUE_MAX, 0), 4) AS EVT_VALUE_MAX,
       round(coalesce(e.EVT_VALUE_SUM, 0), 4) AS EVT_VALUE_SUM,
       coalesce(e.EVT_EVENT_ID_COUNT, 0) AS EVT_EVENT_ID_COUNT,
       coalesce(e.EVT_PURCHASE_COUNT, 0) AS EVT_PURCHASE_COUNT,
       coalesce(e.EVT_TYPE_COUNT, 0) AS EVT_TYPE_COUNT,
       CAST(round(c.c_acctbal * 100) AS BIGINT) / nullif(o.ORD_O_TOTALPRICE_SUM, 0) AS ACCTBAL_TO_ORDERS
FROM customer c LEFT JOIN o ON c.c_custkey = o.c_custkey LEFT JOIN e ON c.c_custkey = e.c_custkey
"""


def applicant_history(spark, sf_dir):
    """Minimum slice: base + two child aggregates, ratio, zero fill."""
    base = applicants(spark, sf_dir).select("c_custkey", "target", "c_acctbal")
    o_spec = AggSpec(prefix="ORD", measures={"o_totalprice": ["mean", "sum", "count"]},
                     counts_if={"ORD_FILLED_COUNT": ("o_orderstatus", "F")},
                     distinct={"ORD_PRIORITY_COUNT": "o_orderpriority"})
    o = child_aggregate(orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"),
                        "c_custkey", o_spec, post={
                            "ORD_FILLED_RATE": safe_div(F.col("ORD_FILLED_COUNT"),
                                                        F.col("ORD_O_TOTALPRICE_COUNT"))})
    e = child_aggregate(events(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"),
                        "c_custkey", EVENTS_SPEC)
    hist = [c for c in o.columns + e.columns if c != "c_custkey"]
    out = attach(base, "c_custkey", o, e, fill_zero=hist)
    # F1 ratio; both sides in cents, so the quotient is exact
    out = out.withColumn("ACCTBAL_TO_ORDERS", safe_div(cents("c_acctbal"), F.col("ORD_O_TOTALPRICE_SUM")))
    return out.drop("c_acctbal")


@register("j1_left_join", J1_SQL, "J1, A1, A9, A10, I1, F1, F11")
def j1_left_join(spark, sf_dir):
    out = applicant_history(spark, sf_dir)
    rounded = round_all(out, 4, skip=("ORD_FILLED_RATE", "ACCTBAL_TO_ORDERS"))
    return round_all(rounded, 6, skip=("ACCTBAL_TO_ORDERS",))


@register("j2_two_hop", """
WITH per_order AS (
  SELECT l_orderkey, sum(l_quantity) AS s, count(l_quantity) AS n, max(l_quantity) AS mx,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r
  FROM lineitem GROUP BY l_orderkey)
SELECT o.o_custkey,
       round(sum(p.s) / sum(p.n)::DOUBLE, 6) AS LI_L_QUANTITY_MEAN,
       max(p.mx) AS LI_L_QUANTITY_MAX,
       CAST(sum(p.r) AS BIGINT) AS LI_RETURNED_COUNT
FROM per_order p JOIN orders o ON p.l_orderkey = o.o_orderkey
GROUP BY o.o_custkey
""", "J2, A8")
def j2_two_hop(spark, sf_dir):
    out = two_hop_aggregate(
        table(spark, sf_dir, "lineitem"), orders(spark, sf_dir),
        grandchild_key="l_orderkey", child_key="o_orderkey", parent_key="o_custkey",
        measures={"l_quantity": ["mean", "max"]},
        counts_if={"LI_RETURNED_COUNT": ("l_returnflag", "R")}, prefix="LI")
    return round_all(out, 6)


@register("f10_payment_rows", """
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey,
       @PAID - @DUE AS PAYMENT_DIFF,
       round(@PAID / nullif(@DUE, 0), 6) AS PAYMENT_RATIO,
       CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS DOUBLE) AS DAYS_DIFF,
       CASE WHEN date_diff('day', o.o_orderdate, l.l_shipdate) > 0 THEN 1 ELSE 0 END AS LATE_PAYMENT,
       CAST(greatest(date_diff('day', o.o_orderdate, l.l_shipdate), 0) AS DOUBLE) AS DAYS_PAST_DUE
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""", "F10")
def f10_payment_rows(spark, sf_dir):
    rows = payment_rows(installments(spark, sf_dir), due="amt_instalment", paid="amt_payment",
                        days_diff="days_diff")
    return round_all(rows.select("l_orderkey", "l_linenumber", "o_custkey", "PAYMENT_DIFF",
                                 "PAYMENT_RATIO", "DAYS_DIFF", "LATE_PAYMENT", "DAYS_PAST_DUE"), 6)


@register("a5_installments", """
WITH r AS (
  SELECT o.o_custkey, @DUE AS due, @PAID AS paid,
         CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS DOUBLE) AS dd
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT o_custkey,
       round(avg(due), 6) AS INST_AMT_INSTALMENT_MEAN, CAST(sum(due) AS BIGINT) AS INST_AMT_INSTALMENT_SUM,
       max(due) AS INST_AMT_INSTALMENT_MAX,
       round(avg(paid - due), 6) AS INST_PAYMENT_DIFF_MEAN, CAST(sum(paid - due) AS BIGINT) AS INST_PAYMENT_DIFF_SUM,
       round(avg(paid / nullif(due, 0)), 6) AS INST_PAYMENT_RATIO_MEAN,
       round(min(paid / nullif(due, 0)), 6) AS INST_PAYMENT_RATIO_MIN,
       round(avg(dd), 6) AS INST_DAYS_DIFF_MEAN, max(dd) AS INST_DAYS_DIFF_MAX,
       CAST(sum(CASE WHEN dd > 0 THEN 1 ELSE 0 END) AS BIGINT) AS INST_LATE_PAYMENT_SUM,
       round(avg(CASE WHEN dd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS INST_LATE_PAYMENT_MEAN
FROM r GROUP BY o_custkey
""", "A5, F10")
def a5_installments(spark, sf_dir):
    out = installment_aggregate(installments(spark, sf_dir), key="o_custkey", due="amt_instalment",
                                paid="amt_payment", days_diff="days_diff")
    return round_all(out, 6)


@register("a6_past_due", """
WITH r AS (
  SELECT o.o_custkey, @DUE AS due, @PAID AS paid,
         CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS DOUBLE) AS dd
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT o_custkey,
       round(avg(greatest(dd, 0)), 6) AS PAST_DUE_DAYS_PAST_DUE_MEAN,
       max(greatest(dd, 0)) AS PAST_DUE_DAYS_PAST_DUE_MAX,
       sum(greatest(dd, 0)) AS PAST_DUE_DAYS_PAST_DUE_SUM,
       CAST(sum(CASE WHEN dd > 0 THEN 1 ELSE 0 END) AS BIGINT) AS PAST_DUE_LATE_PAYMENT_SUM,
       round(avg(CASE WHEN dd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS PAST_DUE_LATE_PAYMENT_MEAN,
       round(avg(paid / nullif(due, 0)), 6) AS PAST_DUE_PAYMENT_RATIO_MEAN,
       round(stddev_samp(paid / nullif(due, 0)), 6) AS PAST_DUE_PAYMENT_RATIO_STD,
       round(min(paid / nullif(due, 0)), 6) AS PAST_DUE_PAYMENT_RATIO_MIN,
       round(sum(greatest(dd, 0)) / (sum(CASE WHEN dd > 0 THEN 1 ELSE 0 END) + 1)::DOUBLE, 6) AS PAST_DUE_SEVERITY
FROM r GROUP BY o_custkey
""", "A6, F10, F11")
def a6_past_due(spark, sf_dir):
    out = past_due_aggregate(installments(spark, sf_dir), key="o_custkey", due="amt_instalment",
                             paid="amt_payment", days_diff="days_diff", std="samp", severity="per_late")
    return round_all(out, 6)


SEQ_SQL = """
WITH r AS (
  SELECT o_custkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS filled,
         CAST(date_diff('day', DATE '1990-01-01', o_orderdate) AS DOUBLE) AS day_no,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn_desc,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS LAST, o_orderkey ASC) AS rn_asc
  FROM @ORDERS)
SELECT o_custkey, {cols}
FROM r GROUP BY o_custkey
"""


def _orders_seq(spark, sf_dir):
    return orders(spark, sf_dir).select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("filled"),
        F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double").alias("day_no"))


@register("w2_first_last_n", SEQ_SQL.format(cols="""
       round(avg(CASE WHEN rn_desc <= 3 THEN o_totalprice END), 4) AS LAST3_O_TOTALPRICE,
       round(avg(CASE WHEN rn_desc <= 3 THEN day_no END), 6) AS LAST3_DAY_NO,
       round(avg(CASE WHEN rn_desc <= 5 THEN o_totalprice END), 4) AS LAST5_O_TOTALPRICE,
       round(avg(CASE WHEN rn_desc <= 10 THEN o_totalprice END), 4) AS LAST10_O_TOTALPRICE,
       round(avg(CASE WHEN rn_asc <= 2 THEN o_totalprice END), 4) AS FIRST2_O_TOTALPRICE,
       round(avg(CASE WHEN rn_asc <= 2 THEN day_no END), 6) AS FIRST2_DAY_NO,
       round(avg(CASE WHEN rn_asc <= 4 THEN o_totalprice END), 4) AS FIRST4_O_TOTALPRICE"""),
    "W1, W2, O1")
def w2_first_last_n(spark, sf_dir):
    out = first_last_means(_orders_seq(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey",
                           last={3: ["o_totalprice", "day_no"], 5: ["o_totalprice"], 10: ["o_totalprice"]},
                           first={2: ["o_totalprice", "day_no"], 4: ["o_totalprice"]})
    days = [c for c in out.columns if c.endswith("DAY_NO")]
    return round_all(round_all(out, 4, skip=days + ["o_custkey"]), 6)


@register("w3_rate_last_n", SEQ_SQL.format(cols="""
       round(avg(CASE WHEN rn_desc <= 3 THEN filled END), 6) AS LAST3_FILLED,
       round(avg(CASE WHEN rn_desc <= 5 THEN filled END), 6) AS LAST5_FILLED,
       round(avg(CASE WHEN rn_desc <= 10 THEN filled END), 6) AS LAST10_FILLED"""),
    "W3")
def w3_rate_last_n(spark, sf_dir):
    out = first_last_means(_orders_seq(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey",
                           last={3: ["filled"], 5: ["filled"], 10: ["filled"]})
    return round_all(out, 6)
