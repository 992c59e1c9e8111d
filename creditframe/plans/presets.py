"""The credit presets and derived amounts over the supplied tables (A2-A4, A7,
F4, F5, F8, F9, E2): the tables are renamed to the preset's columns, the
published aggregates run as they are.

Roles: ``orders`` plays the bureau and the previous applications, ``events``
the POS and card months, ``customer`` the applicant.  Amounts are whole cents
and some columns hold nulls.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions.expressions import round_all, safe_div
from ..operators.aggregate import AggSpec, child_aggregate
from ..operators.impute import fill_median, label_encode
from ..sources.tables import table
from .credit_features import FeatureOptions, _advanced
from .registry import register

KEY = "SK_ID_CURR"
_SQL = {"mean": "round(avg({c}), 6)", "sum": "sum({c})", "min": "min({c})", "max": "max({c})", "count": "count({c})"}


def spec_sql(spec: AggSpec, rows: str, post: str = "") -> str:
    """The same outputs in SQL, by the naming rule of the published view."""
    out = [f"{_SQL[f].format(c=c)} AS {spec.name(c, f)}" for c, fs in spec.measures.items() for f in fs]
    out += [f"CAST(count(*) FILTER (WHERE {c} = '{v}') AS BIGINT) AS {n}" for n, (c, v) in spec.counts_if.items()]
    out += [f"count(DISTINCT {c}) AS {n}" for n, c in spec.distinct.items()]
    inner = f"SELECT {KEY}, {', '.join(out)} FROM ({rows}) GROUP BY {KEY}"
    return f"SELECT *, {post} FROM ({inner})" if post else inner


# columns of each role as SQL expressions that both engines read alike
BUREAU = {
    KEY: "o_custkey", "DAYS_CREDIT": "CAST(-(o_orderkey % 3000) AS DOUBLE)",
    "CREDIT_DAY_OVERDUE": "CAST(o_orderkey % 17 AS DOUBLE)",
    "DAYS_CREDIT_ENDDATE": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 900 AS DOUBLE) END",
    "AMT_CREDIT_MAX_OVERDUE": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4000 AS DOUBLE) END",
    "AMT_CREDIT_SUM": "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE)",
    "AMT_CREDIT_SUM_DEBT": "CASE WHEN o_orderkey % 4 <> 1 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100000 AS DOUBLE) END",
    "AMT_CREDIT_SUM_LIMIT": "CAST(o_orderkey % 70000 AS DOUBLE)", "AMT_CREDIT_SUM_OVERDUE": "CAST(o_orderkey % 13 AS DOUBLE)",
    "SK_ID_BUREAU": "o_orderkey", "CREDIT_ACTIVE": "CASE WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Closed' END",
    "CREDIT_TYPE": "nullif(o_orderpriority, '5-LOW')",
}
PREVIOUS = {
    KEY: "o_custkey", "AMT_ANNUITY": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 50000 AS DOUBLE) END",
    "AMT_APPLICATION": "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE)",
    "AMT_DOWN_PAYMENT": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9000 AS DOUBLE) END",
    "AMT_GOODS_PRICE": "CAST(o_orderkey % 80000 AS DOUBLE)", "HOUR_APPR_PROCESS_START": "CAST(o_orderkey % 24 AS DOUBLE)",
    "RATE_DOWN_PAYMENT": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END",
    "DAYS_DECISION": "CAST(-(o_orderkey % 2900) AS DOUBLE)", "CNT_PAYMENT": "CAST(o_orderkey % 60 AS DOUBLE)",
    "SK_ID_PREV": "o_orderkey", "NAME_CONTRACT_STATUS": "CASE WHEN o_orderstatus = 'F' THEN 'Approved' ELSE 'Refused' END",
    "NAME_CONTRACT_TYPE": "o_orderpriority",
}
POS = {
    KEY: "user_id", "MONTHS_BALANCE": "CAST(-(event_id % 96) AS DOUBLE)",
    "CNT_INSTALMENT": "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 48 AS DOUBLE) END",
    "SK_DPD": "CAST(event_id % 11 AS DOUBLE)", "SK_DPD_DEF": "CAST(event_id % 3 AS DOUBLE)",
}
CARD = {
    KEY: "user_id", "AMT_BALANCE": "CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE)",
    "AMT_CREDIT_LIMIT_ACTUAL": "CAST(event_id % 450000 AS DOUBLE)",
    "AMT_DRAWINGS_ATM_CURRENT": "CASE WHEN event_id % 9 <> 4 THEN CAST(event_id % 1200 AS DOUBLE) END",
    "AMT_DRAWINGS_CURRENT": "CAST(event_id % 3100 AS DOUBLE)", "AMT_PAYMENT_CURRENT": "CAST(event_id % 700 AS DOUBLE)",
    "CNT_DRAWINGS_ATM_CURRENT": "CAST(event_id % 5 AS DOUBLE)", "SK_DPD": "CAST(event_id % 11 AS DOUBLE)",
    "SK_DPD_DEF": "CAST(event_id % 2 AS DOUBLE)",
}


def _rows_sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


def _rows(spark, sf_dir, columns: dict[str, str], source: str):
    return table(spark, sf_dir, source).select(*[F.expr(e).alias(n) for n, e in columns.items()])


@register("a2_bureau", spec_sql(presets.BUREAU, _rows_sql(BUREAU, "orders"), """
    round(BUREAU_AMT_CREDIT_SUM_DEBT_SUM / (BUREAU_AMT_CREDIT_SUM_SUM + 1), 6) AS BUREAU_DEBT_CREDIT_RATIO"""), "A2, A1, A9, A10, F11")
def a2_bureau(spark, sf_dir):
    return round_all(child_aggregate(_rows(spark, sf_dir, BUREAU, "orders"), KEY, presets.BUREAU, post={
        "BUREAU_DEBT_CREDIT_RATIO": F.try_divide(F.col("BUREAU_AMT_CREDIT_SUM_DEBT_SUM"),
                                                 F.col("BUREAU_AMT_CREDIT_SUM_SUM") + 1)}))


@register("a3_previous", spec_sql(presets.PREVIOUS, _rows_sql(PREVIOUS, "orders"), """
    round(PREV_APPROVED_COUNT::DOUBLE / PREV_SK_ID_PREV_COUNT, 6) AS PREV_APPROVAL_RATE"""), "A3, A1, A9, A10, F11")
def a3_previous(spark, sf_dir):
    return round_all(child_aggregate(_rows(spark, sf_dir, PREVIOUS, "orders"), KEY, presets.PREVIOUS, post={
        "PREV_APPROVAL_RATE": safe_div("PREV_APPROVED_COUNT", "PREV_SK_ID_PREV_COUNT")}))


@register("a4_pos", spec_sql(presets.POS, _rows_sql(POS, "events")), "A4, A1")
def a4_pos(spark, sf_dir):
    return round_all(child_aggregate(_rows(spark, sf_dir, POS, "events"), KEY, presets.POS))


@register("a7_card", spec_sql(presets.CREDIT_CARD, _rows_sql(CARD, "events"), """
    round(CC_AMT_BALANCE_MEAN / nullif(CC_AMT_CREDIT_LIMIT_ACTUAL_MEAN, 0), 4) AS CC_UTILIZATION_RATIO"""), "A7, A1, F11")
def a7_card(spark, sf_dir):
    out = round_all(child_aggregate(_rows(spark, sf_dir, CARD, "events"), KEY, presets.CREDIT_CARD))
    return out.withColumn("CC_UTILIZATION_RATIO", F.round(safe_div("CC_AMT_BALANCE_MEAN", "CC_AMT_CREDIT_LIMIT_ACTUAL_MEAN"), 4))


@register("a10_distinct_with_null", f"""
SELECT {KEY}, count(DISTINCT CREDIT_TYPE) + max(CASE WHEN CREDIT_TYPE IS NULL THEN 1 ELSE 0 END) AS BUREAU_CREDIT_TYPE_COUNT
FROM ({_rows_sql(BUREAU, "orders")}) GROUP BY {KEY}
""", "A10 (null is one more value)")
def a10_distinct_with_null(spark, sf_dir):
    spec = AggSpec(prefix="BUREAU", distinct={"BUREAU_CREDIT_TYPE_COUNT": "CREDIT_TYPE"}, distinct_counts_null=True)
    return child_aggregate(_rows(spark, sf_dir, BUREAU, "orders"), KEY, spec)


# --- derived amounts of the applicant --------------------------------------
APPLICANT = {
    "c_custkey": "c_custkey", "AMT_CREDIT": "CAST(100000 + c_custkey * 37 % 900000 AS DOUBLE)",
    "AMT_ANNUITY": "CASE WHEN c_custkey % 19 <> 0 THEN CAST(5000 + c_custkey * 13 % 60000 AS DOUBLE) END",
    "AMT_INCOME_TOTAL": "CAST(30000 + c_custkey * 71 % 300000 AS DOUBLE)",
    "AMT_GOODS_PRICE": "CASE WHEN c_custkey % 23 <> 0 THEN CAST(90000 + c_custkey * 41 % 800000 AS DOUBLE) END",
    "EXT_SOURCE_3": "CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 89 AS DOUBLE) / 89 END",
    "DAYS_EMPLOYED": "CASE WHEN c_custkey % 6 <> 0 THEN CAST(-(c_custkey % 12000) AS DOUBLE) END",
    "DAYS_BIRTH": "CAST(-(7300 + c_custkey % 18000) AS DOUBLE)",
    "PREV_CNT_PAYMENT_MEAN": "CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 48 AS DOUBLE) END",
}


@register("f4_f9_amounts", f"""
WITH a AS ({_rows_sql(APPLICANT, "customer")}),
b AS (SELECT *, AMT_ANNUITY * PREV_CNT_PAYMENT_MEAN AS total FROM a),
c AS (SELECT *, total - AMT_CREDIT AS interest, (total - AMT_CREDIT) / (AMT_CREDIT + 1) AS rate FROM b)
SELECT c_custkey, round(AMT_CREDIT / (EXT_SOURCE_3 + 0.00001::DOUBLE), 4) AS AMT_CREDIT_div_EXT_SOURCE_3,
       round(AMT_ANNUITY / (EXT_SOURCE_3 + 0.00001::DOUBLE), 4) AS AMT_ANNUITY_div_EXT_SOURCE_3,
       round(AMT_INCOME_TOTAL / (EXT_SOURCE_3 + 0.00001::DOUBLE), 4) AS AMT_INCOME_TOTAL_div_EXT_SOURCE_3,
       round(AMT_GOODS_PRICE / (EXT_SOURCE_3 + 0.00001::DOUBLE), 4) AS AMT_GOODS_PRICE_div_EXT_SOURCE_3,
       round(total, 4) AS ESTIMATED_TOTAL_PAYMENT, round(interest, 4) AS ESTIMATED_INTEREST,
       round(rate, 4) AS ESTIMATED_INTEREST_RATE,
       round(rate / (PREV_CNT_PAYMENT_MEAN / 12 + 0.001::DOUBLE), 4) AS ESTIMATED_YEARLY_RATE,
       round(AMT_CREDIT / (AMT_ANNUITY * 12 + 1), 4) AS CREDIT_ANNUITY_YEARS,
       round(AMT_INCOME_TOTAL / nullif(-DAYS_EMPLOYED / 365 + 1, 0), 4) AS INCOME_PER_YEAR_EMPLOYED,
       round(AMT_GOODS_PRICE - AMT_CREDIT, 4) AS DOWN_PAYMENT_AMT,
       round((AMT_GOODS_PRICE - AMT_CREDIT) / (AMT_GOODS_PRICE + 1), 4) AS DOWN_PAYMENT_RATIO,
       round(DAYS_EMPLOYED / DAYS_BIRTH, 4) AS EMPLOYMENT_AGE_RATIO,
       CAST(trunc(DAYS_BIRTH / -365) AS INTEGER) AS AGE_INT
FROM c
""", "F4, F5, F6, F7, F8, F9")
def f4_f9_amounts(spark, sf_dir):
    a = _rows(spark, sf_dir, APPLICANT, "customer").withColumn("AGE_INT", (F.col("DAYS_BIRTH") / -365).cast("int"))
    out = _advanced(a, FeatureOptions(extended=True))
    return round_all(out.drop(*[c for c in APPLICANT if c != "c_custkey"]), 4)


@register("e2_missing_codes", """
WITH t AS (SELECT o_orderkey, coalesce(nullif(o_orderpriority, '3-MEDIUM'), 'missing') AS p, o_orderstatus AS s FROM orders),
pc AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM t)),
sc AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM t))
SELECT o_orderkey, pc.code::DOUBLE AS priority, sc.code::DOUBLE AS status FROM t JOIN pc USING (p) JOIN sc USING (s)
""", "E2 (null becomes a category)")
def e2_missing_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '3-MEDIUM')").alias("priority"), F.col("o_orderstatus").alias("status"))
    return label_encode(o, ["priority", "status"])


@register("i2_median_of_integers", """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_orderkey % 1000 AS INTEGER) END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(x::DOUBLE, (SELECT median(x) FROM t)::DOUBLE) AS x FROM t
""", "I2 (nulls in an integer column)")
def i2_median_of_integers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_orderkey % 1000 AS INT) END").alias("x"))
    return fill_median(li, ["x"])
