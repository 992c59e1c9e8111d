"""Loading, cleaning, text and selection over the supplied tables (S1-S4, S7-S9,
S11, P2, P7-P10, P12, P16, P17, X5-X7, X9-X12, A12, A28, O3, O9, K2-K4)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as ex
from ..operators import analysis as an
from ..operators import clean, ml, profile
from ..operators.impute import numeric_columns
from ..session import scratch_path
from ..sources import io
from ..sources.tables import cents, table
from .registry import register

ORDER_CSV = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                          T.StructField("total", T.LongType()), T.StructField("priority", T.StringType())])


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", cents("o_totalprice").alias("total"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))


@register("s1_csv_round_trip", """
SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total,
       nullif(o_orderpriority, '5-LOW') AS priority FROM orders
""", "S1, S3, S7 (typed load of an export; empty text is null)")
def s1_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    io.write_csv(_orders(spark, sf_dir), path)
    return io.read_csv(spark, path, ORDER_CSV)


@register("s2_ragged_csv", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total,
       CASE WHEN o_orderkey % 4 = 0 THEN nullif(o_orderpriority, '5-LOW') END AS priority FROM orders
""", "S2 (short rows get trailing nulls)")
def s2_ragged_csv(spark, sf_dir):
    path = scratch_path(spark, "orders-ragged")
    o = _orders(spark, sf_dir)
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat_ws(",", "o_orderkey", "o_custkey", "total", F.coalesce("priority", F.lit("")))) \
        .when(F.col("o_orderkey") % 2 == 0, F.concat_ws(",", "o_orderkey", "o_custkey", "total")) \
        .otherwise(F.concat_ws(",", "o_orderkey", "o_custkey"))
    o.select(text.alias("value")).write.text(path)
    return io.read_csv(spark, path, ORDER_CSV, header=False)


@register("s4_overwrite", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'",
          "S4, S6 (the second load replaces the first)")
def s4_overwrite(spark, sf_dir):
    path = scratch_path(spark, "orders-overwritten")
    o = table(spark, sf_dir, "orders")
    io.write_parquet(o.select("o_orderkey", "o_custkey"), path)
    io.write_parquet(o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey"), path)
    return io.read_parquet(spark, path)


MESSY = ("CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 5 = 1 THEN 'n/a' "
         "ELSE CAST(l_orderkey % 1000 AS {t}) END")


@register("s8_text_to_double", f"""
SELECT l_orderkey, l_linenumber, try_cast(nullif({MESSY.format(t="VARCHAR")}, '') AS DOUBLE) AS amount,
       try_cast({MESSY.format(t="VARCHAR")} AS DOUBLE) AS loose FROM lineitem
""", "S8, S9")
def s8_text_to_double(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(MESSY.format(t="STRING")).alias("amount"))
    li = li.withColumn("loose", io.to_double("amount"))
    return io.text_columns_to_double(li, columns=["amount"])


@register("s11_ad_hoc_sql", """
SELECT c_nationkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
""", "S11")
def s11_ad_hoc_sql(spark, sf_dir):
    names = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    return io.run_sql(spark, names, """SELECT c_nationkey, count(*) AS n,
        sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")


@register("s12_result_summary", """
SELECT count(*) AS row_count, 6::BIGINT AS column_count,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns, 5::BIGINT AS n_preview
FROM orders
""", "S12, S13")
def s12_result_summary(spark, sf_dir):
    found = io.result_summary(table(spark, sf_dir, "orders"))
    names = ",".join(io.feature_name_list(table(spark, sf_dir, "orders")))
    row = (found["row_count"], found["column_count"], names, len(found["preview"]))
    return spark.createDataFrame([row], "row_count long, column_count long, columns string, n_preview long")


# --- cleaning ---------------------------------------------------------------
@register("p2_age", "SELECT c_custkey, round((7300 + c_custkey % 18000) / 365.0::DOUBLE, 6) AS AGE_YEARS FROM customer", "P2")
def p2_age(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("-(7300 + c_custkey % 18000)").alias("DAYS_BIRTH"))
    return ex.round_all(clean.add_age_years(c).drop("DAYS_BIRTH"), 6)


def _nonfinite(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(
        "CASE WHEN event_id % 11 = 0 THEN double('Infinity') WHEN event_id % 13 = 0 THEN double('-Infinity') "
        "WHEN event_id % 17 = 0 THEN double('NaN') WHEN event_id % 19 = 0 THEN NULL ELSE double(event_id) END").alias("x"))


@register("p7_finite", """
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL
                      ELSE event_id::DOUBLE END AS x FROM events
""", "P7")
def p7_finite(spark, sf_dir):
    return clean.infinities_to_null(_nonfinite(spark, sf_dir), ["x"])


@register("p8_nonfinite_counts", """
SELECT count(*) FILTER (WHERE event_id % 11 = 0 OR event_id % 13 = 0) AS n_inf,
       count(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 = 0) AS n_nan,
       count(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 = 0) AS n_null
FROM events
""", "P8")
def p8_nonfinite_counts(spark, sf_dir):
    return clean.count_nonfinite(_nonfinite(spark, sf_dir), ["x"])


@register("p9_p10_drop_columns", "SELECT o_orderkey, o_custkey, o_orderkey % 3 AS some, NULL::INTEGER AS never FROM orders",
          "P9, P10 (a column that is mostly null goes, and one with a single value)")
def p9_p10_drop_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 1 END").alias("rare"),
        F.expr("o_orderkey % 3").alias("some"), F.lit(7).alias("same"))
    kept, _ = clean.drop_missing_columns(o, 0.5, protect=("o_orderkey",))
    kept, _ = clean.drop_constant_columns(kept.withColumn("never", F.lit(None).cast("int")), protect=("o_orderkey",))
    return kept


@register("p12_numeric_columns", "SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS p_retailprice FROM part", "P12")
def p12_numeric_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_retailprice", cents("p_retailprice"))
    return p.select(*numeric_columns(p))


@register("p16_profile", """
SELECT c_custkey, -(c_custkey % 18000 + 7300) AS DAYS_BIRTH,
       CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -(c_custkey % 9000) END AS DAYS_EMPLOYED,
       CAST(floor((c_custkey % 18000 + 7300) / 365.0) AS BIGINT) AS age_years,
       CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE CAST(floor((c_custkey % 9000) / 365.0) AS BIGINT) END AS employment_years
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
""", "P16")
def p16_profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("-(c_custkey % 18000 + 7300)").alias("DAYS_BIRTH"),
        F.expr("CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -(c_custkey % 9000) END").alias("DAYS_EMPLOYED"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return an.applicant_profile(c, "c_custkey", ids, fields=["DAYS_BIRTH", "DAYS_EMPLOYED"])


@register("p17_range", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity IS NOT NULL AND l_quantity BETWEEN 10 AND 30
""", "P17")
def p17_range(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return an.valid_range(li, "l_quantity", 10, 30)


@register("a12_counts_with_nulls", """
WITH t AS (SELECT nullif(o_orderpriority, '1-URGENT') AS p FROM orders)
SELECT p, count(*) AS count, round(count(*) / (SELECT count(p) FROM t)::DOUBLE, 6) AS share FROM t WHERE p IS NOT NULL GROUP BY p
""", "A12 (nulls in neither counts nor shares)")
def a12_counts_with_nulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderpriority, '1-URGENT')").alias("p"))
    return ex.round_all(profile.value_counts(o, "p"), 6)


# --- labels and formats -------------------------------------------------------
@register("x5_x12_labels", """
WITH t AS (SELECT c_custkey, (c_custkey % 2001 - 1000) / 500.0::DOUBLE AS z, (c_custkey % 401 - 200) / 200.0::DOUBLE AS r,
                  (c_custkey % 61 - 30) / 200.0::DOUBLE AS impact, c_custkey % 23::DOUBLE AS mean,
                  c_custkey % 7 AS kind FROM customer)
SELECT c_custkey, round(1 / (1 + exp(-z)), 6) AS p, round(1 / (1 + exp(-(z + r))) - 1 / (1 + exp(-z)), 6) AS delta,
       CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN abs(impact) * 100 > 10 THEN 'strong' WHEN abs(impact) * 100 > 5 THEN 'moderate' ELSE 'slight' END AS impact,
       CASE WHEN impact > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS impact_direction,
       CASE WHEN mean > 10 * 1.1::DOUBLE THEN 'right-skewed' WHEN mean < 10 * 0.9::DOUBLE THEN 'left-skewed'
            ELSE 'approximately symmetric' END AS skew,
       CASE kind WHEN 0 THEN 'Ext Source 1' WHEN 1 THEN 'Bureau Amt' WHEN 2 THEN 'Prev Credit' WHEN 3 THEN 'Amt Credit'
                 WHEN 4 THEN 'Days Birth' WHEN 5 THEN 'Cnt Children' ELSE 'Own Car Age' END AS name,
       CASE kind WHEN 0 THEN 'External Sources' WHEN 1 THEN 'Bureau' WHEN 2 THEN 'Previous Applications' WHEN 3 THEN 'Credit'
                 WHEN 4 THEN 'Days/Time' WHEN 5 THEN 'Counts/Flags' ELSE 'Other' END AS category
FROM t
""", "X5, X6, X9, X10, X11, X12")
def x5_x12_labels(spark, sf_dir):
    names = ["EXT_SOURCE_1", "BUREAU_AMT", "PREV_CREDIT", "AMT_CREDIT", "DAYS_BIRTH", "CNT_CHILDREN", "OWN_CAR_AGE"]
    t = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("(c_custkey % 2001 - 1000) / 500D").alias("z"), F.expr("(c_custkey % 401 - 200) / 200D").alias("r"),
        F.expr("(c_custkey % 61 - 30) / 200D").alias("i"), F.expr("double(c_custkey % 23)").alias("mean"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % 7 + 1).cast("int")).alias("n"))
    return t.select("c_custkey", F.round(ex.logistic("z"), 6).alias("p"), F.round(ex.prob_delta("z", "r"), 6).alias("delta"),
                    ex.corr_strength("r").alias("strength"), ex.corr_direction("r").alias("direction"),
                    ex.impact_strength("i").alias("impact"), ex.impact_direction("i").alias("impact_direction"),
                    ex.skew_label("mean", F.lit(10.0)).alias("skew"), ex.pretty_name(F.lower("n")).alias("name"),
                    ex.feature_category("n").alias("category"))


@register("x7_compact_numbers", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 900)::DOUBLE WHEN 1 THEN (o_orderkey % 900) + 0.25
                  WHEN 2 THEN (o_orderkey % 900) * 1000.0::DOUBLE + 1037 ELSE (o_orderkey % 900) * 1000000.0::DOUBLE + 1037000 END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >= 1e6 THEN format('{:.1f}M', v / 1e6) WHEN v >= 1e3 THEN format('{:.1f}K', v / 1e3)
                        WHEN v = floor(v) THEN format('{:.0f}', v) ELSE format('{:.2f}', v) END AS text
FROM t
""", "X7")
def x7_compact_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN double(o_orderkey % 900) WHEN 1 THEN (o_orderkey % 900) + 0.25D "
        "WHEN 2 THEN (o_orderkey % 900) * 1000D + 1037 ELSE (o_orderkey % 900) * 1000000D + 1037000 END").alias("v"))
    return o.select("o_orderkey", ex.compact_number("v").alias("text"))


# --- importance, sampling, splits -------------------------------------------------
@register("a28_importance", """
WITH f AS (SELECT 'EXT_SOURCE_1' AS feature, sum(l_linenumber)::DOUBLE AS importance FROM lineitem
           UNION ALL SELECT 'EXT_SOURCE_2', sum(l_quantity) FROM lineitem
           UNION ALL SELECT 'AMT_ANNUITY', count(DISTINCT l_suppkey)::DOUBLE FROM lineitem
           UNION ALL SELECT 'DAYS_BIRTH', count(*)::DOUBLE FROM lineitem),
c AS (SELECT CASE WHEN feature LIKE 'EXT_SOURCE%' THEN 'External Sources' WHEN feature LIKE 'AMT_%' THEN 'Amounts' ELSE 'Days/Time' END AS category, importance FROM f)
SELECT category, sum(importance) AS importance, count(*) AS n_features,
       round(sum(importance) * 100.0 / (SELECT sum(importance) FROM f), 6) AS pct FROM c GROUP BY category
""", "A28, X12")
def a28_importance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.agg(F.sum("l_linenumber").cast("double").alias("EXT_SOURCE_1"), F.sum("l_quantity").alias("EXT_SOURCE_2"),
               F.count_distinct("l_suppkey").cast("double").alias("AMT_ANNUITY"),
               F.count(F.lit(1)).cast("double").alias("DAYS_BIRTH")).unpivot(
        [], ["EXT_SOURCE_1", "EXT_SOURCE_2", "AMT_ANNUITY", "DAYS_BIRTH"], "feature", "importance")
    return an.importance_by_category(f).withColumn("pct", F.round("pct", 6))


@register("a28_prefixes", """
SELECT prefix, count(*) AS n_features FROM (SELECT split_part(o_orderpriority || '_' || o_orderkey, '_', 1) AS prefix FROM orders) GROUP BY prefix
""", "A28 (names by prefix)")
def a28_prefixes(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.concat_ws("_", "o_orderpriority", "o_orderkey").alias("feature"))
    return an.count_by_prefix(names)


WIDE = [f"f{i}" for i in range(18)]


@register("o9_analysis", "WITH t AS (SELECT " + ", ".join(f"(c_custkey % {i + 3})::DOUBLE AS f{i}" for i in range(18)) +
          " FROM customer), u AS (UNPIVOT t ON " + ", ".join(WIDE) + """ INTO NAME feature VALUE v)
SELECT feature, count(*) AS count, round(avg(v), 6) AS mean, min(v) AS min, median(v) AS median, max(v) AS max FROM u GROUP BY feature
""", "O9, A14 (eighteen features)")
def o9_analysis(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(*[F.expr(f"double(c_custkey % {i + 3})").alias(f"f{i}") for i in range(18)])
    stats = an.analyze("distribution", t, WIDE)["statistics"]
    return ex.round_all(stats.select("feature", "count", "mean", "min", "median", "max"), 6)


def _labelled_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(
        "CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END").alias("target"))


_LABELLED = "SELECT CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS target FROM customer"


@register("k2_split_sizes", f"""
WITH n AS (SELECT target, count(*) AS n FROM ({_LABELLED}) GROUP BY target),
s AS (SELECT target, 0 AS split, round(n * 0.6::DOUBLE) AS size FROM n
      UNION ALL SELECT target, 1, round(n * (0.6::DOUBLE + 0.2::DOUBLE)) - round(n * 0.6::DOUBLE) FROM n
      UNION ALL SELECT target, 2, n - round(n * (0.6::DOUBLE + 0.2::DOUBLE)) FROM n)
SELECT target, split, size::BIGINT AS size FROM s WHERE size > 0
""", "K2 (sizes by label; null is a label)")
def k2_split_sizes(spark, sf_dir):
    out = ml.stratified_split(_labelled_customers(spark, sf_dir), "c_custkey", "target", (0.6, 0.2, 0.2), seed=42)
    return out.groupBy("target", "split").agg(F.count(F.lit(1)).alias("size"))


@register("k3_fold_sizes", f"""
WITH n AS (SELECT target, count(*) AS n FROM ({_LABELLED}) GROUP BY target)
SELECT target, fold::INTEGER AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS size
FROM n, range(5) r(fold) WHERE n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END > 0
""", "K3 (sizes by label)")
def k3_fold_sizes(spark, sf_dir):
    out = ml.stratified_folds(_labelled_customers(spark, sf_dir), "c_custkey", "target", 5, seed=42)
    return out.groupBy("target", "fold").agg(F.count(F.lit(1)).alias("size"))


@register("k4_smote_sizes", """
WITH n AS (SELECT CAST(c_acctbal < 0 AS INTEGER) AS target, count(*) AS n FROM customer GROUP BY 1)
SELECT target, CASE WHEN target = 1 THEN greatest(n, (SELECT n FROM n WHERE target = 0)) ELSE n END AS size FROM n
""", "K4 (rows per class after balancing)")
def k4_smote_sizes(spark, sf_dir):
    from .neighbours import k4_smote
    return k4_smote(spark, sf_dir).groupBy("target").agg(F.count(F.lit(1)).alias("size"))


@register("o3_sample_members", """
SELECT least(200, count(*)) AS n, least(200, count(*)) AS n_ids, least(200, count(*)) AS n_known FROM customer
""", "O3 (size, distinct ids, ids that exist)")
def o3_sample_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    s = an.repeatable_sample(c, "c_custkey", 200).join(c.withColumn("known", F.lit(1)), "c_custkey", "left")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("n_ids"),
                 F.sum("known").alias("n_known"))


# --- service features ---------------------------------------------------------
@register("d1_publish", """
SELECT user_id AS k, event_id, CAST(event_id % 97 AS DOUBLE) AS x, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
""", "D1, D2, D3 (published rows, projected to the service's features)")
def d1_publish(spark, sf_dir):
    import datetime as dt

    from ..operators.store import Entity, FeatureService, FeatureView, publish, read_published
    view = FeatureView("rows", Entity("k", ("k",)), T.StructType([T.StructField("event_id", T.LongType()),
                                                                 T.StructField("x", T.DoubleType())]), ts="ts",
                       ttl=dt.timedelta(days=36500))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), "event_id", F.expr("event_id % 97").alias("x"), "ts", F.lit("extra").alias("unused"))
    path = scratch_path(spark, "published")
    publish(rows.limit(1), view, path)
    publish(rows, view, path)
    service = FeatureService("all", (view,))
    return read_published(spark, path).select("k", *service.feature_names(), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
