"""The supplied test tables and the roles they play for the credit operators.

Roles (see FIXTURES.md): ``customer`` is the applicant (label ``c_acctbal < 0``),
``orders`` the bureau / previous-application history, ``lineitem`` the second
hop and the instalment payments, ``events`` the monthly history and the
feature-store rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(col: str):
    """Money in integer cents: sums are exact, so means do not depend on the
    order rows are added in (which differs between engines and partitionings)."""
    return F.round(F.col(col) * 100).cast("long")


# DuckDB twins of the bindings below, for the oracle SQL.
DUE_C = "CAST(round(l.l_extendedprice * 100) AS BIGINT)"
PAID_C = "CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)"
ORDERS_C = "(SELECT * REPLACE (CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice) FROM orders)"
EVENTS_C = "(SELECT * REPLACE (CAST(round(value * 100) AS BIGINT) AS value) FROM events)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with ``o_totalprice`` in cents."""
    return table(spark, sf_dir, "orders").withColumn("o_totalprice", cents("o_totalprice"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``value`` in cents."""
    return table(spark, sf_dir, "events").withColumn("value", cents("value"))


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as the applicant table with a 0/1 label."""
    return table(spark, sf_dir, "customer").withColumn(
        "target", (F.col("c_acctbal") < 0).cast("int"))


def installments(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """lineitem joined to its order: one instalment row per line.

    due = extended price, paid = price after discount (both in integer cents,
    the payment rounded to the cent), days between ship and order date stand
    for payment minus due day.  The join is on the order key
    on both sides, so it is a plain shuffle join at scale (orders is a fact
    table, never broadcast blindly).  ``extra`` lineitem columns come along.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate", *extra)
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
            .select(
                F.col("o_custkey"), F.col("l_orderkey"), F.col("l_linenumber"), *extra,
                cents("l_extendedprice").alias("amt_instalment"),
                F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("amt_payment"),
                F.datediff(F.col("l_shipdate"), F.col("o_orderdate")).cast("double").alias("days_diff")))
