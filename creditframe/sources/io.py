"""Sources and sinks.

Every read carries an explicit schema (no inference pass over the data), and
every write goes through the DataFrame writer so it is split across tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW_TABLES


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, sep: str = ",",
             header: bool = True) -> DataFrame:
    """Typed CSV load; empty string means null.

    S2 (ragged rows): with an explicit schema and PERMISSIVE mode a short row
    gets trailing nulls, which is what the padding step of the source did.
    """
    return (spark.read.schema(schema)
            .option("header", header).option("sep", sep)
            .option("nullValue", "").option("emptyValue", None)
            .option("mode", "PERMISSIVE")
            .csv(path))


def read_raw_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """S1 with the fixed schema of one of the eight raw credit tables."""
    return read_csv(spark, path, RAW_TABLES[table])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Columnar read; pruning and filters reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: Mapping[str, str] | None = None
              ) -> DataFrame:
    """S5 when the data sits in a database: a partitioned, parallel read."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=dict(properties or {}))


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite",
                  partition_by: Iterable[str] | None = None) -> None:
    """Full overwrite (the truncate + load of the source)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """CSV export with header, written by every task in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def text_columns_to_double(df: DataFrame, *, strict: bool = False,
                           columns: Iterable[str] | None = None) -> DataFrame:
    """Every text column becomes double, '' becomes null.

    ``strict=False`` turns unparsable text into null (``try_cast``);
    ``strict=True`` fails the job on it, as the database repair did.
    """
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in targets:
            blank_to_null = F.nullif(F.trim(c), F.lit(""))
            c = blank_to_null.cast("double") if strict else blank_to_null.try_cast("double")
            out.append(c.alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def to_double(col) -> "F.Column":
    """Non-strict numeric cast (bad values become null)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double")


def schema_catalogue(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, ordinal, column, type) for a set of named DataFrames.

    Only schemas are touched, no data; the result is a tiny driver-built frame.
    """
    rows = [(name, i + 1, f.name, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")


def run_sql(spark: SparkSession, tables: Mapping[str, DataFrame], query: str,
            limit: int | None = None) -> DataFrame:
    """Ad-hoc SQL over named frames; every row unless ``limit`` is asked for."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(query)
    return out.limit(limit) if limit is not None else out


def result_summary(df: DataFrame, preview_rows: int = 5) -> dict:
    """Row count, column count, names, first rows (a small dict)."""
    return {
        "row_count": df.count(),
        "column_count": len(df.columns),
        "columns": list(df.columns),
        "preview": [r.asDict() for r in df.limit(preview_rows).collect()],
    }


def feature_name_list(df: DataFrame, exclude: Iterable[str] = ("SK_ID_CURR", "TARGET")) -> list[str]:
    """Ordered feature names (schema only)."""
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def write_name_list(names: Iterable[str], path: str) -> None:
    """One name per line, written by the driver (names only, never data)."""
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(names))
