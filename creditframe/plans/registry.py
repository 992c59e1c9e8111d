"""Registry of named queries over the supplied tables.

Each entry pairs a Spark plan ``fn(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL (``None`` where no SQL twin exists: seeded hashes,
models, streaming).  ``__spark_entry__`` exposes both maps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str = ""


REGISTRY: dict[str, Query] = {}


def expand(sql: str | None) -> str | None:
    """Replace binding tokens by their DuckDB twins (money in cents)."""
    if sql is None:
        return None
    from ..sources.tables import DUE_C, EVENTS_C, ORDERS_C, PAID_C
    return (sql.replace("@ORDERS", ORDERS_C).replace("@EVENTS", EVENTS_C)
            .replace("@DUE", DUE_C).replace("@PAID", PAID_C))


def register(name: str, sql: str | None, operators: str = ""):
    sql = expand(sql)

    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco
