"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
TOKENIZER_DIR = "/opt/tokenizers"


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text")))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; empty for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a bound lambda variable)."""
    return F.transform(F.array(value), body)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: cuts
    lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str, folder: str = TOKENIZER_DIR) -> str:
    """Path of a public tokenizer file, through its package where installed."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(folder, name)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in used:
        name, k = f"{stem}_{k}", k + 1
    return name


def pyre(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def per_worker(key: tuple, make):
    """``make()``, once per Python worker process; later tasks reuse it."""
    kept = vars(sys.modules.setdefault("creditframe_llm_worker", types.ModuleType("creditframe_llm_worker")))
    if key not in kept.setdefault("objects", {}):
        kept["objects"][key] = make()
    return kept["objects"][key]
