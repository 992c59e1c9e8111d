"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from . import (decontaminate, licences, line_templates, lm, mixing, oracles, passages, pii, prefix_trie, quality, simhash, substring_dedup,
               token_alignment, token_output)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op2_quality_rules", oracles.QUALITY)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.judge(documents(spark, sf_dir, "doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.concat_ws(",", "broken").alias("broken"))


@query("op1_decontaminate", oracles.DECONTAMINATE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 13-word benchmark windows in every document."""
    found = decontaminate.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op10_token_output")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to files and read back."""
    path = scratch_path(spark, "token-files")
    token_output.write(documents(spark, sf_dir), path)
    return token_output.read(spark, path, with_ids=False)


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document in the mix."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mixing.realise(docs, mixing.plan(docs)).select("doc_id", "source", "block", "place")


@query("op7_lm_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document, learnt from six sevenths."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm.score(documents(spark, sf_dir), held)


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every document."""
    found = pii.find(documents(spark, sf_dir))

    def listed(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
        name = F.array(*[F.lit(k) for k in pii.KINDS])
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
            ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    listed_kinds = F.filter("spans", lambda s: s["kind"] < len(pii.BASE_KINDS))
    secrets = F.filter("spans", lambda s: s["kind"] == pii.KINDS.index("secret"))

    def count(i: int):
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long").alias(f"n_{pii.KINDS[i]}")

    counts = [count(i) for i in range(len(pii.BASE_KINDS))]
    return found.select("row.doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(listed_kinds).alias("spans"),
                        F.size(secrets).cast("long").alias("n_secret"), listed(secrets).alias("secrets"))


@query("op5_licence_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that may be licence notices, and the family that stands."""
    docs = documents(spark, sf_dir)
    found = licences.scan(docs, licences.train(docs))
    return found.select("row.doc_id", "line", "predicted", F.round("p", 4).alias("p"),
                        F.round("similarity", 4).alias("similarity"), "family")


@query("op4_line_templates", oracles.LINE_TEMPLATES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that a recurring template stands for."""
    found = line_templates.dedupe(documents(spark, sf_dir))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 100-byte strings."""
    return substring_dedup.dedupe(documents(spark, sf_dir), with_text=False)


@query("op11_prefix_trie", oracles.PREFIX_TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over the rebuilt conversations."""
    turns = prefix_trie.encode(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(*prefix_trie.with_shared_heads(turns))


@query("op12_quality_classifier")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from four fifths of the labels."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = documents(spark, sf_dir)
    model = passages.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), remainder != 0)
    found = passages.score(docs, model)
    return found.select("row.doc_id", "score", "n_passages", "focus").select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "focus")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return token_alignment.align(documents(spark, sf_dir))
