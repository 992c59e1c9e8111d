"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data: each row names a ratio, its bounds and what it guards
against.  ``quality_columns`` turns the table into columns of built-in
expressions (no user functions), so the whole operator is one narrow
projection over the scan: no shuffle, nothing held beyond one row.

A rule may name the languages it knows: the stop-word rule speaks only of
texts whose ``lang`` column says that they are in one of its four languages.

Edge cases: null and blank texts have no words (``base_failed``); ratios over
nothing are 0; a text of any length is judged as a whole; without a ``lang``
column, or where it is null, rules for certain languages do not apply; repeated
rows are judged one by one; an empty table gives an empty result; every input
column is kept, and result columns that would clash get the result's value only
in the digest (``judge``), not in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as by this at an be are or from not have but "
    "le la les de des du et en un une que qui est dans pour par sur pas au "
    "der die das und ist von zu den mit ein im nicht für auf dem sich es "
    "el los las y un una por con del se lo su para al como"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0        # shorter texts are not judged by this rule
    langs: tuple[str, ...] = () # texts in other languages are not judged by it; none listed: all are


#: The production table.  Ratios are per word, character or line of the text.
RULES = (
    Rule("word length", "mean_word_length", low=1.5, high=20.0),
    Rule("symbols per word", "symbol_ratio", high=0.1),
    Rule("repeated lines", "dup_line_ratio", high=0.5),
    Rule("bullet lines", "bullet_line_ratio", high=0.9, least_words=50),
    Rule("lines cut by dots", "ellipsis_line_ratio", high=0.3, least_words=50),
    Rule("words with a letter", "alpha_word_ratio", low=0.6, least_words=20),
    Rule("stop words", "stop_word_ratio", low=0.005, least_words=100, langs=("en", "fr", "de", "es")),
)


def _n_repeat_words(words: Column, k: int = 5) -> Column:
    """Words inside a ``k``-word window that occurs twice or more in ``words``.

    Windows are compared by a 64-bit hash within one text.  A text whose
    hashes all differ is done after one hash-set pass; otherwise equal hashes
    are neighbours after a sort, and the covered words are the gaps between
    flagged starts, each at most ``k``.
    """
    starts = F.sequence(F.lit(0), F.size(words) - k)
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def flagged(s: Column) -> Column:
        same = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(k)), F.lit(k)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(let(pairs, flagged), covered))

    return F.when(F.size(words) <= k, F.lit(0)).otherwise(let(grams, count)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every ratio the table may name, over columns that are already bound."""
    n = F.size(words)
    n_lines = F.size(lines)
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    n_of = lambda hit: F.size(F.filter(words, hit))
    n_lines_of = lambda hit: F.size(F.filter(lines, hit))
    return {
        "n_words": n.cast("long"),
        "word_chars": chars,
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _n_repeat_words(words),
        "n_stop_words": n_of(lambda w: F.lower(w).isin(*STOP_WORDS)).cast("long"),
        "n_alpha_words": n_of(lambda w: w.rlike(r"\p{L}")).cast("long"),
        "n_lines": n_lines.cast("long"),
        "n_bullet_lines": n_lines_of(lambda x: x.rlike(r"^\s*[-•*]")).cast("long"),
        "n_ellipsis_lines": n_lines_of(lambda x: x.rlike(r"(\.\.\.|…)\s*$")).cast("long"),
    }


def _ratios() -> dict[str, Column]:
    c = F.col
    return {
        "n_words": c("n_words"),
        "mean_word_length": _ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": _ratio(c("n_symbols"), c("n_words")),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": _ratio(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_ratio": _ratio(c("n_ellipsis_lines"), c("n_lines")),
        "alpha_word_ratio": _ratio(c("n_alpha_words"), c("n_words")),
        "stop_word_ratio": _ratio(c("n_stop_words"), c("n_words")),
    }


def compile_rules(rules=RULES) -> dict[str, Column]:
    """One boolean column per table row: does the text break that rule?"""
    ratio = _ratios()
    out = {}
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (ratio[r.metric] < r.low)
        if r.high is not None:
            bad = bad | (ratio[r.metric] > r.high)
        out[r.name] = bad & (F.col("n_words") >= r.least_words)
        if r.langs:
            out[r.name] &= F.coalesce(F.col("__lang").isin(*r.langs), F.lit(False))
    return out


def judge(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", rules=RULES,
          lang: str = "lang") -> DataFrame:
    """Counts, broken rules and verdict per row; ``keys`` are carried along."""
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    bound = docs.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
                        F.col(f"`{text}`").cast("string").alias("__text"), language.alias("__lang"))
    bound = bound.withColumn("__words", words_of(F.col("__text"))).withColumn(
        "__lines", F.filter(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = bound.select(*[f"__k{i}" for i in range(len(keys))], "__lang",
                           *[v.alias(k) for k, v in metrics(F.col("__text"), F.col("__words"), F.col("__lines")).items()])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = compile_rules(rules)
    judged = counted.withColumn("base_failed", base).withColumn(
        "broken", F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in broken.items()]), lambda x: x.isNotNull()))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    return judged.drop("__lang").withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keys)})


def keep(docs: DataFrame, text: str = "text", rules=RULES, lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all of their columns unchanged."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"),
                         *([F.col(f"`{lang}`").alias("lang")] if lang in docs.columns else []))
    # a filter on the verdict would be pushed below the projections and carry
    # a copy of every metric along; a generator reads the verdict once
    verdict = judge(packed, ("row",), "text", rules)  # its ``lang`` is that of ``packed``
    return verdict.select(F.explode(F.when(F.col("kept"), F.array("row")).otherwise(
        F.array().cast(verdict.select(F.array("row").alias("r")).schema["r"].dataType))).alias("row")).select("row.*")
