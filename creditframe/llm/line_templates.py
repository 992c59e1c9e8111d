"""Line deduplication by a log-template tree.

A line walks a tree of fixed depth: first its token count, then its first
``DEPTH`` tokens, where a token with a digit counts as a variable field.  In
the leaf it meets all lines of its shape; a token is constant there if at
least ``MIN_DOCS`` documents have it at that place, every other token is
generalised to ``<*>``.  The template so formed stands for the line when at
least ``SIMILAR`` of its tokens are constant or fields of digits and
``MIN_CONSTANT`` or more are constant; a line unlike its leaf is its own
template.  Lines whose template occurs in ``MIN_DOCS`` documents or more are
dropped from all of them.

The outcome depends on the set of documents only, not on their order.

Scale: all counts are partial aggregates over hashes, one row per document
and leaf, token place or template, so a line that a third of all documents
share crosses a shuffle once per document, as a 64-bit hash.  A text that
``MIN_DOCS`` documents have is settled: all its tokens are constant.  Only
leaves with a text that is not are taken apart, each text once.  A leaf is
never gathered in one task: its tokens are counted by place and token.

Edge cases: lines without a token are kept; null text has no lines; rows
equal in id and text are one document; an empty table gives an empty result;
other columns do not matter and none is added to ``dedupe``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, written

DEPTH = 2
MIN_DOCS = 2
SIMILAR = 0.8
MIN_CONSTANT = 3
FIELD = "<*>"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANKS), "")


def _masked(tokens: Column) -> Column:
    """``tokens``, a string joined by blanks, with fields for those with a digit."""
    # begun at a token's first character only: linear in a token of any length
    field = F.regexp_replace(tokens, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    return F.when(tokens.rlike("[0-9]"), field).otherwise(tokens)


def _key(id: str, text: str) -> Column:
    """One number for what rows equal in id and text have in common."""
    return F.xxhash64(F.struct(F.col(f"`{id}`")), F.col(f"`{text}`").cast("string"))


def _leaf(line: Column) -> Column:
    """Hash of the tree path; null for a line without tokens."""
    def path(n: Column, lead: Column) -> Column:
        return F.xxhash64(n, _masked(lead))

    # most lines have single blanks only: counting them needs no array
    plain = (line != "") & ~line.startswith(" ") & ~line.endswith(" ")
    for blank in ("  ", "\t", "\x0b", "\x0c", "\r"):
        plain = plain & ~F.contains(line, F.lit(blank))
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1
    tokens = _tokens(line)
    return F.when(plain, path(n, F.substring_index(line, " ", DEPTH))).when(
        line.rlike(r"[^\x20\x09-\x0D]"), path(F.size(tokens), F.array_join(F.slice(tokens, 1, DEPTH), " ")))


def lines_of_busy_leaves(docs: DataFrame, id: str, text: str, min_docs: int) -> DataFrame:
    """(key, line, h, leaf) of the lines whose leaf enough documents reach; h
    stands for the line's text."""
    lines = docs.select(_key(id, text).alias("key"), F.posexplode(_lines(F.col(f"`{text}`"))).alias("line", "t"))
    # the filter comes after the table is written: pushed below, it would
    # compute every path a second time
    shaped = written(lines.select("key", "line", F.xxhash64("t").alias("h"), _leaf(F.col("t")).alias("leaf")),
                     "template-shapes").filter("leaf is not null")
    reached = (shaped.select("key", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
               .filter(F.col("n") >= min_docs))
    return written(shaped.join(written(reached.select("leaf"), "template-leaves"), "leaf")
                   .select("key", "line", "h", "leaf"), "template-lines")


def _places(texts: DataFrame, *cols: str) -> DataFrame:
    """(``cols``, place, c) per token of ``texts`` without a digit; c stands for
    leaf, place and token."""
    # most lines have no digit at all: their tokens are not searched again.  That
    # is found before the line is taken apart, not once a token
    lines = texts.select(*cols, "leaf", F.col("t").rlike("[0-9]").alias("digits"), _tokens(F.col("t")).alias("x"))
    # every line here has a token; not outer, Spark takes it apart twice to see that
    tokens = lines.select(*cols, "leaf", "digits", F.posexplode_outer("x").alias("place", "token"))
    plain = tokens.filter(~F.col("digits") | ~F.col("token").rlike("[0-9]"))
    return plain.select(*cols, "place", F.xxhash64("leaf", "place", "token").alias("c"))


def _constants(lines: DataFrame, in_leaf: DataFrame, found: DataFrame, min_docs: int) -> DataFrame:
    """c of what at least ``min_docs`` documents have; ``lines`` is (key, h,
    leaf) without repeats, ``found`` (h, leaf, t, n), n the documents with no
    other line in the leaf."""
    once = _places(found.filter("n > 0"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    # a document with several lines in the leaf counts once for a place and token
    several = lines.join(in_leaf.filter("n > 1").select("key", "leaf"), ["key", "leaf"], "left_semi").select("key", "h")
    shared = (_places(several.join(found.hint("merge"), "h"), "key").select("key", "c").distinct()
              .groupBy("c").agg(F.count("*").alias("n")))
    return (once.unionByName(shared).groupBy("c").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_docs).select("c"))


def templates(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
              similar: float = SIMILAR, min_constant: int = MIN_CONSTANT) -> tuple[DataFrame, DataFrame]:
    """(key, line, t) of candidate lines, t standing for their template, and
    (t, template, documents) of the templates that recur."""
    lines = lines_of_busy_leaves(docs, id, text, min_docs)
    distinct = written(lines.select("key", "h", "leaf").distinct(), "template-distinct")
    in_leaf = distinct.groupBy("key", "leaf").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    of_docs = distinct.groupBy("h", "leaf").agg(F.count("*").alias("docs"))
    # in other leaves every text is settled
    opened = of_docs.filter(F.col("docs") < min_docs).select("leaf").distinct().withColumn("open", F.lit(True))
    # a document with one line in the leaf counts wherever that line does
    alone = in_leaf.filter("n = 1").groupBy("h").agg(F.count("*").alias("n"))
    wanted = written(of_docs.join(alone.hint("merge"), "h", "left").join(opened.hint("merge"), "leaf", "left")
                     .select("h", "leaf", (F.col("docs") >= min_docs).alias("settled"), F.coalesce("open", F.lit(False)).alias("open"),
                             F.coalesce("n", F.lit(0)).alias("n")), "template-texts-wanted")
    lines_of = docs.select(F.explode(_lines(F.col(f"`{text}`"))).alias("t")).select(F.xxhash64("t").alias("h"), "t")
    # a line that many documents share leaves each task once
    texts = lines_of.groupBy("h").agg(F.first("t").alias("t"))
    # what is wanted grows with the corpus, so it is joined by key at every size
    found = written(texts.join(wanted.hint("merge"), "h").select("h", "leaf", "t", "n", "settled", "open"), "template-texts")
    constant = written(_constants(distinct, in_leaf, found.filter("open"), min_docs), "template-constants")
    whole = F.array_join("x", " ")
    taken = ["h", F.col("t").rlike("[0-9]").alias("digits"), _tokens(F.col("t")).alias("x")]
    # digits are looked for only where they can decide
    fields = F.when(F.col("digits"), F.size(F.filter("x", lambda w: w.rlike("[0-9]")))).otherwise(0)
    # in a settled text only fields of digits are not constant
    like = (F.size("x") - fields >= min_constant) & (F.size("x") >= F.size("x") * similar)
    settled = found.filter("settled").select(*taken).select(
        "h", F.when(F.col("digits") & like, _masked(whole)).otherwise(whole).alias("template"))
    # only the places found constant go back to their text
    unsettled = found.filter("not settled")
    fixed = _places(unsettled, "h").join(constant.hint("merge"), "c").groupBy("h").agg(F.collect_list("place").alias("fixed"))
    formed = unsettled.select("h", "t").join(fixed.hint("merge"), "h", "left").select(
        *taken, F.coalesce("fixed", F.array().cast("array<int>")).alias("fixed"))
    enough = F.size("fixed") >= F.size("x") * similar
    like = (F.size("fixed") >= min_constant) & (enough | (F.size("fixed") + fields >= F.size("x") * similar))
    free = F.array_except(F.sequence(F.lit(0), F.size("x") - 1), F.col("fixed"))
    filled = F.array_sort(F.concat(
        F.transform("fixed", lambda i: F.struct(i.alias("place"), F.get("x", i).alias("token"))),
        F.transform(free, lambda i: F.struct(i.alias("place"), F.lit(FIELD).alias("token")))))
    general = F.array_join(F.transform(filled, lambda x: x["token"]), " ")
    of_text = written(formed.select("h", F.when(like, general).otherwise(whole).alias("template")).unionByName(settled)
                      .withColumn("t", F.xxhash64("template")), "template-of-text")
    documents = (distinct.select("key", "h").join(of_text.select("h", "t"), "h").select("key", "t").distinct()
                 .groupBy("t").agg(F.count("*").alias("documents")).filter(F.col("documents") >= min_docs))
    recurring = written(of_text.groupBy("t").agg(F.first("template").alias("template")).join(documents, "t"), "templates")
    return lines.select("key", "line", "h").join(of_text.select("h", "t"), "h").drop("h"), recurring


def dropped(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, lines): line numbers to drop, per document that has any."""
    of, recurring = templates(docs, id, text, **options)
    gone = of.join(recurring.select("t"), "t", "left_semi")
    return written(gone.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines")), "template-dropped")


def dedupe(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``row`` (struct of all columns), ``kept`` text, ``n_lines`` with a
    token, ``n_dropped`` per row of ``docs``."""
    gone = dropped(docs, id, text, **options).select(F.col("key").alias("gone"), "lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id, text).alias("key"))
    both = rows.join(gone.hint("merge"), F.col("key") == F.col("gone"), "left").withColumn("all", _lines(F.col(f"row.`{text}`")))
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.coalesce("lines", F.array().cast("array<int>")))
    rest = F.array_join(F.transform(places, lambda i: F.get("all", i)), "\n")
    kept = F.when(F.col("lines").isNull(), F.col(f"row.`{text}`").cast("string")).otherwise(rest)
    filled = F.size(F.filter("all", lambda t: t.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return both.select("row", F.when(F.col(f"row.`{text}`").isNotNull(), kept).alias("kept"), filled.alias("n_lines"),
                       F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))
