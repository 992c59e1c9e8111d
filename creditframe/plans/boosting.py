"""Histogram boosting, patience and random search (M3, M4, M6).

The frame is the labelled documents with counts of characters as features.
``m3_first_tree`` and ``m6_patience`` use fixed bin edges, so DuckDB grows the
same trees; ``m3_tree_sums`` trains on the applicants with quantile edges and
recomputes what a returned tree claims from rows routed by built-in
expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..sources.tables import table
from .models import MODEL_FEATURES, _training_frame
from .registry import register

SIGNS = {"n_pipes": "|", "n_bangs": "!", "n_percents": "%"}
SHAPE = ["n_chars", *SIGNS]
EDGES = ([100.0 * 2 ** i for i in range(8)], *[[0.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]] * len(SIGNS))

_ROWS_SQL = "SELECT l.doc_id, l.quality::DOUBLE AS y, d.n_chars::DOUBLE AS v0, " + ", ".join(
    f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS v{i}" for i, c in enumerate(SIGNS.values(), 1)
) + " FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL"
_BINS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS f, CASE WHEN v{i} IS NULL THEN 0 ELSE 1 + len(list_filter({list(e)}, lambda e: e < v{i})) END AS bin FROM r"
    for i, e in enumerate(EDGES))


def document_shape(spark, sf_dir):
    """(doc_id, quality, character counts) of the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    counts = [(F.char_length("text") - F.char_length(F.replace("text", F.lit(c)))).cast("double").alias(n) for n, c in SIGNS.items()]
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(
        docs.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), *counts), "doc_id")


def _shrunk_sql(g: str, p: B.Params) -> str:
    return f"(sign({g}) * greatest(abs({g}) - {p.reg_alpha}, 0))"


def _score_sql(g: str, h: str, p: B.Params) -> str:
    return f"(power({_shrunk_sql(g, p)}, 2) / ({h} + {p.reg_lambda}))"


def _splits_sql(cells: str, p: B.Params) -> str:
    """(node, f, bin, gain) of the best split of every node of ``cells`` (node,
    f, bin, g, h, n)."""
    fine = (f"least(ln, n - ln) >= {p.min_child_samples} AND least(lh, h - lh) >= {p.min_child_weight} "
            f"AND gain > greatest({p.min_split_gain}, 1e-12)")
    return f"""SELECT node, f, bin, gain FROM (
        SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, bin) AS place FROM (
          SELECT *, {_score_sql('lg', 'lh', p)} + {_score_sql('(g - lg)', '(h - lh)', p)} - {_score_sql('g', 'h', p)} AS gain FROM (
            SELECT node, f, bin, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln,
                   sum(g) OVER (PARTITION BY node, f) AS g, sum(h) OVER (PARTITION BY node, f) AS h,
                   sum(n) OVER (PARTITION BY node, f) AS n
            FROM ({cells}) WINDOW w AS (PARTITION BY node, f ORDER BY bin)))
        WHERE {fine}) WHERE place = 1"""


def _value_sql(p: B.Params) -> str:
    return f"-{p.learning_rate}::DOUBLE * {_shrunk_sql('sum(g)', p)} / (sum(h) + {p.reg_lambda})"


FIRST_TREE = B.Params(num_leaves=4, max_depth=2, learning_rate=0.1, n_estimators=1, min_child_samples=5,
                      reg_alpha=0.1, reg_lambda=1.0)
_NAMES = "[" + ", ".join(f"'{n}'" for n in SHAPE) + "]"
_ALL_EDGES = "[" + ", ".join(str(list(e)) for e in EDGES) + "]"


@register("m3_first_tree", f"""
WITH r AS MATERIALIZED ({_ROWS_SQL}),
b AS MATERIALIZED ({_BINS_SQL}),
z AS (SELECT doc_id, '' AS node, (SELECT avg(y) FROM r) - y AS g, (SELECT avg(y) * (1 - avg(y)) FROM r) AS h FROM r),
s0 AS MATERIALIZED ({_splits_sql("SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM z JOIN b USING (doc_id) GROUP BY ALL", FIRST_TREE)}),
z1 AS MATERIALIZED (SELECT z.doc_id, CASE WHEN b.bin > s0.bin THEN 'R' ELSE 'L' END AS node, g, h
                    FROM z JOIN s0 ON z.node = s0.node JOIN b ON b.doc_id = z.doc_id AND b.f = s0.f),
s1 AS MATERIALIZED ({_splits_sql("SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM z1 JOIN b USING (doc_id) GROUP BY ALL", FIRST_TREE)}),
z2 AS (SELECT z1.doc_id, z1.node || CASE WHEN b.bin > s1.bin THEN 'R' ELSE 'L' END AS node, g, h
       FROM z1 JOIN s1 ON z1.node = s1.node JOIN b ON b.doc_id = z1.doc_id AND b.f = s1.f),
n AS (SELECT node, count(*) AS n, {_value_sql(FIRST_TREE)} AS value
      FROM (SELECT * FROM z UNION ALL SELECT * FROM z1 UNION ALL SELECT * FROM z2) GROUP BY node),
s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)
SELECT n.node AS path, ({_NAMES})[f + 1] AS feature, CASE WHEN bin > 0 THEN ({_ALL_EDGES})[f + 1][bin] END AS threshold, n,
       round(gain, 6) AS gain, round(value, 6) AS value
FROM n LEFT JOIN s ON n.node = s.node
""", "M3 (one tree, every split and leaf value)")
def m3_first_tree(spark, sf_dir):
    binned = B.bin_features(document_shape(spark, sf_dir), SHAPE, "doc_id", "quality", edges=EDGES)
    model, = B.train(binned, [(FIRST_TREE, -1)])
    tree = model.trees[0]
    path = {0: ""}
    for i, left in enumerate(tree.left):
        if left >= 0:
            path[left], path[left + 1] = path[i] + "L", path[i] + "R"
    names = spark.createDataFrame(sorted(path.items()), "node int, path string")
    return model.table(spark).join(names, "node").select(
        "path", "feature", "threshold", "n", F.round("gain", 6).alias("gain"), F.round("value", 6).alias("value"))


TREES = B.Params(num_leaves=8, max_depth=5, learning_rate=0.2, n_estimators=4, min_child_samples=10, reg_alpha=0.05,
                 reg_lambda=1.0)


@register("m3_tree_sums", f"SELECT unnest(range(1, {TREES.n_estimators + 1}))::INTEGER AS round, true AS rows_hold, "
          "true AS values_hold, true AS gains_hold, true AS leaves_in_limit", "M3 (leaf values and gains recomputed from rows)")
def m3_tree_sums(spark, sf_dir):
    """What the returned trees claim against sums over all rows, routed by
    expressions on the raw values."""
    rows = _training_frame(spark, sf_dir)
    binned = B.bin_features(rows, MODEL_FEATURES, "c_custkey", "target", weight="weight")
    model, = B.train(binned, [(TREES, -1)])
    margin, above = F.lit(model.base), []
    for tree in model.trees:
        up = [[] for _ in tree.left]
        for i in range(len(tree.left)):
            up[i] = [i, *(up[tree.up[i]] if tree.up[i] >= 0 else [])]
        above.append(up)
    part = []
    for r, tree in enumerate(model.trees, 1):
        leaf = model.leaf_column(tree)
        p = 1 / (1 + F.exp(-margin))
        g, h = F.col("weight") * (p - F.col("target")), F.col("weight") * p * (1 - p)
        nodes = F.array(*[F.array(*map(F.lit, u)) for u in above[r - 1]])
        part.append(F.struct(F.lit(r).alias("round"), g.alias("g"), h.alias("h"), F.element_at(nodes, leaf + 1).alias("nodes")))
        margin = margin + F.element_at(F.array(*map(F.lit, tree.value)), leaf + 1)
    routed = rows.select(F.explode(F.array(*part)).alias("x")).select("x.round", "x.g", "x.h", F.explode("x.nodes").alias("node"))
    sums = routed.groupBy("round", "node").agg(F.sum("g").alias("rg"), F.sum("h").alias("rh"), F.count("*").alias("rn"))
    nodes = model.table(spark).join(sums, ["round", "node"], "left")
    return _claims(nodes)


def _claims(nodes):
    """Per round: do rows, values and gains of the nodes follow from the sums
    rg, rh, rn?"""
    def score(g, h):
        return F.pow(F.greatest(F.abs(F.col(g)) - TREES.reg_alpha, F.lit(0.0)), 2) / (F.col(h) + TREES.reg_lambda)

    def child(name, shift):
        return nodes.select("round", (F.col("node") - shift).alias("left"), F.col("rg").alias(f"{name}_g"), F.col("rh").alias(f"{name}_h"))

    both = nodes.join(child("left", 0).join(child("right", 1), ["round", "left"]), ["round", "left"], "left")
    shrunk = F.signum("rg") * F.greatest(F.abs("rg") - TREES.reg_alpha, F.lit(0.0))
    value = -TREES.learning_rate * shrunk / (F.col("rh") + TREES.reg_lambda)
    gain = score("left_g", "left_h") + score("right_g", "right_h") - score("rg", "rh")
    return both.groupBy("round").agg(
        F.bool_and(F.col("n") == F.col("rn")).alias("rows_hold"),
        F.bool_and(F.abs(F.col("value") - value) < 1e-6).alias("values_hold"),
        F.bool_and(F.when(F.col("left") >= 0, F.abs(F.col("gain") - gain) < 1e-6).otherwise(True)).alias("gains_hold"),
        (F.count_if(F.col("left") < 0) <= TREES.num_leaves).alias("leaves_in_limit"))


STUMPS = B.Params(num_leaves=2, max_depth=1, learning_rate=0.5, n_estimators=6, min_child_samples=5, reg_lambda=1.0)
PATIENCE = 3


def _patience_sql() -> str:
    """Rounds of stumps, their validation AUC, and the stopping rule."""
    p = STUMPS
    ctes = [f"r AS MATERIALIZED ({_ROWS_SQL})", f"b AS MATERIALIZED ({_BINS_SQL})",
            "m0 AS MATERIALIZED (SELECT doc_id, y, doc_id % 4 = 0 AS held, (SELECT ln(avg(y) / (1 - avg(y))) FROM r "
            "WHERE doc_id % 4 <> 0) AS margin FROM r)"]
    for k in range(1, p.n_estimators + 1):
        ctes += [
            f"z{k} AS MATERIALIZED (SELECT doc_id, '' AS node, 1 / (1 + exp(-margin)) - y AS g, "
            f"1 / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) AS h FROM m{k - 1} WHERE NOT held)",
            f"s{k} AS MATERIALIZED ({_splits_sql(f'SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM z{k} JOIN b USING (doc_id) GROUP BY ALL', p)})",
            f"d{k} AS MATERIALIZED (SELECT m.doc_id, coalesce(b.bin > s.bin, false) AS side FROM m{k - 1} m LEFT JOIN s{k} s ON true "
            f"LEFT JOIN b ON b.doc_id = m.doc_id AND b.f = s.f)",
            f"v{k} AS MATERIALIZED (SELECT side, {_value_sql(p)} AS value FROM z{k} JOIN d{k} USING (doc_id) GROUP BY side)",
            f"m{k} AS MATERIALIZED (SELECT m.doc_id, y, held, margin + value AS margin FROM m{k - 1} m JOIN d{k} USING (doc_id) JOIN v{k} USING (side))",
            f"a{k} AS MATERIALIZED (SELECT {k} AS round, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT pos, neg, "
            f"coalesce(sum(neg) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT "
            f"round_even({B.AUC_STEPS} / (1 + exp(-margin)), 0) AS step, sum(y) AS pos, sum(1 - y) AS neg FROM m{k} WHERE held GROUP BY 1)))"]
    every = " UNION ALL ".join(f"SELECT * FROM a{k}" for k in range(1, p.n_estimators + 1))
    ctes += [f"a AS MATERIALIZED ({every})",
             "best AS MATERIALIZED (SELECT x.round, (SELECT min(y.round) FROM a y WHERE y.round <= x.round AND y.auc = "
             "(SELECT max(auc) FROM a w WHERE w.round <= x.round)) AS best FROM a x)",
             f"stop AS MATERIALIZED (SELECT coalesce(min(round), {p.n_estimators}) AS last, coalesce(min(round), 0) > 0 AS stopped FROM best "
             f"WHERE round - best >= {PATIENCE})"]
    return ("WITH " + ",\n".join(ctes) + "\nSELECT a.round::INTEGER AS round, round(auc, 6) AS auc, a.round = (SELECT best FROM best, stop "
            "WHERE round = last) AS is_best, stopped FROM a, stop WHERE a.round <= last")


@register("m6_patience", _patience_sql(), "M6, M7 (AUC per round, best round, stop after rounds without gain)")
def m6_patience(spark, sf_dir):
    rows = document_shape(spark, sf_dir).withColumn("fold", (F.pmod("doc_id", F.lit(4)) == 0).cast("int"))
    binned = B.bin_features(rows, SHAPE, "doc_id", "quality", group="fold", edges=EDGES)
    model, = B.train(binned, [(STUMPS, 1)], patience=PATIENCE)
    found = [(i, round(a, 6), i == model.best_round, model.stopped) for i, a in enumerate(model.history, 1)]
    return spark.createDataFrame(found, "round int, auc double, is_best boolean, stopped boolean")


DRAWS, FOLDS = 4, 3


@register("m4_search", f"SELECT unnest(range({DRAWS}))::INTEGER AS draw, true AS in_range, true AS best_is_largest",
          "M4, K3 (12-parameter space, folds and draws share one binned table)")
def m4_search(spark, sf_dir):
    """Random search over the published distributions, with fewer rounds."""
    space = dict(B.SPACE) | {"n_estimators": B.Integers(4, 9)}
    rows = document_shape(spark, sf_dir).withColumn("fold", F.pmod("doc_id", F.lit(FOLDS)))
    binned = B.bin_features(rows, SHAPE, "doc_id", "quality", group="fold")
    found, _ = B.random_search(binned, space, draws=DRAWS, folds=FOLDS)
    inside = F.lit(True)
    for name, s in space.items():
        inside = inside & F.col(name).between(s.low, s.high)
    whole = [F.col(n) == F.floor(n) for n, s in space.items() if isinstance(s, B.Integers)]
    for w in whole:
        inside = inside & w
    top = found.agg(F.max("mean_auc"), F.sum(F.col("is_best").cast("int"))).first()
    return found.select("draw", inside.alias("in_range"), (F.when(F.col("is_best"), F.col("mean_auc") == top[0]).otherwise(
        F.col("mean_auc") <= top[0]) & F.lit(top[1] == 1)).alias("best_is_largest"))
