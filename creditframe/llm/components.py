"""Connected components of a link table, by repeated hooking and contraction.

Every round each node hooks onto its smallest smaller neighbour, the hooks
are compressed by pointer doubling, and the links are rewritten between the
surviving roots; links inside a root vanish.  The link table shrinks round by
round and every table is written to the shared folder, so the plan stays
short and a lost executor costs one step.  All joins are plain equi-joins of
written tables, which adaptive execution splits when one root is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, root): root is the smallest node reachable.

    Nodes without links do not appear.  Null ends are ignored.
    """
    def oriented(e: DataFrame) -> DataFrame:
        return (e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    links = written(oriented(links), "links")
    labels = None
    while not links.isEmpty():
        hooks = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = written(hooks.join(up, "root", "left")
                             .select("node", F.coalesce("higher", "root").alias("root"),
                                     F.col("higher").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        def to_root(df: DataFrame, col: str) -> DataFrame:  # noqa: E306
            h = hooks.select(F.col("node").alias(col), F.col("root").alias("__root"))
            return df.join(h, col, "left").withColumn(col, F.coalesce("__root", col)).drop("__root")

        moved = hooks if labels is None else to_root(labels, "root").unionByName(hooks)
        labels = written(moved.select("node", "root"), "labels")
        links = written(oriented(to_root(to_root(links, "a"), "b")), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = labels.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return written(labels.unionByName(roots), "components")
