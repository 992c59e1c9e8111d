"""One-to-many aggregates and their joins.

A child table is reduced to one row per parent key *before* it meets the
parent, so the join never multiplies rows.  Every aggregate here is
decomposable (sum, count, min, max, moments, distinct via Spark's two-phase
plan), so a key holding a third of all rows is combined map-side and crosses
the shuffle as one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import safe_div


def _agg_expr(col: str, func: str) -> Column:
    x = F.col(col)
    if func == "mean":
        return F.avg(x)
    if func == "sum":
        return F.sum(x)
    if func == "min":
        return F.min(x)
    if func == "max":
        return F.max(x)
    if func == "count":
        return F.count(x)
    if func == "std":  # sample, as pandas / PostgreSQL STDDEV
        return F.stddev_samp(x)
    if func == "std_pop":
        return F.stddev_pop(x)
    if func == "var":
        return F.var_samp(x)
    if func == "nunique":  # ignores nulls (COUNT DISTINCT / pandas nunique)
        return F.count_distinct(x)
    if func == "nunique_null":  # null is one more value (Polars n_unique)
        return F.count_distinct(x) + F.max(x.isNull().cast("int"))
    # (no per-group median here: an exact percentile aggregate holds a whole
    # group in one buffer; use ordered.quantiles(..., by=[key]) instead)
    raise ValueError(f"unknown aggregate {func!r}")


@dataclass
class AggSpec:
    """A1: ``{column: [funcs]}`` with generated names ``PREFIX_COLUMN_FUNC``.

    ``counts_if`` adds conditional counts (A9): ``{name: (column, value)}``.
    ``distinct`` adds distinct counts (A10): ``{name: column}``.
    ``upper`` upper-cases generated names as the source did.
    """

    prefix: str
    measures: Mapping[str, Sequence[str]] = field(default_factory=dict)
    counts_if: Mapping[str, tuple[str, object]] = field(default_factory=dict)
    distinct: Mapping[str, str] = field(default_factory=dict)
    distinct_counts_null: bool = False
    upper: bool = True

    def name(self, col: str, func: str) -> str:
        n = f"{self.prefix}_{col}_{func}"
        return n.upper() if self.upper else n

    def exprs(self) -> list[Column]:
        out = [_agg_expr(col, func).alias(self.name(col, func))
               for col, funcs in self.measures.items() for func in funcs]
        out += [count_if_equal(col, value).alias(name) for name, (col, value) in self.counts_if.items()]
        kind = "nunique_null" if self.distinct_counts_null else "nunique"
        out += [_agg_expr(col, kind).alias(name) for name, col in self.distinct.items()]
        return out


def count_if_equal(col: str, value) -> Column:
    """``SUM(CASE WHEN c = v THEN 1 ELSE 0 END)`` (0, not null, on a miss)."""
    return F.sum(F.when(F.col(col) == F.lit(value), 1).otherwise(0)).cast("long")


def child_aggregate(child: DataFrame, key: str | Sequence[str], spec: AggSpec,
                    post: Mapping[str, Column] | None = None) -> DataFrame:
    """One ``groupBy(key).agg`` for all measures (J3 is not needed:
    numeric and categorical outputs come from the same aggregate).
    ``post`` adds ratios computed on the aggregate output (F11)."""
    keys = [key] if isinstance(key, str) else list(key)
    out = child.groupBy(*keys).agg(*spec.exprs())
    if post:
        out = out.withColumns(dict(post))
    return out


def attach(base: DataFrame, key: str, *aggregates: DataFrame, fill_zero: Iterable[str] | None = None
           ) -> DataFrame:
    """J1 + I1: left-join per-key aggregates onto the base, then zero-fill.

    All sides are hash partitioned on the same key, so after the first join
    the base keeps its partitioning and each further child costs one exchange
    of the (already reduced) child aggregate only.
    """
    out = base
    for agg in aggregates:
        out = out.join(agg, on=key, how="left")
    if fill_zero:
        cols = [c for c in fill_zero if c in out.columns]
        if cols:
            out = out.fillna(0, subset=cols)
    return out


def fill_zero_by_substring(df: DataFrame, needles: Sequence[str],
                           protect: Sequence[str] = ()) -> DataFrame:
    """Zero-fill every numeric column whose name contains any needle.

    Note the substring rule is literal: ``BUREAU`` also catches columns such
    as ``AMT_REQ_CREDIT_BUREAU_*`` exactly as the source rule did.
    """
    from pyspark.sql import types as T
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cols = [c for c in df.columns if c in numeric and c not in protect and any(n in c for n in needles)]
    return df.fillna(0, subset=cols) if cols else df


def two_hop_aggregate(grandchild: DataFrame, child: DataFrame, *, grandchild_key: str,
                      parent_key: str, child_key: str | None = None, measures: Mapping[str, Sequence[str]],
                      counts_if: Mapping[str, tuple[str, object]] | None = None,
                      prefix: str = "BB") -> DataFrame:
    """Aggregate a grandchild table up two levels.

    Written as partial aggregate -> join -> merge so that the (large)
    grandchild is reduced to one row per child key *before* it meets the
    child table.  Means are rebuilt from sums and counts, so the result equals
    aggregating the joined rows directly; grandchild rows whose child is
    missing drop out, as a left join followed by a group-by on a null key did.
    """
    counts_if = dict(counts_if or {})
    partial: dict[str, Column] = {}
    for col, funcs in measures.items():
        for func in funcs:
            if func == "mean":
                partial[f"__s_{col}"] = F.sum(col)
                partial[f"__n_{col}"] = F.count(col)
            elif func in ("sum", "min", "max", "count"):
                partial[f"__{func}_{col}"] = _agg_expr(col, func)
            else:
                raise ValueError(f"{func} is not decomposable over two hops")
    for name, (col, value) in counts_if.items():
        partial[f"__if_{name}"] = count_if_equal(col, value)
    uniq = [e.alias(n) for n, e in partial.items()]
    per_child = grandchild.groupBy(grandchild_key).agg(*uniq)
    child_key = child_key or grandchild_key
    links = (child.select(F.col(child_key).alias(grandchild_key), F.col(parent_key))
             .where(F.col(parent_key).isNotNull()))
    joined = per_child.join(links, on=grandchild_key, how="inner")
    final = []
    for col, funcs in measures.items():
        for func in funcs:
            name = f"{prefix}_{col}_{func}".upper()
            if func == "mean":
                final.append(safe_div(F.sum(f"__s_{col}"), F.sum(f"__n_{col}").cast("double")).alias(name))
            elif func in ("sum", "count"):
                final.append(F.sum(f"__{func}_{col}").alias(name))
            else:
                final.append(_agg_expr(f"__{func}_{col}", func).alias(name))
    for name in counts_if:
        final.append(F.sum(f"__if_{name}").cast("long").alias(name))
    return joined.groupBy(parent_key).agg(*final)
