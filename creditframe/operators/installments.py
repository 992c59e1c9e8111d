"""Instalment payment rows and their per-applicant aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import safe_div


def payment_rows(df: DataFrame, *, due: str, paid: str, days_diff: str | None = None,
                 due_day: str | None = None, paid_day: str | None = None) -> DataFrame:
    """per-row payment features.

    ``DAYS_DIFF`` is ``paid_day - due_day`` (or a given column).  A null
    difference counts as not late and 0 days past due, as ``GREATEST`` and
    the row lambda of the source treated it.  ``PAYMENT_RATIO`` is null for a
    zero instalment instead of infinity.
    """
    diff = F.col(days_diff) if days_diff else (F.col(paid_day) - F.col(due_day))
    return (df.withColumn("DAYS_DIFF", diff.cast("double"))
            .withColumns({
                "PAYMENT_DIFF": F.col(paid) - F.col(due),
                "PAYMENT_RATIO": safe_div(F.col(paid), F.col(due)),
                "LATE_PAYMENT": F.coalesce(F.col("DAYS_DIFF") > 0, F.lit(False)).cast("int"),
                "DAYS_PAST_DUE": F.greatest(F.col("DAYS_DIFF"), F.lit(0.0)),
            }))


def installment_exprs(*, due: str, paid: str, prefix: str = "INST", with_payment_amounts: bool = False):
    """A5 aggregate expressions over :func:`payment_rows` output."""
    p = prefix
    exprs = [
        F.avg(due).alias(f"{p}_AMT_INSTALMENT_MEAN"),
        F.sum(due).alias(f"{p}_AMT_INSTALMENT_SUM"),
        F.max(due).alias(f"{p}_AMT_INSTALMENT_MAX"),
    ]
    if with_payment_amounts:
        exprs += [F.avg(paid).alias(f"{p}_AMT_PAYMENT_MEAN"), F.sum(paid).alias(f"{p}_AMT_PAYMENT_SUM"),
                  F.max(paid).alias(f"{p}_AMT_PAYMENT_MAX")]
    exprs += [
        F.avg("PAYMENT_DIFF").alias(f"{p}_PAYMENT_DIFF_MEAN"),
        F.sum("PAYMENT_DIFF").alias(f"{p}_PAYMENT_DIFF_SUM"),
        F.avg("PAYMENT_RATIO").alias(f"{p}_PAYMENT_RATIO_MEAN"),
        F.min("PAYMENT_RATIO").alias(f"{p}_PAYMENT_RATIO_MIN"),
        F.avg("DAYS_DIFF").alias(f"{p}_DAYS_DIFF_MEAN"),
        F.max("DAYS_DIFF").alias(f"{p}_DAYS_DIFF_MAX"),
        F.sum("LATE_PAYMENT").cast("long").alias(f"{p}_LATE_PAYMENT_SUM"),
        F.avg(F.col("LATE_PAYMENT").cast("double")).alias(f"{p}_LATE_PAYMENT_MEAN"),
    ]
    return exprs


def installment_aggregate(df: DataFrame, *, key: str, due: str, paid: str,
                          days_diff: str | None = None, due_day: str | None = None,
                          paid_day: str | None = None, prefix: str = "INST",
                          with_payment_amounts: bool = False) -> DataFrame:
    """A5: instalment behaviour per applicant (11 outputs; 14 with the
    payment amounts of the training build)."""
    rows = payment_rows(df, due=due, paid=paid, days_diff=days_diff, due_day=due_day, paid_day=paid_day)
    return rows.groupBy(key).agg(*installment_exprs(due=due, paid=paid, prefix=prefix,
                                                    with_payment_amounts=with_payment_amounts))


def past_due_aggregate(df: DataFrame, *, key: str, due: str, paid: str,
                       days_diff: str | None = None, due_day: str | None = None,
                       paid_day: str | None = None, std: str = "samp",
                       severity: str = "per_late", prefix: str = "PAST_DUE") -> DataFrame:
    """Past-due behaviour per applicant.

    ``std='samp'``: sample deviation of the payment ratio (training build);
    ``std='pop'``: population deviation over instalments above 0 (serving).
    ``severity='per_late'``: days past due / (late count + 1);
    ``severity='mean'``: mean days past due.
    """
    rows = payment_rows(df, due=due, paid=paid, days_diff=days_diff, due_day=due_day, paid_day=paid_day)
    return rows.groupBy(key).agg(*past_due_exprs(due=due, std=std, severity=severity, prefix=prefix))


def past_due_exprs(*, due: str, std: str = "samp", severity: str = "per_late", prefix: str = "PAST_DUE"):
    """A6 aggregate expressions over :func:`payment_rows` output."""
    p = prefix
    if std == "pop":
        ratio_std = F.stddev_pop(F.when(F.col(due) > 0, F.col("PAYMENT_RATIO")))
    else:
        ratio_std = F.stddev_samp("PAYMENT_RATIO")
    late_sum = F.sum("LATE_PAYMENT")
    if severity == "mean":
        sev = F.avg("DAYS_PAST_DUE")
    else:
        sev = F.sum("DAYS_PAST_DUE") / (late_sum + 1).cast("double")
    return [
        F.avg("DAYS_PAST_DUE").alias(f"{p}_DAYS_PAST_DUE_MEAN"),
        F.max("DAYS_PAST_DUE").alias(f"{p}_DAYS_PAST_DUE_MAX"),
        F.sum("DAYS_PAST_DUE").alias(f"{p}_DAYS_PAST_DUE_SUM"),
        late_sum.cast("long").alias(f"{p}_LATE_PAYMENT_SUM"),
        F.avg(F.col("LATE_PAYMENT").cast("double")).alias(f"{p}_LATE_PAYMENT_MEAN"),
        F.avg("PAYMENT_RATIO").alias(f"{p}_PAYMENT_RATIO_MEAN"),
        ratio_std.alias(f"{p}_PAYMENT_RATIO_STD"),
        F.min("PAYMENT_RATIO").alias(f"{p}_PAYMENT_RATIO_MIN"),
        sev.alias(f"{p}_SEVERITY"),
    ]


def payment_behaviour(df: DataFrame, *, key: str, due: str, paid: str, days_diff: str | None = None,
                      due_day: str | None = None, paid_day: str | None = None, std: str = "samp",
                      severity: str = "per_late", also: Sequence[Column] = ()) -> DataFrame:
    """A5 + A6 from one pass: both families share the payment rows and the
    shuffle on the applicant key; ``also`` adds aggregates of the same rows."""
    rows = payment_rows(df, due=due, paid=paid, days_diff=days_diff, due_day=due_day, paid_day=paid_day)
    a5 = installment_exprs(due=due, paid=paid)
    a6 = [e for e in past_due_exprs(due=due, std=std, severity=severity)]
    return rows.groupBy(key).agg(*a5, *a6, *also)
