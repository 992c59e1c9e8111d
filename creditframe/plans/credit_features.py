"""The applicant feature build over the eight raw credit tables.

One lazy plan from eight scans to one row per applicant, in the order of
the daily build: clean (sentinel, age, caps, isolation-forest score) ->
encode -> row features -> one aggregate per child table (reduced before the
join) -> sequence features -> derived amounts -> kNN label mean -> zero /
median fill -> event time -> projection to the published view.

Where the two source builds disagree, :class:`FeatureOptions` picks; the
defaults follow the survey's choice (bold column of its §2.13).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from ..functions.expressions import (finite_or_null, plus_div, row_count_flags, row_max, row_mean, row_min,
                                     row_product, row_std, safe_div, sentinel_to_null)
from ..operators.aggregate import AggSpec, attach, child_aggregate, fill_zero_by_substring, two_hop_aggregate
from ..operators.clean import add_age_years, cap_percentiles
from ..operators.impute import apply_label_codes, fill_median, fit_label_codes
from ..operators.installments import installment_aggregate, past_due_aggregate
from ..operators.knn import knn_target_mean
from ..operators.outliers import isolation_forest
from ..operators.sequence import first_last_means
from ..schemas import APPLICATION_TRAIN, CATEGORICAL_COLUMNS, ENTITY_KEY, EVENT_TS, FEATURE_NAMES, LABEL
from ..session import cut_lineage

KEY = ENTITY_KEY
# raw application columns the view leaves out (kept only in the unprojected matrix)
RAW_ONLY = {f.name for f in APPLICATION_TRAIN.fields} - set(FEATURE_NAMES)


@dataclass(frozen=True)
class FeatureOptions:
    ext_source: str = "skip"          # 'skip' nulls | 'zero' (nulls as 0, divisor 3, population std)
    past_due_std: str = "samp"        # 'samp' | 'pop' (over instalments > 0)
    past_due_severity: str = "per_late"   # 'per_late' | 'mean'
    distinct_counts_null: bool = False    # CREDIT_TYPE distinct count includes null (serving)
    knn: str = "computed"             # 'computed' | 'constant' (0.0, as the serving build)
    knn_k: int = 500
    knn_exclude_self: bool = False
    cap_method: str = "linear"        # 'linear' | 'nearest' | 'approx'
    history_fill: str = "zero"        # 'zero' | 'median'
    iforest_input: str = "before"     # isolation forest on values 'before' or 'after' capping
    iforest_trees: int = 100
    contamination: float = 0.05
    seed: int = 42
    extended: bool = False            # add the training build's extra families (A7, A8, F9, ...)


def _application_features(app: DataFrame, opts: FeatureOptions, codes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    # P1 / P2 / P3; the cleaned base feeds three branches, so it is
    # materialized once (reliable checkpoint in the shared folder)
    df = app.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED"))
    df = add_age_years(df)
    if opts.iforest_input == "before":
        iso_src = cut_lineage(df.select(KEY, *presets.ISOLATION_INPUTS))
        df = cut_lineage(cap_percentiles(df, presets.FINANCIAL, 0.01, 0.99, method=opts.cap_method))
    else:
        df = cut_lineage(cap_percentiles(df, presets.FINANCIAL, 0.01, 0.99, method=opts.cap_method))
        iso_src = df
    # P6 on median-filled inputs; scores come back by key
    iso_in = fill_median(iso_src.select(KEY, *presets.ISOLATION_INPUTS), presets.ISOLATION_INPUTS)
    iso = isolation_forest(iso_in, KEY, presets.ISOLATION_INPUTS, trees=opts.iforest_trees,
                           contamination=opts.contamination, seed=opts.seed)
    df = df.join(iso.select(KEY, "outlier_label", "outlier_score"), KEY, "left")
    # Stored, sorted codes with 'missing' for null
    present = [c for c in CATEGORICAL_COLUMNS if c in df.columns]
    codes = codes if codes is not None else fit_label_codes(df, present, null_token="missing")
    df = apply_label_codes(df, codes, present, null_token="missing", unseen=-1.0)
    # F1 / F2 / F3
    ext = presets.EXT_SOURCES
    doc_cols = [c for c in df.columns if "FLAG_DOCUMENT" in c]
    feats = {
        "CREDIT_INCOME_RATIO": safe_div("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_INCOME_RATIO": safe_div("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "CREDIT_GOODS_RATIO": safe_div("AMT_CREDIT", "AMT_GOODS_PRICE"),
        "ANNUITY_CREDIT_RATIO": safe_div("AMT_ANNUITY", "AMT_CREDIT"),
        "INCOME_PER_FAMILY_MEMBER": safe_div("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "CREDIT_PER_PERSON": safe_div("AMT_CREDIT", "CNT_FAM_MEMBERS"),
        "EXT_SOURCE_MEAN": row_mean(ext, opts.ext_source),
        "EXT_SOURCE_MAX": row_max(ext),
        "EXT_SOURCE_MIN": row_min(ext),
        "EXT_SOURCE_STD": row_std(ext, opts.ext_source),
        "DOCUMENT_COUNT": row_count_flags(doc_cols),
        "CONTACT_COUNT": row_count_flags(presets.CONTACT_FLAGS),
        "REGION_MISMATCH_COUNT": row_count_flags(presets.REGION_FLAGS),
    }
    if opts.extended:
        feats.update({
            "GOODS_INCOME_RATIO": safe_div("AMT_GOODS_PRICE", "AMT_INCOME_TOTAL"),
            "EMPLOY_TO_BIRTH_RATIO": safe_div("DAYS_EMPLOYED", "DAYS_BIRTH"),
            "EXT_SOURCE_MUL": row_product(ext),
            "AGE_INT": (F.col("DAYS_BIRTH") / -365).cast("int").cast("double"),     # F9: truncates
        })
    return df.withColumns(feats), codes


def _history(tables: Mapping[str, DataFrame], opts: FeatureOptions) -> list[DataFrame]:
    """One per-applicant aggregate per child family (each reduced before any join)."""
    bureau_spec = AggSpec(**{**presets.BUREAU.__dict__, "distinct_counts_null": opts.distinct_counts_null})
    if opts.extended:
        bureau_spec = AggSpec(**{**bureau_spec.__dict__, "measures": {
            **bureau_spec.measures, "AMT_ANNUITY": ["mean", "max"]}})
    bureau = child_aggregate(tables["bureau"], KEY, bureau_spec, post={
        "BUREAU_DEBT_CREDIT_RATIO": plus_div("BUREAU_AMT_CREDIT_SUM_DEBT_SUM", "BUREAU_AMT_CREDIT_SUM_SUM", 1.0),
        "BUREAU_CREDIT_UTILIZATION": plus_div("BUREAU_AMT_CREDIT_SUM_DEBT_SUM", "BUREAU_AMT_CREDIT_SUM_LIMIT_MEAN", 1.0),
    })
    prev_rows = tables["previous_application"].withColumn(
        "APPROVED", (F.col("NAME_CONTRACT_STATUS") == "Approved").cast("int"))
    prev = child_aggregate(prev_rows, KEY, presets.PREVIOUS, post={
        "PREV_APPROVAL_RATE": safe_div("PREV_APPROVED_COUNT", "PREV_SK_ID_PREV_COUNT")})
    last = dict(presets.SEQ_LAST)
    if opts.extended:
        last[10] = ["AMT_CREDIT", "AMT_ANNUITY", "DAYS_DECISION", "APPROVED"]
    names = dict(presets.SEQ_NAMES)
    names.update({("last", 10, c): f"PREV_LAST10_{'APPROVAL_RATE' if c == 'APPROVED' else c}" for c in last.get(10, [])})
    seq = first_last_means(prev_rows, KEY, "DAYS_DECISION", "SK_ID_PREV", last=last, first=presets.SEQ_FIRST,
                           names=names)
    pos = child_aggregate(tables["pos_cash_balance"], KEY, presets.POS)
    inst_kw = dict(key=KEY, due="AMT_INSTALMENT", paid="AMT_PAYMENT", due_day="DAYS_INSTALMENT",
                   paid_day="DAYS_ENTRY_PAYMENT")
    inst = installment_aggregate(tables["installments_payments"], **inst_kw, with_payment_amounts=opts.extended)
    past = past_due_aggregate(tables["installments_payments"], **inst_kw, std=opts.past_due_std,
                              severity=opts.past_due_severity)
    keep = ["PAST_DUE_DAYS_PAST_DUE_MEAN", "PAST_DUE_DAYS_PAST_DUE_SUM", "PAST_DUE_PAYMENT_RATIO_STD",
            "PAST_DUE_SEVERITY"]
    past = past.select(KEY, *(past.columns[1:] if opts.extended else keep))
    blocks = [bureau, prev, seq, pos, inst, past]
    if opts.extended:
        if "credit_card_balance" in tables:
            blocks.append(child_aggregate(tables["credit_card_balance"], KEY, presets.CREDIT_CARD, post={
                "CC_UTILIZATION_RATIO": safe_div("CC_AMT_BALANCE_MEAN", "CC_AMT_CREDIT_LIMIT_ACTUAL_MEAN")}))
        if "bureau_balance" in tables:
            blocks.append(two_hop_aggregate(
                tables["bureau_balance"], tables["bureau"], grandchild_key="SK_ID_BUREAU", parent_key=KEY,
                measures={"MONTHS_BALANCE": ["mean", "max"]},
                counts_if={"BB_STATUS_CLOSED_COUNT": ("STATUS", "C")}, prefix="BB"))
    return blocks


def _advanced(df: DataFrame, opts: FeatureOptions) -> DataFrame:
    """Amounts over risk score, interest estimates, down payment,
    credit years, income per employed year (before any fill, as built)."""
    out = df.withColumns({
        "AMT_CREDIT_div_EXT_SOURCE_3": plus_div("AMT_CREDIT", "EXT_SOURCE_3", 0.00001),
        "AMT_ANNUITY_div_EXT_SOURCE_3": plus_div("AMT_ANNUITY", "EXT_SOURCE_3", 0.00001),
        "AMT_INCOME_TOTAL_div_EXT_SOURCE_3": plus_div("AMT_INCOME_TOTAL", "EXT_SOURCE_3", 0.00001),
        "ESTIMATED_TOTAL_PAYMENT": F.col("AMT_ANNUITY") * F.col("PREV_CNT_PAYMENT_MEAN"),
        "CREDIT_ANNUITY_YEARS": plus_div("AMT_CREDIT", F.col("AMT_ANNUITY") * 12, 1.0),
        "INCOME_PER_YEAR_EMPLOYED": plus_div("AMT_INCOME_TOTAL", -F.col("DAYS_EMPLOYED") / 365, 1.0),
        "DOWN_PAYMENT_AMT": F.col("AMT_GOODS_PRICE") - F.col("AMT_CREDIT"),
    })
    out = out.withColumn("ESTIMATED_INTEREST", F.col("ESTIMATED_TOTAL_PAYMENT") - F.col("AMT_CREDIT"))
    out = out.withColumn("ESTIMATED_INTEREST_RATE", plus_div("ESTIMATED_INTEREST", "AMT_CREDIT", 1.0))
    out = out.withColumn("ESTIMATED_YEARLY_RATE",
                         plus_div("ESTIMATED_INTEREST_RATE", F.col("PREV_CNT_PAYMENT_MEAN") / 12, 0.001))
    if opts.extended:
        out = out.withColumns({
            "AMT_GOODS_PRICE_div_EXT_SOURCE_3": plus_div("AMT_GOODS_PRICE", "EXT_SOURCE_3", 0.00001),
            "DOWN_PAYMENT_RATIO": plus_div("DOWN_PAYMENT_AMT", "AMT_GOODS_PRICE", 1.0),
            "EMPLOYMENT_AGE_RATIO": safe_div("DAYS_EMPLOYED", "DAYS_BIRTH"),
        })
    return out


def feature_matrix(tables: Mapping[str, DataFrame], *, event_time: dt.datetime,
                   opts: FeatureOptions = FeatureOptions(), codes: DataFrame | None = None,
                   project: bool = True) -> tuple[DataFrame, DataFrame]:
    """The full build.  ``tables`` maps raw table names to DataFrames (read
    with :func:`sources.io.read_raw_table`).  Returns the matrix and the
    category-code dictionary used (store it with the model for scoring)."""
    app = tables["application_train"]
    has_label = LABEL in app.columns
    df, codes = _application_features(app, opts, codes)
    df = cut_lineage(df)
    df = attach(df, KEY, *_history(tables, opts))
    df = cut_lineage(_advanced(df, opts))
    # K1: computed on median-filled inputs over labelled rows, or constant
    if opts.knn == "computed" and has_label:
        knn_in = fill_median(df.select(KEY, LABEL, *presets.KNN_INPUTS), presets.KNN_INPUTS)
        knn = knn_target_mean(knn_in, KEY, presets.KNN_INPUTS, LABEL, opts.knn_k,
                              exclude_self=opts.knn_exclude_self, out="KNN_TARGET_MEAN_500")
        df = df.join(knn, KEY, "left")
    else:
        df = df.withColumn("KNN_TARGET_MEAN_500", F.lit(0.0))
    df = cut_lineage(df)
    # P7 then I1 / I2
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    df = df.withColumns({c: finite_or_null(c) for c in doubles})
    protect = [KEY, LABEL]
    hist = [c for c in df.columns if any(s in c for s in presets.HISTORY_SUBSTRINGS) and c not in protect]
    if opts.history_fill == "zero":
        df = fill_zero_by_substring(df, presets.HISTORY_SUBSTRINGS, protect=protect)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
               and f.name not in protect and (opts.history_fill == "median" or f.name not in hist)]
    df = fill_median(df, numeric)
    df = df.withColumn(EVENT_TS, F.lit(event_time))
    return (project_view(df, opts) if project else df), codes


def project_view(df: DataFrame, opts: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Key, label (when present), the view's features as double in model
    order (plus the extended families when asked), event time."""
    cols = [F.col(KEY).cast("long")] + ([F.col(LABEL).cast("double")] if LABEL in df.columns else [])
    extra = [c for c in df.columns if c not in FEATURE_NAMES and c not in (KEY, LABEL, EVENT_TS)
             and c not in RAW_ONLY and isinstance(df.schema[c].dataType, T.NumericType)] if opts.extended else []
    names = FEATURE_NAMES + extra
    return df.select(*cols, *[F.col(n).cast("double").alias(n) for n in names], F.col(EVENT_TS))
