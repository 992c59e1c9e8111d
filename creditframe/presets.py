"""Credit-domain feature sets as data; the operators stay generic.

Output names must equal the published view's names (see ``schemas``), so
the aggregate presets below are fixed values.
"""

from __future__ import annotations

from .operators.aggregate import AggSpec

# --- fixed values: bureau aggregate (20 outputs) --------------------------
BUREAU = AggSpec(
    prefix="BUREAU",
    measures={
        "DAYS_CREDIT": ["mean", "min", "max"],
        "CREDIT_DAY_OVERDUE": ["mean", "max"],
        "DAYS_CREDIT_ENDDATE": ["mean", "min"],
        "AMT_CREDIT_MAX_OVERDUE": ["mean"],
        "AMT_CREDIT_SUM": ["mean", "sum", "max"],
        "AMT_CREDIT_SUM_DEBT": ["mean", "sum"],
        "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
        "AMT_CREDIT_SUM_OVERDUE": ["mean", "sum"],
        "SK_ID_BUREAU": ["count"],
    },
    counts_if={"BUREAU_ACTIVE_COUNT": ("CREDIT_ACTIVE", "Active")},
    distinct={"BUREAU_CREDIT_TYPE_COUNT": "CREDIT_TYPE"},
)

# --- fixed values: previous-application aggregate (19 outputs) ------------
PREVIOUS = AggSpec(
    prefix="PREV",
    measures={
        "AMT_ANNUITY": ["mean", "max", "min"],
        "AMT_APPLICATION": ["mean", "max", "sum"],
        "AMT_DOWN_PAYMENT": ["mean", "max"],
        "AMT_GOODS_PRICE": ["mean"],
        "HOUR_APPR_PROCESS_START": ["mean"],
        "RATE_DOWN_PAYMENT": ["mean", "max"],
        "DAYS_DECISION": ["mean", "min"],
        "CNT_PAYMENT": ["mean", "sum"],
        "SK_ID_PREV": ["count"],
    },
    counts_if={"PREV_APPROVED_COUNT": ("NAME_CONTRACT_STATUS", "Approved")},
    distinct={"PREV_CONTRACT_TYPE_COUNT": "NAME_CONTRACT_TYPE"},
)

# --- fixed values: POS cash aggregate (7 outputs) -------------------------
POS = AggSpec(
    prefix="POS",
    measures={
        "MONTHS_BALANCE": ["mean", "max"],
        "CNT_INSTALMENT": ["mean", "sum"],
        "SK_DPD": ["mean", "max"],
        "SK_DPD_DEF": ["mean"],
    },
)

# --- fixed values: credit-card aggregate (training build) -----------------
CREDIT_CARD = AggSpec(
    prefix="CC",
    measures={
        "AMT_BALANCE": ["mean", "max", "sum"],
        "AMT_CREDIT_LIMIT_ACTUAL": ["mean", "max"],
        "AMT_DRAWINGS_ATM_CURRENT": ["mean", "sum"],
        "AMT_DRAWINGS_CURRENT": ["mean", "sum"],
        "AMT_PAYMENT_CURRENT": ["mean", "sum"],
        "CNT_DRAWINGS_ATM_CURRENT": ["mean", "sum"],
        "SK_DPD": ["mean", "max"],
        "SK_DPD_DEF": ["mean", "max"],
    },
)

# --- fixed values: previous-application sequence features -----------------
# last N (newest first) and first N (oldest first) by DAYS_DECISION
SEQ_LAST = {3: ["AMT_CREDIT", "AMT_ANNUITY", "DAYS_DECISION", "APPROVED"], 5: ["AMT_ANNUITY"]}
SEQ_FIRST = {2: ["AMT_CREDIT", "DAYS_DECISION"], 4: ["AMT_CREDIT"]}
SEQ_NAMES = {
    ("last", 3, "AMT_CREDIT"): "PREV_LAST3_AMT_CREDIT",
    ("last", 3, "AMT_ANNUITY"): "PREV_LAST3_AMT_ANNUITY",
    ("last", 3, "DAYS_DECISION"): "PREV_LAST3_DAYS_DECISION",
    ("last", 3, "APPROVED"): "PREV_LAST3_APPROVAL_RATE",
    ("last", 5, "AMT_ANNUITY"): "PREV_LAST5_AMT_ANNUITY",
    ("first", 2, "AMT_CREDIT"): "PREV_FIRST2_AMT_CREDIT",
    ("first", 2, "DAYS_DECISION"): "PREV_FIRST2_DAYS_DECISION",
    ("first", 4, "AMT_CREDIT"): "PREV_FIRST4_AMT_CREDIT",
}

# --- fixed values: column groups of the application table -----------------
FINANCIAL = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"]
ISOLATION_INPUTS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AGE_YEARS",
                    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CONTACT_FLAGS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
REGION_FLAGS = ["REG_REGION_NOT_LIVE_REGION", "REG_REGION_NOT_WORK_REGION", "LIVE_REGION_NOT_WORK_REGION",
                "REG_CITY_NOT_LIVE_CITY", "REG_CITY_NOT_WORK_CITY", "LIVE_CITY_NOT_WORK_CITY"]
KNN_INPUTS = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "ANNUITY_CREDIT_RATIO"]
HISTORY_SUBSTRINGS = ["BUREAU", "PREV", "POS", "INST", "PAST"]
