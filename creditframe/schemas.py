"""Explicit schemas for the raw credit tables and the published feature view.

Raw files declare every number as double, ids included; ids are read as
long here so that joins hash 8-byte integers.  No schema is ever inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names and order of the raw credit tables -------
# (these must equal the source system's names for the loaders to line up;
#  `:s` marks a text column, everything else is double, `:id` a long key)
APPLICATION_TRAIN_COLUMNS = """
SK_ID_CURR:id TARGET NAME_CONTRACT_TYPE:s CODE_GENDER:s FLAG_OWN_CAR:s FLAG_OWN_REALTY:s CNT_CHILDREN
AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE NAME_TYPE_SUITE:s NAME_INCOME_TYPE:s
NAME_EDUCATION_TYPE:s NAME_FAMILY_STATUS:s NAME_HOUSING_TYPE:s REGION_POPULATION_RELATIVE DAYS_BIRTH
DAYS_EMPLOYED DAYS_REGISTRATION DAYS_ID_PUBLISH OWN_CAR_AGE FLAG_MOBIL FLAG_EMP_PHONE FLAG_WORK_PHONE
FLAG_CONT_MOBILE FLAG_PHONE FLAG_EMAIL OCCUPATION_TYPE:s CNT_FAM_MEMBERS REGION_RATING_CLIENT
REGION_RATING_CLIENT_W_CITY WEEKDAY_APPR_PROCESS_START:s HOUR_APPR_PROCESS_START REG_REGION_NOT_LIVE_REGION
REG_REGION_NOT_WORK_REGION LIVE_REGION_NOT_WORK_REGION REG_CITY_NOT_LIVE_CITY REG_CITY_NOT_WORK_CITY
LIVE_CITY_NOT_WORK_CITY ORGANIZATION_TYPE:s EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3 APARTMENTS_AVG
BASEMENTAREA_AVG YEARS_BEGINEXPLUATATION_AVG YEARS_BUILD_AVG COMMONAREA_AVG ELEVATORS_AVG ENTRANCES_AVG
FLOORSMAX_AVG FLOORSMIN_AVG LANDAREA_AVG LIVINGAPARTMENTS_AVG LIVINGAREA_AVG NONLIVINGAPARTMENTS_AVG
NONLIVINGAREA_AVG APARTMENTS_MODE BASEMENTAREA_MODE YEARS_BEGINEXPLUATATION_MODE YEARS_BUILD_MODE
COMMONAREA_MODE ELEVATORS_MODE ENTRANCES_MODE FLOORSMAX_MODE FLOORSMIN_MODE LANDAREA_MODE
LIVINGAPARTMENTS_MODE LIVINGAREA_MODE NONLIVINGAPARTMENTS_MODE NONLIVINGAREA_MODE APARTMENTS_MEDI
BASEMENTAREA_MEDI YEARS_BEGINEXPLUATATION_MEDI YEARS_BUILD_MEDI COMMONAREA_MEDI ELEVATORS_MEDI
ENTRANCES_MEDI FLOORSMAX_MEDI FLOORSMIN_MEDI LANDAREA_MEDI LIVINGAPARTMENTS_MEDI LIVINGAREA_MEDI
NONLIVINGAPARTMENTS_MEDI NONLIVINGAREA_MEDI FONDKAPREMONT_MODE:s HOUSETYPE_MODE:s TOTALAREA_MODE
WALLSMATERIAL_MODE:s EMERGENCYSTATE_MODE:s OBS_30_CNT_SOCIAL_CIRCLE DEF_30_CNT_SOCIAL_CIRCLE
OBS_60_CNT_SOCIAL_CIRCLE DEF_60_CNT_SOCIAL_CIRCLE DAYS_LAST_PHONE_CHANGE FLAG_DOCUMENT_2 FLAG_DOCUMENT_3
FLAG_DOCUMENT_4 FLAG_DOCUMENT_5 FLAG_DOCUMENT_6 FLAG_DOCUMENT_7 FLAG_DOCUMENT_8 FLAG_DOCUMENT_9
FLAG_DOCUMENT_10 FLAG_DOCUMENT_11 FLAG_DOCUMENT_12 FLAG_DOCUMENT_13 FLAG_DOCUMENT_14 FLAG_DOCUMENT_15
FLAG_DOCUMENT_16 FLAG_DOCUMENT_17 FLAG_DOCUMENT_18 FLAG_DOCUMENT_19 FLAG_DOCUMENT_20 FLAG_DOCUMENT_21
AMT_REQ_CREDIT_BUREAU_HOUR AMT_REQ_CREDIT_BUREAU_DAY AMT_REQ_CREDIT_BUREAU_WEEK AMT_REQ_CREDIT_BUREAU_MON
AMT_REQ_CREDIT_BUREAU_QRT AMT_REQ_CREDIT_BUREAU_YEAR
"""

BUREAU_COLUMNS = """
SK_ID_CURR:id SK_ID_BUREAU:id CREDIT_ACTIVE:s CREDIT_CURRENCY:s DAYS_CREDIT CREDIT_DAY_OVERDUE
DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT AMT_CREDIT_MAX_OVERDUE CNT_CREDIT_PROLONG AMT_CREDIT_SUM
AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE CREDIT_TYPE:s DAYS_CREDIT_UPDATE AMT_ANNUITY
"""

BUREAU_BALANCE_COLUMNS = "SK_ID_BUREAU:id MONTHS_BALANCE STATUS:s"

CREDIT_CARD_BALANCE_COLUMNS = """
SK_ID_PREV:id SK_ID_CURR:id MONTHS_BALANCE AMT_BALANCE AMT_CREDIT_LIMIT_ACTUAL AMT_DRAWINGS_ATM_CURRENT
AMT_DRAWINGS_CURRENT AMT_DRAWINGS_OTHER_CURRENT AMT_DRAWINGS_POS_CURRENT AMT_INST_MIN_REGULARITY
AMT_PAYMENT_CURRENT AMT_PAYMENT_TOTAL_CURRENT AMT_RECEIVABLE_PRINCIPAL AMT_RECIVABLE AMT_TOTAL_RECEIVABLE
CNT_DRAWINGS_ATM_CURRENT CNT_DRAWINGS_CURRENT CNT_DRAWINGS_OTHER_CURRENT CNT_DRAWINGS_POS_CURRENT
CNT_INSTALMENT_MATURE_CUM NAME_CONTRACT_STATUS:s SK_DPD SK_DPD_DEF
"""

POS_CASH_BALANCE_COLUMNS = """
SK_ID_PREV:id SK_ID_CURR:id MONTHS_BALANCE CNT_INSTALMENT CNT_INSTALMENT_FUTURE NAME_CONTRACT_STATUS:s
SK_DPD SK_DPD_DEF
"""

PREVIOUS_APPLICATION_COLUMNS = """
SK_ID_PREV:id SK_ID_CURR:id NAME_CONTRACT_TYPE:s AMT_ANNUITY AMT_APPLICATION AMT_CREDIT AMT_DOWN_PAYMENT
AMT_GOODS_PRICE WEEKDAY_APPR_PROCESS_START:s HOUR_APPR_PROCESS_START FLAG_LAST_APPL_PER_CONTRACT:s
NFLAG_LAST_APPL_IN_DAY RATE_DOWN_PAYMENT RATE_INTEREST_PRIMARY RATE_INTEREST_PRIVILEGED
NAME_CASH_LOAN_PURPOSE:s NAME_CONTRACT_STATUS:s DAYS_DECISION NAME_PAYMENT_TYPE:s CODE_REJECT_REASON:s
NAME_TYPE_SUITE:s NAME_CLIENT_TYPE:s NAME_GOODS_CATEGORY:s NAME_PORTFOLIO:s NAME_PRODUCT_TYPE:s
CHANNEL_TYPE:s SELLERPLACE_AREA NAME_SELLER_INDUSTRY:s CNT_PAYMENT NAME_YIELD_GROUP:s
PRODUCT_COMBINATION:s DAYS_FIRST_DRAWING DAYS_FIRST_DUE DAYS_LAST_DUE_1ST_VERSION DAYS_LAST_DUE
DAYS_TERMINATION NFLAG_INSURED_ON_APPROVAL
"""

INSTALLMENTS_PAYMENTS_COLUMNS = """
SK_ID_PREV:id SK_ID_CURR:id NUM_INSTALMENT_VERSION NUM_INSTALMENT_NUMBER DAYS_INSTALMENT
DAYS_ENTRY_PAYMENT AMT_INSTALMENT AMT_PAYMENT
"""

# --- fixed values: the 170 model features, in model order ----------------
FEATURE_VIEW_NAMES = """
NAME_CONTRACT_TYPE CODE_GENDER FLAG_OWN_CAR FLAG_OWN_REALTY CNT_CHILDREN AMT_INCOME_TOTAL AMT_CREDIT
AMT_ANNUITY NAME_TYPE_SUITE NAME_INCOME_TYPE NAME_EDUCATION_TYPE NAME_FAMILY_STATUS NAME_HOUSING_TYPE
REGION_POPULATION_RELATIVE DAYS_BIRTH DAYS_EMPLOYED DAYS_REGISTRATION DAYS_ID_PUBLISH FLAG_MOBIL
FLAG_EMP_PHONE FLAG_WORK_PHONE FLAG_CONT_MOBILE FLAG_PHONE FLAG_EMAIL OCCUPATION_TYPE CNT_FAM_MEMBERS
REGION_RATING_CLIENT WEEKDAY_APPR_PROCESS_START HOUR_APPR_PROCESS_START REG_REGION_NOT_LIVE_REGION
REG_REGION_NOT_WORK_REGION LIVE_REGION_NOT_WORK_REGION REG_CITY_NOT_LIVE_CITY REG_CITY_NOT_WORK_CITY
LIVE_CITY_NOT_WORK_CITY ORGANIZATION_TYPE EXT_SOURCE_2 EXT_SOURCE_3 YEARS_BEGINEXPLUATATION_AVG
FLOORSMAX_AVG TOTALAREA_MODE EMERGENCYSTATE_MODE OBS_30_CNT_SOCIAL_CIRCLE DEF_30_CNT_SOCIAL_CIRCLE
DEF_60_CNT_SOCIAL_CIRCLE DAYS_LAST_PHONE_CHANGE FLAG_DOCUMENT_2 FLAG_DOCUMENT_3 FLAG_DOCUMENT_4
FLAG_DOCUMENT_5 FLAG_DOCUMENT_6 FLAG_DOCUMENT_7 FLAG_DOCUMENT_8 FLAG_DOCUMENT_9 FLAG_DOCUMENT_10
FLAG_DOCUMENT_11 FLAG_DOCUMENT_12 FLAG_DOCUMENT_13 FLAG_DOCUMENT_14 FLAG_DOCUMENT_15 FLAG_DOCUMENT_16
FLAG_DOCUMENT_17 FLAG_DOCUMENT_18 FLAG_DOCUMENT_19 FLAG_DOCUMENT_20 FLAG_DOCUMENT_21
AMT_REQ_CREDIT_BUREAU_HOUR AMT_REQ_CREDIT_BUREAU_DAY AMT_REQ_CREDIT_BUREAU_WEEK AMT_REQ_CREDIT_BUREAU_MON
AMT_REQ_CREDIT_BUREAU_QRT AMT_REQ_CREDIT_BUREAU_YEAR outlier_label outlier_score CREDIT_INCOME_RATIO
ANNUITY_INCOME_RATIO CREDIT_GOODS_RATIO ANNUITY_CREDIT_RATIO INCOME_PER_FAMILY_MEMBER CREDIT_PER_PERSON
EXT_SOURCE_MEAN EXT_SOURCE_MAX EXT_SOURCE_MIN EXT_SOURCE_STD DOCUMENT_COUNT CONTACT_COUNT
REGION_MISMATCH_COUNT BUREAU_DAYS_CREDIT_MEAN BUREAU_DAYS_CREDIT_MIN BUREAU_DAYS_CREDIT_MAX
BUREAU_CREDIT_DAY_OVERDUE_MEAN BUREAU_CREDIT_DAY_OVERDUE_MAX BUREAU_DAYS_CREDIT_ENDDATE_MEAN
BUREAU_DAYS_CREDIT_ENDDATE_MIN BUREAU_AMT_CREDIT_MAX_OVERDUE_MEAN BUREAU_AMT_CREDIT_SUM_MEAN
BUREAU_AMT_CREDIT_SUM_SUM BUREAU_AMT_CREDIT_SUM_MAX BUREAU_AMT_CREDIT_SUM_DEBT_MEAN
BUREAU_AMT_CREDIT_SUM_DEBT_SUM BUREAU_AMT_CREDIT_SUM_LIMIT_MEAN BUREAU_AMT_CREDIT_SUM_LIMIT_SUM
BUREAU_AMT_CREDIT_SUM_OVERDUE_MEAN BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM BUREAU_SK_ID_BUREAU_COUNT
BUREAU_ACTIVE_COUNT BUREAU_CREDIT_TYPE_COUNT PREV_AMT_ANNUITY_MEAN PREV_AMT_ANNUITY_MAX
PREV_AMT_ANNUITY_MIN PREV_AMT_APPLICATION_MEAN PREV_AMT_APPLICATION_MAX PREV_AMT_APPLICATION_SUM
PREV_AMT_DOWN_PAYMENT_MEAN PREV_AMT_DOWN_PAYMENT_MAX PREV_AMT_GOODS_PRICE_MEAN
PREV_HOUR_APPR_PROCESS_START_MEAN PREV_RATE_DOWN_PAYMENT_MEAN PREV_RATE_DOWN_PAYMENT_MAX
PREV_DAYS_DECISION_MEAN PREV_DAYS_DECISION_MIN PREV_CNT_PAYMENT_MEAN PREV_CNT_PAYMENT_SUM
PREV_SK_ID_PREV_COUNT PREV_APPROVED_COUNT PREV_CONTRACT_TYPE_COUNT PREV_APPROVAL_RATE
POS_MONTHS_BALANCE_MEAN POS_MONTHS_BALANCE_MAX POS_CNT_INSTALMENT_MEAN POS_CNT_INSTALMENT_SUM
POS_SK_DPD_MEAN POS_SK_DPD_MAX POS_SK_DPD_DEF_MEAN INST_AMT_INSTALMENT_MEAN INST_AMT_INSTALMENT_SUM
INST_AMT_INSTALMENT_MAX INST_PAYMENT_DIFF_MEAN INST_PAYMENT_DIFF_SUM INST_PAYMENT_RATIO_MEAN
INST_PAYMENT_RATIO_MIN INST_DAYS_DIFF_MEAN INST_DAYS_DIFF_MAX INST_LATE_PAYMENT_SUM
INST_LATE_PAYMENT_MEAN KNN_TARGET_MEAN_500 PREV_LAST3_AMT_CREDIT PREV_LAST3_AMT_ANNUITY
PREV_LAST3_DAYS_DECISION PREV_LAST3_APPROVAL_RATE PREV_LAST5_AMT_ANNUITY PREV_FIRST2_AMT_CREDIT
PREV_FIRST2_DAYS_DECISION PREV_FIRST4_AMT_CREDIT PAST_DUE_DAYS_PAST_DUE_MEAN PAST_DUE_DAYS_PAST_DUE_SUM
PAST_DUE_PAYMENT_RATIO_STD PAST_DUE_SEVERITY BUREAU_DEBT_CREDIT_RATIO BUREAU_CREDIT_UTILIZATION
AMT_CREDIT_div_EXT_SOURCE_3 AMT_ANNUITY_div_EXT_SOURCE_3 AMT_INCOME_TOTAL_div_EXT_SOURCE_3
ESTIMATED_TOTAL_PAYMENT ESTIMATED_INTEREST ESTIMATED_INTEREST_RATE ESTIMATED_YEARLY_RATE
DOWN_PAYMENT_AMT CREDIT_ANNUITY_YEARS INCOME_PER_YEAR_EMPLOYED
"""

# --- fixed values: text columns encoded to numeric codes -----------------
CATEGORICAL_COLUMNS = """
NAME_CONTRACT_TYPE CODE_GENDER FLAG_OWN_CAR FLAG_OWN_REALTY NAME_TYPE_SUITE NAME_INCOME_TYPE
NAME_EDUCATION_TYPE NAME_FAMILY_STATUS NAME_HOUSING_TYPE OCCUPATION_TYPE WEEKDAY_APPR_PROCESS_START
ORGANIZATION_TYPE FONDKAPREMONT_MODE HOUSETYPE_MODE WALLSMATERIAL_MODE EMERGENCYSTATE_MODE
""".split()

FEATURE_NAMES = FEATURE_VIEW_NAMES.split()
ENTITY_KEY = "SK_ID_CURR"
LABEL = "TARGET"
EVENT_TS = "event_timestamp"


def _struct(spec: str) -> T.StructType:
    fields = []
    for token in spec.split():
        name, _, kind = token.partition(":")
        dtype = {"s": T.StringType(), "id": T.LongType()}.get(kind, T.DoubleType())
        fields.append(T.StructField(name, dtype, True))
    return T.StructType(fields)


APPLICATION_TRAIN = _struct(APPLICATION_TRAIN_COLUMNS)
APPLICATION_TEST = T.StructType([f for f in APPLICATION_TRAIN.fields if f.name != LABEL])
BUREAU = _struct(BUREAU_COLUMNS)
BUREAU_BALANCE = _struct(BUREAU_BALANCE_COLUMNS)
CREDIT_CARD_BALANCE = _struct(CREDIT_CARD_BALANCE_COLUMNS)
POS_CASH_BALANCE = _struct(POS_CASH_BALANCE_COLUMNS)
PREVIOUS_APPLICATION = _struct(PREVIOUS_APPLICATION_COLUMNS)
INSTALLMENTS_PAYMENTS = _struct(INSTALLMENTS_PAYMENTS_COLUMNS)

RAW_TABLES = {
    "application_train": APPLICATION_TRAIN,
    "application_test": APPLICATION_TEST,
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
    "credit_card_balance": CREDIT_CARD_BALANCE,
    "pos_cash_balance": POS_CASH_BALANCE,
    "previous_application": PREVIOUS_APPLICATION,
    "installments_payments": INSTALLMENTS_PAYMENTS,
}


def feature_view_schema(names=None) -> T.StructType:
    """Published matrix: key, label, the features as double, event time."""
    names = FEATURE_NAMES if names is None else list(names)
    return T.StructType(
        [T.StructField(ENTITY_KEY, T.LongType(), False), T.StructField(LABEL, T.DoubleType(), True)]
        + [T.StructField(n, T.DoubleType(), True) for n in names]
        + [T.StructField(EVENT_TS, T.TimestampType(), True)]
    )
