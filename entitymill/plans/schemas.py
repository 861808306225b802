"""Columns the feature plans read, per input table.

Fixed values. Tables may carry further columns; further text columns are
encoded like the named ones.
"""

from __future__ import annotations


def _ddl(**types: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for t, cols in types.items() for c in cols)


DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]

APPLICATION = _ddl(
    bigint=["SK_ID_CURR"],
    int=["TARGET", *DOCUMENT_FLAGS],
    string=[
        "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_FAMILY_STATUS",
        "ORGANIZATION_TYPE",
    ],
    double=[
        "DAYS_EMPLOYED", "DAYS_BIRTH", "DAYS_LAST_PHONE_CHANGE", "AMT_INCOME_TOTAL",
        "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_CHILDREN", "CNT_FAM_MEMBERS",
        "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "OWN_CAR_AGE",
    ],
)
BUREAU = _ddl(
    bigint=["SK_ID_CURR", "SK_ID_BUREAU"],
    string=["CREDIT_ACTIVE"],
    double=[
        "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE", "DAYS_ENDDATE_FACT",
        "CREDIT_DAY_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE",
        "CNT_CREDIT_PROLONG", "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_MAX_OVERDUE", "AMT_ANNUITY",
    ],
)
BUREAU_BALANCE = _ddl(
    bigint=["SK_ID_BUREAU"],
    int=["MONTHS_BALANCE"],
    string=["STATUS"],
)
PREVIOUS = _ddl(
    bigint=["SK_ID_CURR", "SK_ID_PREV"],
    string=["NAME_CONTRACT_STATUS"],
    double=[
        "AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE",
        "HOUR_APPR_PROCESS_START", "RATE_DOWN_PAYMENT", "RATE_INTEREST_PRIMARY",
        "RATE_INTEREST_PRIVILEGED", "DAYS_DECISION", "CNT_PAYMENT", "DAYS_FIRST_DRAWING",
        "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION",
    ],
)
POS_CASH = _ddl(
    bigint=["SK_ID_CURR", "SK_ID_PREV"],
    string=["NAME_CONTRACT_STATUS"],
    double=[
        "SK_DPD", "SK_DPD_DEF", "MONTHS_BALANCE", "CNT_INSTALMENT_FUTURE", "CNT_INSTALMENT",
    ],
)
INSTALMENTS = _ddl(
    bigint=["SK_ID_CURR", "SK_ID_PREV"],
    double=[
        "AMT_PAYMENT", "AMT_INSTALMENT", "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT",
        "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER",
    ],
)
CARD_AMOUNTS = [
    "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT",
    "AMT_DRAWINGS_CURRENT", "AMT_DRAWINGS_OTHER_CURRENT", "AMT_DRAWINGS_POS_CURRENT",
    "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT",
    "AMT_RECEIVABLE_PRINCIPAL", "AMT_RECIVABLE", "AMT_TOTAL_RECEIVABLE",
]
CARD_COUNTS = [
    "CNT_DRAWINGS_ATM_CURRENT", "CNT_DRAWINGS_CURRENT", "CNT_DRAWINGS_OTHER_CURRENT",
    "CNT_DRAWINGS_POS_CURRENT", "CNT_INSTALMENT_MATURE_CUM",
]
CREDIT_CARD = _ddl(
    bigint=["SK_ID_CURR", "SK_ID_PREV"],
    double=["MONTHS_BALANCE", *CARD_AMOUNTS, *CARD_COUNTS, "SK_DPD", "SK_DPD_DEF"],
)
