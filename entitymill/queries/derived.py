"""The seven input tables of the feature plans, derived from shipped tables.

Expressions read alike in Spark SQL and in the checking SQL. Every table is
used whole; missing values, zeros and sentinels depend on row values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from entitymill.plans.schemas import CARD_AMOUNTS, CARD_COUNTS, DOCUMENT_FLAGS
from entitymill.queries.base import cte, frame


def days(column: str) -> str:
    """A day number below zero, in plain arithmetic."""
    return (
        f"(extract(month from {column}) * 30 + extract(day from {column})"
        f" - (2000 - extract(year from {column})) * 365)"
    )


def as_double(columns: dict[str, str]) -> dict[str, str]:
    return {c: f"cast({e} as double)" for c, e in columns.items()}


APPLICATION = {
    "SK_ID_CURR": "c_custkey",
    "TARGET": "cast(case when c_mktsegment = 'BUILDING' then null when c_acctbal < 1500 then 1"
    " else 0 end as double)",
    "CODE_GENDER": "case when c_nationkey = 24 then 'XNA' when c_nationkey < 10 then 'M' else 'F' end",
    "FLAG_OWN_CAR": "case when c_acctbal > 3000 then 'Y' else 'N' end",
    "FLAG_OWN_REALTY": "case when c_nationkey = 3 then null when c_acctbal > 6000 then 'N' else 'Y' end",
    "FLAG_MOBIL": "1",
    "FLAG_PHONE": "case when c_acctbal > 2000 then 1 else 0 end",
    "HAS_FLAG_WORK": "case when c_acctbal > 4000 then 1 else 0 end",
    **{
        c: f"case when c_nationkey = {i} or c_acctbal > {700 * i} then 1 else 0 end"
        for i, c in enumerate(DOCUMENT_FLAGS, 2)
    },
    "NAME_FAMILY_STATUS": "case when c_mktsegment = 'MACHINERY' then 'Unknown' else c_mktsegment end",
    "ORGANIZATION_TYPE": "case when c_nationkey = 5 then 'XNA' when c_nationkey < 12 then"
    " 'Trade: type ' || cast(c_nationkey as string) else 'Other' end",
    "NAME_TYPE_SUITE": "case when c_nationkey < 8 then 'Spouse, partner' when c_nationkey < 16 then"
    " 'a.b' end",
    **as_double({
        "DAYS_EMPLOYED": "case when c_nationkey = 6 then 365243 when c_nationkey = 7 then 0"
        " else -floor(abs(c_acctbal)) end",
        "DAYS_BIRTH": "-7000 - abs(c_acctbal) * 1.5",
        "DAYS_LAST_PHONE_CHANGE": "case when c_nationkey = 8 then 0 else -100 * (c_nationkey + 1) end",
        "AMT_INCOME_TOTAL": "30000 + c_acctbal * 3",
        "AMT_CREDIT": "100000 + c_acctbal * 20",
        "AMT_ANNUITY": "case when c_nationkey = 9 then null when c_nationkey = 10 then 0"
        " else 5000 + c_acctbal end",
        "AMT_GOODS_PRICE": "case when c_nationkey = 11 then null else 90000 + c_acctbal * 18 end",
        "CNT_CHILDREN": "case when c_nationkey < 5 then c_nationkey else 0 end",
        "CNT_FAM_MEMBERS": "case when c_nationkey = 12 then null when c_nationkey < 5 then"
        " c_nationkey else 2 end",
        "EXT_SOURCE_1": "case when c_mktsegment = 'AUTOMOBILE' then null when c_nationkey = 13 then 0"
        " else (c_acctbal + 1000) / 12000 end",
        "EXT_SOURCE_2": "case when c_nationkey = 14 then null else (c_acctbal + 2000) / 13000 end",
        "EXT_SOURCE_3": "case when c_mktsegment in ('AUTOMOBILE', 'HOUSEHOLD') then null"
        " else abs(c_acctbal) / 10000 end",
        "OWN_CAR_AGE": "case when c_acctbal > 3000 then c_nationkey end",
    }),
}

ORDER_DAY = days("o_orderdate")
BUREAU = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_BUREAU": "o_orderkey",
    "CREDIT_ACTIVE": "case when o_orderstatus = 'F' then 'Closed' when o_orderstatus = 'O' then"
    " 'Active' when o_orderpriority <> '5-LOW' then 'Sold' end",
    "CREDIT_TYPE": "o_orderpriority",
    **as_double({
        "DAYS_CREDIT": ORDER_DAY,
        "DAYS_CREDIT_ENDDATE": "case when o_orderpriority = '1-URGENT' then null when"
        f" o_orderpriority = '2-HIGH' then -41000 else {ORDER_DAY} + o_totalprice / 100 end",
        "DAYS_CREDIT_UPDATE": "case when o_orderpriority = '3-MEDIUM' then -50000"
        f" else {ORDER_DAY} * 0.5 end",
        "DAYS_ENDDATE_FACT": f"case when o_orderstatus <> 'O' then {ORDER_DAY} + 100 end",
        "CREDIT_DAY_OVERDUE": "case when o_orderpriority = '5-LOW' then 30 else 0 end",
        "AMT_CREDIT_SUM": "case when o_orderpriority <> '4-NOT SPECIFIED' then o_totalprice end",
        "AMT_CREDIT_SUM_DEBT": "case when o_orderstatus = 'F' then 0 when o_orderpriority ="
        " '1-URGENT' then null else o_totalprice / 2 end",
        "AMT_CREDIT_SUM_OVERDUE": "case when o_orderpriority = '5-LOW' then o_totalprice / 10 when"
        " o_orderstatus = 'P' then null else 0 end",
        "CNT_CREDIT_PROLONG": "case when o_orderpriority = '2-HIGH' then null when"
        " o_orderstatus = 'O' then 1 else 0 end",
        "AMT_CREDIT_SUM_LIMIT": "case when o_orderpriority = '2-HIGH' then 0 when"
        " o_orderstatus = 'P' then null else o_totalprice * 0.3 end",
        "AMT_CREDIT_MAX_OVERDUE": "case when o_orderpriority <> '3-MEDIUM' then o_totalprice / 20 end",
        "AMT_ANNUITY": "case when o_orderpriority = '1-URGENT' then 0 else o_totalprice / 12 end",
    }),
}
BUREAU_BALANCE = {
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": "-l_linenumber",
    "STATUS": "case when l_returnflag <> 'N' then l_returnflag end",
}

PREVIOUS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_PREV": "o_orderkey",
    "NAME_CONTRACT_STATUS": "case when o_orderstatus = 'F' then 'Approved' when o_orderstatus = 'O'"
    " then 'Refused' else 'Canceled' end",
    "NAME_CONTRACT_TYPE": "case when o_orderpriority <> '5-LOW' then o_orderpriority end",
    **as_double({
        "AMT_ANNUITY": "case when o_orderpriority <> '1-URGENT' then o_totalprice / 12 end",
        "AMT_APPLICATION": "o_totalprice",
        "AMT_CREDIT": "case when o_orderpriority = '2-HIGH' then 0 else o_totalprice * 1.1 end",
        "AMT_DOWN_PAYMENT": "case when o_orderstatus <> 'P' then o_totalprice / 10 end",
        "AMT_GOODS_PRICE": "case when o_orderpriority = '3-MEDIUM' then 0 else o_totalprice * 0.95 end",
        "HOUR_APPR_PROCESS_START": "extract(day from o_orderdate)",
        "RATE_DOWN_PAYMENT": "case when o_orderpriority <> '5-LOW' then o_totalprice / 1000000 end",
        "RATE_INTEREST_PRIMARY": "case when o_orderstatus = 'F' then o_totalprice / 2000000 end",
        "RATE_INTEREST_PRIVILEGED": "case when o_orderstatus = 'O' then o_totalprice / 3000000 end",
        "DAYS_DECISION": ORDER_DAY,
        "CNT_PAYMENT": "case when o_orderpriority = '4-NOT SPECIFIED' then 0"
        " else extract(month from o_orderdate) end",
        "DAYS_FIRST_DRAWING": f"case when o_orderstatus = 'O' then 365243 else {ORDER_DAY} + 10 end",
        "DAYS_FIRST_DUE": f"case when o_orderpriority = '1-URGENT' then 365243 else {ORDER_DAY} + 30 end",
        "DAYS_LAST_DUE_1ST_VERSION": f"case when o_orderstatus = 'P' then 365243 else {ORDER_DAY} + 300 end",
        "DAYS_LAST_DUE": f"case when o_orderpriority = '2-HIGH' then 365243 else {ORDER_DAY} + 200 end",
        "DAYS_TERMINATION": f"case when o_orderstatus <> 'O' then {ORDER_DAY} + 210 end",
    }),
}

LINE_DAY = days("l_shipdate")
LINE_ORDER = {
    "ROW_DAY": "l_shipdate", "ROW_ORDER": "l_orderkey", "ROW_LINE": "l_linenumber",
    "ROW_PART": "l_partkey",
}
POS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_PREV": "l_orderkey",
    "NAME_CONTRACT_STATUS": "case when l_returnflag = 'A' then 'Completed' when l_returnflag = 'R'"
    " then 'Active' end",
    **LINE_ORDER,
    **as_double({
        "SK_DPD": "case when l_tax > 0.05 then l_quantity else 0 end",
        "SK_DPD_DEF": "case when l_discount > 0.08 then 5 when l_returnflag = 'N' then null else 0 end",
        "MONTHS_BALANCE": "-l_linenumber - extract(month from l_shipdate)",
        "CNT_INSTALMENT_FUTURE": "case when l_returnflag = 'R' then null else l_quantity - 1 end",
        "CNT_INSTALMENT": "case when l_discount = 0 then 0 else l_quantity + 6 end",
    }),
}
INSTALMENTS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_PREV": "l_orderkey",
    **LINE_ORDER,
    **as_double({
        "AMT_PAYMENT": "case when l_returnflag <> 'R' then l_extendedprice * (1 - l_discount) end",
        "AMT_INSTALMENT": "case when l_tax = 0 then 0 else l_extendedprice end",
        "DAYS_ENTRY_PAYMENT": f"case when l_returnflag <> 'R' then {LINE_DAY} end",
        "DAYS_INSTALMENT": f"{LINE_DAY} + l_quantity - 25",
        "NUM_INSTALMENT_VERSION": "case when l_discount = 0 then 0 else l_linenumber end",
        "NUM_INSTALMENT_NUMBER": "l_linenumber",
    }),
}
LINES_JOIN = "lineitem join orders on l_orderkey = o_orderkey"

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _card_column(i: int) -> str:
    """Amounts and counts with gaps, zeros and a few negative values."""
    value = f"value * {i + 1} - 20"
    if i % 3 == 1:
        return f"case when event_type = 'click' then null else {value} end"
    if i % 3 == 2:
        return f"case when event_type = 'purchase' then 0 else {value} end"
    return value


CARD = {
    "SK_ID_CURR": "user_id",
    "SK_ID_PREV": "event_id",
    "NAME_CONTRACT_STATUS": "event_type",
    "ROW_TIME": "ts",
    **as_double({
        "MONTHS_BALANCE": "-extract(day from ts)",
        **{c: _card_column(i) for i, c in enumerate([*CARD_AMOUNTS, *CARD_COUNTS])},
        "SK_DPD": "case when value > 300 then value else 0 end",
        "SK_DPD_DEF": "case when value > 450 then 1 else 0 end",
    }),
}

ORDERS = {
    "pos_cash": tuple(LINE_ORDER),
    "instalments": tuple(LINE_ORDER),
    "credit_card": ("ROW_TIME", "SK_ID_PREV"),
}

SQL = {
    "application": cte("customer", APPLICATION),
    "bureau": cte("orders", BUREAU),
    "bureau_balance": cte("lineitem", BUREAU_BALANCE),
    "previous_application": cte("orders", PREVIOUS),
    "pos_cash": cte(LINES_JOIN, POS),
    "instalments": cte(LINES_JOIN, INSTALMENTS),
    "credit_card": cte("events", CARD),
}


def tables(t) -> dict:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "application": frame(t.customer, APPLICATION),
        "bureau": frame(t.orders, BUREAU),
        "bureau_balance": frame(t.lineitem, BUREAU_BALANCE),
        "previous_application": frame(t.orders, PREVIOUS),
        "pos_cash": frame(lines, POS),
        "instalments": frame(lines, INSTALMENTS),
        "credit_card": frame(t.events, CARD),
    }
