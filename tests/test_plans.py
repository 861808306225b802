"""Feature plans: edge cases, large applicants, and the shape of Spark's plans."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from entitymill.operators.aggregate import entity_agg
from entitymill.operators.momentum import Momentum, entity_features, momentum
from entitymill.plans import application as ap
from entitymill.plans import histories as h
from entitymill.plans import matrix as mx
from entitymill.plans import schemas
from entitymill.queries import Tables, derived

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return derived.tables(Tables(spark, FOLDER))


def by_key(df):
    return df.toPandas().set_index("SK_ID_CURR").sort_index()


def test_widths():
    """Numbers of named features per plan."""
    size = lambda spec: sum(len(s) for s in spec.values())
    assert size(h.BUREAU_SPEC) * 3 + 1 + 4 * len(h.BUREAU_MOMENTUM) == 268
    assert size(h.PREVIOUS_SPEC) * 3 + 4 * len(h.PREVIOUS_MOMENTUM) == 339
    assert size(h.POS_SPEC) + 1 + 4 * len(h.POS_MOMENTUM) == 37
    assert size(h.INSTALMENT_SPEC) + 1 + 4 * len(h.INSTALMENT_MOMENTUM) == 48
    assert size(h.CARD_SPEC) + 1 + 4 * len(h.CARD_MOMENTUM) == 207


def test_application_has_all_new_features(tables):
    out = ap.application_features(tables["application"])
    assert sum(c.startswith("NEW_") for c in out.columns) == 84
    assert "FLAG_DOCUMENT_3" in out.columns and "FLAG_DOCUMENT_4" not in out.columns
    assert "NAME_TYPE_SUITE_Spouse, partner" in out.columns
    assert not [c for c, t in out.dtypes if t == "string"]


@pytest.mark.parametrize("plan", ["bureau", "pos", "instalments"])
def test_large_applicants_get_the_same_features(tables, plan):
    run = {
        "bureau": lambda n: h.bureau_features(
            tables["bureau"], tables["bureau_balance"], chunks=n
        ),
        "pos": lambda n: h.pos_features(
            tables["pos_cash"], derived.ORDERS["pos_cash"], chunks=n
        ),
        "instalments": lambda n: h.instalment_features(
            tables["instalments"], derived.ORDERS["instalments"], chunks=n
        ),
    }[plan]
    whole, split = by_key(run(1)), by_key(run(40))
    pd.testing.assert_frame_equal(whole, split[whole.columns], rtol=1e-8, atol=1e-8)


def test_statuses_that_do_not_occur(spark):
    bureau = spark.createDataFrame(
        [(1, 10, "Sold"), (1, 11, None)], "SK_ID_CURR bigint, SK_ID_BUREAU bigint, CREDIT_ACTIVE string"
    )
    numbers = [f.split("` ")[0].strip(" `") for f in schemas.BUREAU.split(", ")]
    for c in numbers:
        if c not in bureau.columns:
            bureau = bureau.withColumn(c, F.lit(3.0))
    balance = spark.createDataFrame([], schemas.BUREAU_BALANCE)
    row = h.bureau_features(bureau, balance).first()
    assert row["ACTIVE_DAYS_CREDIT_MEAN"] is None and row["CLOSED_AMT_CREDIT_SUM_SUM"] is None
    assert row["BURO_DAYS_CREDIT_MEAN"] == 3.0 and row["BURO_MONTHS_BALANCE_SIZE_SUM"] == 0.0
    assert row["BURO_CREDIT_ACTIVE_CLOSED_RATIO"] is None
    assert row["BURO_CREDIT_ACTIVE_nan_MEAN"] == 0.5


def test_final_account_scopes_differ_only_for_shared_accounts(spark):
    rows = [(1, 5, 1, 1.0), (1, 7, 2, 4.0), (2, 5, 1, 2.0), (2, 5, 2, 9.0)]
    df = spark.createDataFrame(rows, "k int, p int, o int, x double")
    fin = {
        s: [r.x_DIFF_FIN for r in momentum(df, "k", Momentum(["x"], "p", ["o"], "", s)).orderBy("k").collect()]
        for s in ("group", "global")
    }
    assert fin == {"group": [3.0, 7.0], "global": [3.0, 7.0]}
    more = df.union(spark.createDataFrame([(1, 5, 3, 5.0)], df.schema))
    out = momentum(more, "k", Momentum(["x"], "p", ["o"], "", "global")).orderBy("k").collect()
    assert out[0].x_DIFF_FIN == 2.0  # account 5 is the other applicant's latest


def test_amount_factor_modes(spark):
    now = spark.createDataFrame(
        [(1, 10.0), (2, 5.0), (3, None), (4, 0.0)], "SK_ID_CURR int, AMT_CREDIT double"
    )
    past = spark.createDataFrame(
        [(1, 4.0), (1, 8.0), (4, 1.0)], "SK_ID_CURR int, AMT_CREDIT double"
    )
    run = lambda mode: [
        r[1] for r in mx.amount_factors(now, past, mode, ["AMT_CREDIT"]).orderBy("SK_ID_CURR").collect()
    ]
    share = 8**0.5 / 6
    assert run("intended") == pytest.approx([(10 - 6) / 8**0.5, 0.0, None, -1 / share])
    assert run("reference") == [0.0, 0.0, None, None]
    with pytest.raises(ValueError):
        run("other")


def test_matrix_keeps_every_application(spark, tables):
    out = mx.feature_matrix(tables, derived.ORDERS, stage=True)
    kept = tables["application"].filter("CODE_GENDER <> 'XNA'").count()
    assert out.count() == kept
    assert len(out.columns) == len(set(out.columns)) > 1000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_shuffled_once(tables):
    df = entity_features(
        h.pos_rows(tables["pos_cash"].withColumnRenamed("ROW_DAY", "DAY")),
        "SK_ID_CURR",
        h.POS_SPEC,
        Momentum(h.POS_MOMENTUM, "SK_ID_PREV", ["DAY", "ROW_ORDER", "ROW_LINE", "ROW_PART"]),
    )
    plan = plan_of(df)
    # The chunks are written; from there statistics move as partial results, and only
    # what momentum follows moves as records.
    assert "rangepartitioning" not in plan
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert sorted(x.count("_chunk") for x in moved) == [0, 0, 1]
    assert not any("SK_DPD" in x for x in moved)
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_subsets_share_one_scan(tables):
    subsets = {"A_": "CREDIT_ACTIVE = 'Active'", "C_": "CREDIT_ACTIVE = 'Closed'"}
    spec = {"AMT_CREDIT_SUM": ["mean", "skew"]}
    plan = plan_of(entity_agg(tables["bureau"], "SK_ID_CURR", spec, "B_", subsets))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "o_orderpriority" in plan and "o_shippriority" not in plan


def test_row_level_ratios_are_neither_shuffled_nor_written(tables, monkeypatch):
    from entitymill.operators import momentum as mo

    seen, chunked = [], mo.chunk_by_order
    monkeypatch.setattr(mo, "chunk_by_order", lambda df, *more: seen.append(df.columns) or chunked(df, *more))
    out = h.card_features(tables["credit_card"], derived.ORDERS["credit_card"])
    h.instalment_features(tables["instalments"], derived.ORDERS["instalments"])
    assert "CC_BALANCE_TO_LIMIT_RATIO_VAR" in out.columns
    assert len(seen) == 2 and not {*h.CARD_RATIOS, *h.instalment_derived()}.intersection(*map(set, [sum(seen, [])]))


def test_derived_columns_may_order_records(spark):
    rows = [(1, 1, 5.0), (1, 2, 3.0), (1, 3, 9.0)]
    df = spark.createDataFrame(rows, "k long, a long, x double")
    m = Momentum(["x"], "a", ["back"])
    out = entity_features(df, "k", {"back": ["max"]}, m, derived={"back": -F.col("a")}).first()
    assert (out["back_MAX"], out["x_DIFF_MEAN"]) == (-1, -2.0)
