"""Group statistics, shares, subsets and roll-ups against brute force."""

import math

import numpy as np
import pandas as pd

from entitymill.operators.aggregate import (
    by_stats,
    entity_agg,
    mean_ratio,
    null_shares,
    two_level,
)
from entitymill.operators.encode import MISSING, factorize, find_categories, one_hot

STATS = "mean sum min max var std skew size nunique"


def fixture_rows():
    rng = np.random.default_rng(3)
    rows = [("one", 5.0, "a"), ("const", 1.1, "a"), ("const", 1.1, "b"), ("const", 1.1, None)]
    rows += [("two", 1.0, "b"), ("two", 4.0, "b"), ("none", None, "a"), ("none", None, None)]
    rows += [(None, 9.0, "a")]
    rows += [
        ("many", None if rng.random() < 0.2 else float(rng.exponential()), rng.choice(["a", "b"]))
        for _ in range(300)
    ]
    return [(k, x, None if c is None else str(c)) for k, x, c in rows]


def brute(pdf: pd.DataFrame) -> pd.DataFrame:
    g = pdf[pdf.k.notna()].groupby("k").x
    out = pd.DataFrame({
        "x_MEAN": g.mean(), "x_SUM": g.sum(), "x_MIN": g.min(), "x_MAX": g.max(),
        "x_VAR": g.var(), "x_STD": g.std(), "x_SIZE": g.size(), "x_NUNIQUE": g.nunique(),
        "x_SKEW": g.apply(lambda v: v.skew()),
    })
    return out.sort_index()


def test_every_statistic(spark):
    rows = fixture_rows()
    df = spark.createDataFrame(rows, "k string, x double, c string").repartition(7)
    got = entity_agg(df, "k", {"x": STATS.split()}).toPandas().set_index("k").sort_index()
    want = brute(pd.DataFrame(rows, columns=["k", "x", "c"]))
    assert list(got.index) == list(want.index)
    for c in want.columns:
        np.testing.assert_allclose(
            got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c
        )


def test_infinite_values(spark):
    inf = math.inf
    rows = [("a", inf), ("a", 1.0), ("a", 2.0), ("b", inf), ("b", -inf), ("b", 0.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    spec = {"x": "mean sum min max var skew".split()}
    a, b = entity_agg(df, "k", spec).orderBy("k").collect()
    assert (a.x_MEAN, a.x_SUM, a.x_MIN, a.x_MAX) == (inf, inf, 1.0, inf)
    assert (a.x_VAR, a.x_SKEW) == (None, None)
    assert (b.x_MEAN, b.x_SUM, b.x_MIN, b.x_MAX) == (None, None, -inf, inf)


def test_subset_without_rows_is_missing(spark):
    rows = [("p", 1.0, "a"), ("p", None, "b"), ("q", 2.0, "a")]
    df = spark.createDataFrame(rows, "k string, x double, c string")
    spec = {"x": ["sum", "size", "mean", "nunique"]}
    out = entity_agg(df, "k", spec, "", {"B_": "c = 'b'"}).orderBy("k").collect()
    p, q = out
    assert (p.B_x_SUM, p.B_x_SIZE, p.B_x_MEAN, p.B_x_NUNIQUE) == (0.0, 1.0, None, 0.0)
    assert (q.B_x_SUM, q.B_x_SIZE, q.B_x_MEAN, q.B_x_NUNIQUE) == (None, None, None, None)


def test_category_shares_count_all_rows(spark):
    rows = [("p", "a"), ("p", "it's"), ("p", None), ("p", "a")]
    df = spark.createDataFrame(rows, "k string, c string")
    found = find_categories(df, ["c"])
    assert found == {"c": ["a", "it's", MISSING]}
    row = entity_agg(df, "k", {}, "P_", categories=found).first().asDict()
    assert row == {"k": "p", "P_c_a_MEAN": 0.5, "P_c_it's_MEAN": 0.25, "P_c_nan_MEAN": 0.25}


def test_two_level(spark):
    child = spark.createDataFrame([(1, 2.0, "x"), (1, 4.0, None), (2, 6.0, "x")],
                                  "loan int, v double, s string")
    parent = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (3, "q")], "loan int, k string")
    out = two_level(child, parent, "loan", "k", {"v": ["max", "size"]},
                    {"v_MAX": ["mean"], "v_SIZE": ["sum"]},
                    child_categories={"s": ["x"]}).orderBy("k").collect()
    assert [tuple(r) for r in out] == [("p", 5.0, 3.0, 0.75), ("q", None, 0.0, None)]


def test_null_shares_and_mean_ratio(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 0.0)], "a double, b double")
    shares = {r.feature: r.null_share for r in null_shares(df).collect()}
    assert shares == {"a": 0.0, "b": 0.5}
    assert mean_ratio(df, "b", "a") == 0.0
    assert mean_ratio(df.filter("a < 0"), "a", "b") == 0.5


def test_by_stats():
    assert by_stats({"min max": ["a"], "mean": ["b"]}) == {"a": ["min", "max"], "b": ["mean"]}


def test_one_hot_and_factorize(spark):
    rows = [(1, "b", None), (2, "a", "x"), (3, None, "x"), (4, "b", "y")]
    df = spark.createDataFrame(rows, "id int, c string, d string")
    encoded, new = one_hot(df)
    assert new == ["c_a", "c_b", "c_nan", "d_x", "d_y", "d_nan"]
    third = encoded.filter("id = 3").first()
    assert (third.c_a, third.c_b, third.c_nan, third.d_x) == (0, 0, 1, 1)
    fixed, new = one_hot(df, categories={"c": ["a", "z"]})
    assert new == ["c_a", "c_z"] and "d" in fixed.columns
    for chunks in (None, 5):
        coded = factorize(df, ["c", "d"], ["id"], chunks).orderBy("id").collect()
        assert [(r.c, r.d) for r in coded] == [(0, -1), (1, 0), (-1, 0), (0, 1)]
