"""Momentum, running sums, quantiles, folds and AUC; large groups in chunks."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from entitymill.operators.folds import assign_folds
from entitymill.operators.metrics import roc_auc
from entitymill.operators.momentum import Momentum, entity_features, momentum, row_changes
from entitymill.operators.ordered import group_quantiles, prefix_sums

SCHEMA = "k long, p long, o long, x double, y double, z double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    pick = lambda *v: rng.choice(v)
    out = []
    for i in range(2500):
        k = pick(1, 1, 1, 2, 3, 4, None, 5)
        x = None if k == 5 else pick(None, None, 0.0, 1.5, 2.0, -3.0, math.inf, 7.25)
        # z is known late and seldom, so that whole chunks carry a value over
        z = float(i) if i > 700 and i % 97 == 0 else None
        out.append((k, pick(1, 2, 3, 4, 5, 6), i, x, pick(None, 1.0, 4.0), z))
    out += [(9, 1, 0, 3.0, None, 1.0)]
    rng.shuffle(out)
    return out


def brute_momentum(rows, scope):
    p = pd.DataFrame([r for r in rows if r[0] is not None], columns=list("kpoxyz"))
    p = p.sort_values("o").astype({"x": float, "y": float, "z": float})
    last = p.groupby("k").p.transform("max")
    final = p.p == last if scope == "group" else p.p.isin(p.groupby("k").p.max().tolist())

    def mean(v):
        v = v.dropna()
        with np.errstate(invalid="ignore"):
            return v.sum() / len(v) if len(v) else np.nan

    out = {}
    for f in "xyz":
        known = p.groupby("k")[f].ffill()
        before = known.groupby(p.k).shift()
        with np.errstate(all="ignore"):
            changes = {"DIFF": p.groupby("k")[f].diff(), "PCT": known / before - 1}
        for name, c in changes.items():
            out[f"M_{f}_{name}_MEAN"] = c.groupby(p.k).apply(mean)
            out[f"M_{f}_{name}_FIN"] = c[final].groupby(p.k[final]).apply(mean)
    return pd.DataFrame(out).sort_index()


@pytest.mark.parametrize("scope", ["group", "global"])
@pytest.mark.parametrize("chunks", [None, 1, 40])
def test_momentum(spark, rows, scope, chunks):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    m = Momentum(["x", "y", "z"], "p", ["o"], "M_", scope)
    got = momentum(df, "k", m, chunks).toPandas().set_index("k").sort_index()
    want = brute_momentum(rows, scope)
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_forward_fill_example(spark):
    df = spark.createDataFrame(
        [(1, i, v) for i, v in enumerate([1.0, None, 3.0, 0.0, 2.0])], "k int, o int, x double"
    )
    for chunks in (1, 9):
        out = row_changes(df, "k", Momentum(["x"], "o", ["o"]), chunks).orderBy("o").collect()
        assert [r.x_DIFF for r in out] == [None, None, None, -3.0, 2.0]
        assert [r.x_PCT for r in out] == [None, 0.0, 2.0, -1.0, math.inf]


def test_statistics_and_momentum_together(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("z", "w")
    m = Momentum(["y"], "p", ["o"], "M_")
    spec = {"y": ["mean", "skew", "sum", "nunique"]}
    args = (df, "k", spec, m, "S_", {"L_": "p < 3"})
    whole = entity_features(*args).toPandas().set_index("k").sort_index()
    split = entity_features(*args, chunks=40).toPandas().set_index("k").sort_index()
    assert list(whole.columns) == list(split.columns)
    pd.testing.assert_frame_equal(whole, split)


def test_more_large_entities_than_chunks(spark):
    """1,200 entities, half of them over several chunks, against the window functions of pandas."""
    rows = [(k, 1, i, float((i * 37 + k) % 11 + 1), 1.0, 1.0) for k in range(1200) for i in range(1 + k % 40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = momentum(df, "k", Momentum(["x"], "p", ["o"], "M_"), chunks=1500).toPandas()
    got = got.set_index("k").sort_index()
    want = brute_momentum(rows, "group")[got.columns]
    pd.testing.assert_frame_equal(got, want)


def test_open_order_of_records_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 5, 1.0), (1, 1, 5, 2.0), (2, 1, 5, 1.0)], "k int, p int, o int, x double")
    with pytest.raises(Exception, match="order is open"):
        momentum(df, "k", Momentum(["x"], "p", ["o"])).collect()


def test_prefix_sums(spark):
    rows = [(g, i, float(i % 7)) for i in range(500) for g in ("a", "b", None)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(6)
    from pyspark.sql import functions as F

    got = prefix_sums(df, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}).toPandas()
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("o")
        assert part.n.tolist() == list(range(500))
        np.testing.assert_allclose(part.s, part.v.cumsum() - part.v)


@pytest.mark.parametrize("chunks", [None, 9])
def test_quantiles(spark, chunks):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "b"], 400), "v": rng.integers(0, 60, 400) / 4})
    pdf.loc[rng.random(400) < 0.1, "v"] = np.nan
    rows = [(g, None if np.isnan(v) else float(v)) for g, v in pdf.itertuples(index=False)]
    df = spark.createDataFrame([*rows, (None, 1.0), ("only", 2.0)], "g string, v double")
    levels = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = group_quantiles(df, ["g"], "v", levels, chunks).toPandas()
    for g in ("a", "b"):
        part = got[got.g == g].sort_values("level")
        np.testing.assert_allclose(part["quantile"], pdf[pdf.g == g].v.quantile(levels))
    assert got[got.g == "only"]["quantile"].tolist() == [2.0] * 5
    whole = group_quantiles(df, [], "v", levels).orderBy("level").toPandas()
    every = pd.Series([v for _, v in [*rows, (None, 1.0), ("only", 2.0)]]).quantile(levels)
    np.testing.assert_allclose(whole["quantile"], every)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + (diff == 0).sum() / 2) / (len(pos) * len(neg))


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 600), rng.integers(0, 40, 600) / 40
    g = rng.choice(["a", "b"], 600)
    rows = list(zip(g.tolist(), y.tolist(), s.tolist(), strict=True))
    df = spark.createDataFrame([*rows, ("c", 1, 0.5), ("a", None, 0.1)], "g string, y int, s double")
    got = {r.g: r.auc for r in roc_auc(df.repartition(9), "y", "s", ["g"]).collect()}
    assert got["c"] is None
    for name in ("a", "b"):
        assert got[name] == pytest.approx(brute_auc(y[g == name], s[g == name]), abs=1e-12)
    all_y, all_s = np.append(y, 1), np.append(s, 0.5)
    assert roc_auc(df, "y", "s").first().auc == pytest.approx(brute_auc(all_y, all_s), abs=1e-12)


@pytest.mark.parametrize("label", ["y", None])
def test_folds_are_balanced_and_stable(spark, label):
    df = spark.range(1003).selectExpr("id", "int(id % 10 = 0) as y")
    a = assign_folds(df, 5, "id", label).toPandas().sort_values("id").reset_index(drop=True)
    b = assign_folds(df.repartition(7), 5, "id", label).toPandas().sort_values("id")
    pd.testing.assert_frame_equal(a, b.reset_index(drop=True))
    sizes = a.groupby([label, "fold"] if label else "fold").size()
    for _, part in sizes.groupby(level=0) if label else [(0, sizes)]:
        assert part.max() - part.min() <= 1 and len(part) == 5
    other = assign_folds(df, 5, "id", label, seed=1).toPandas().sort_values("id")
    assert (other.fold.to_numpy() != a.fold.to_numpy()).any()
    rough = assign_folds(df, 5, "id", approx=True).groupBy("fold").count().collect()
    assert sorted(r.fold for r in rough) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("chunks", [None, 4])
def test_row_changes_refuse_tied_orders(spark, chunks):
    df = spark.createDataFrame([(1, 5, 10.0), (1, 5, 20.0), (2, 5, 1.0)], "k int, o int, x double")
    with pytest.raises(Exception, match="their order is open"):
        row_changes(df, "k", Momentum(["x"], "o", ["o"]), chunks).collect()
    assert row_changes(df.where("x <> 20"), "k", Momentum(["x"], "o", ["o"]), chunks).count() == 2
