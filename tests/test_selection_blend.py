"""Column selection, blending and thresholds against brute force."""

import numpy as np
import pandas as pd
import pytest
from test_ordered import brute_auc

from entitymill.operators import blend as bl
from entitymill.operators.metrics import roc_auc_value
from entitymill.operators.attach import append_unlabelled, top_features
from entitymill.operators.select import (
    correlated_columns,
    correlation_matrix,
    missing_columns,
    select_features,
)


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(4)
    x = rng.normal(100, 3, size=(400, 6))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.01, 400)
    x[:, 3] = 7.0
    x[rng.random((400, 6)) < 0.2] = np.nan
    x[rng.random(400) < 0.9, 5] = np.nan
    x[3, 4] = np.inf
    return pd.DataFrame(x, columns=["a", "b", "c", "flat", "edge", "rare"])


def to_spark(spark, pdf):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))


def test_pairwise_correlation(spark, wide):
    df = to_spark(spark, wide)
    got = correlation_matrix(df, df.columns)
    with np.errstate(invalid="ignore"):
        want = wide.corr().to_numpy()
    finite = ["a", "b", "c", "rare"]
    at = [wide.columns.get_loc(c) for c in finite]
    np.testing.assert_allclose(got[np.ix_(at, at)], want[np.ix_(at, at)], atol=1e-9)
    assert np.isnan(got[3]).all()
    for other in (0, 1, 2):  # an infinite value spoils the pairs it is part of
        assert np.isnan(got[4, other]) == wide.iloc[3, [other]].notna().all()


def test_select(spark, wide):
    df = to_spark(spark, wide).withColumnRenamed("flat", "TARGET_x")
    assert correlated_columns(df, 0.9) == ["b"]
    assert missing_columns(df, 0.75) == ["rare"]
    assert missing_columns(df, 0.1)[0] == "rare" and "TARGET_x" not in missing_columns(df, 0.1)
    assert select_features(df).columns == ["a", "c", "TARGET_x", "edge"]


def test_top_features(spark):
    rows = [(f"f{i}", float(i + fold), fold) for i in range(5) for fold in (1, 2)]
    df = spark.createDataFrame(rows, "feature string, importance double, fold int")
    assert {r.feature for r in top_features(df, 2).collect()} == {"f3", "f4"}


def test_append_unlabelled(spark):
    train = spark.createDataFrame([(1, 0.5, 1)], "id int, x double, TARGET int")
    test = spark.createDataFrame([(2, 0.7)], "id int, x double")
    out = append_unlabelled(train, test).orderBy("id").collect()
    assert [r.TARGET for r in out] == [1, None]


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    s = np.round(np.clip(rng.beta(2, 3, 300) + 0.1 * y, 0, 1), 2)
    return pd.DataFrame({"id": range(300), "y": y, "s": s})


def brute_scan(pdf, side, grid):
    out = []
    for q in grid:
        t = pdf.s.quantile(q)
        cut = pdf.s.where(~(pdf.s < t), 0) if side == "low" else pdf.s.where(~(pdf.s > t), 1)
        out.append((t, brute_auc(pdf.y.to_numpy(), cut.to_numpy())))
    return out


@pytest.mark.parametrize("side", ["low", "high"])
def test_threshold_scan(spark, scored, side):
    grid = bl.levels(*(bl.LOW_LEVELS if side == "low" else bl.HIGH_LEVELS))
    assert len(grid) == 1001
    grid = grid[::40]
    df = spark.createDataFrame(scored)
    got = bl.threshold_scan(df, "y", "s", side, grid).orderBy("level").collect()
    for row, q, (t, auc) in zip(got, grid, brute_scan(scored, side, grid), strict=True):
        assert row.level == q
        assert row.threshold == pytest.approx(t, abs=1e-12)
        assert row.auc == pytest.approx(auc, abs=1e-12)


@pytest.mark.parametrize("mode", ["level_as_value", "quantile_value"])
def test_cutoffs(spark, scored, mode):
    low_grid, high_grid = [0.0, 0.03, 0.06, 0.1], [0.9, 0.95, 0.99]
    df = spark.createDataFrame(scored)
    got = bl.find_cutoffs(df, "y", "s", mode, low_grid, high_grid)

    def first_best(pdf, side, grid):
        scan = brute_scan(pdf, side, grid)
        best = max(a for _, a in scan)
        i = next(i for i, (_, a) in enumerate(scan) if a >= best - 1e-15)
        return grid[i], scan[i][0]

    low, low_at = first_best(scored, "low", low_grid)
    cut = low if mode == "level_as_value" else low_at
    lowered = scored.assign(s=scored.s.where(~(scored.s < cut), 0))
    high, _ = first_best(lowered, "high", high_grid)
    assert (got.low_level, got.high_level) == (low, high)
    out = bl.cut_by(df, "s", got, mode).toPandas()
    assert out.s.between(0, 1).all() and len(out) == len(scored)


def test_scores_outside_the_unit_interval_are_refused(spark):
    df = spark.createDataFrame([(1, 1.5), (0, 0.2)], "y int, s double")
    with pytest.raises(ValueError, match="must lie in"):
        bl.threshold_scan(df, "y", "s", "low", [0.0])


def test_blend_matches_by_id(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id int, TARGET double")
    b = spark.createDataFrame([(2, 0.8), (1, 0.6)], "id int, TARGET double")
    out = bl.blend({"a": a, "b": b}, [0.5, 0.5], "id").orderBy("id").collect()
    assert [round(r.TARGET, 9) for r in out] == [0.4, 0.6]


def test_weight_scan(spark, scored):
    rng = np.random.default_rng(1)
    pdf = scored.assign(r=rng.random(len(scored)))
    got = bl.weight_scan(spark.createDataFrame(pdf), "y", "s", "r", [0.0, 0.5, 1.0])
    for row in got.collect():
        mixed = (row.weight * pdf.s + (1 - row.weight) * pdf.r).to_numpy()
        assert row.auc == pytest.approx(brute_auc(pdf.y.to_numpy(), mixed), abs=1e-9)


def test_blend_keeps_every_listed_id(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, TARGET double")
    b = spark.createDataFrame([(2, 0.75), (3, 1.0)], "id int, TARGET double")
    found = {r.id: r.TARGET for r in bl.blend({"a": a, "b": b}, [0.5, 0.5], "id").collect()}
    assert found == {1: None, 2: 0.5, 3: None}
    ids = spark.createDataFrame([(2,), (9,)], "id int")
    listed = bl.blend({"a": a, "b": b}, [0.5, 0.5], "id", ids=ids).collect()
    assert {r.id: r.TARGET for r in listed} == {2: 0.5, 9: None}


def test_unknown_modes_are_refused(spark):
    df = spark.createDataFrame([(1, 0.5)], "y int, s double")
    with pytest.raises(ValueError, match="mode"):
        bl.find_cutoffs(df, "y", "s", "quantile")
    with pytest.raises(ValueError, match="mode"):
        bl.cut_by(df, "s", bl.Cutoffs(None, None, None, None), "level")
    with pytest.raises(ValueError, match="side"):
        bl.threshold_scan(df, "y", "s", "middle")


def test_quantile_lookup_joins_on_no_literal(spark):
    from entitymill.operators.ordered import group_quantiles

    df = spark.range(100).selectExpr("double(id) as v")
    plan = group_quantiles(df, [], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "_one" not in plan


# ---- weights and cuts together ----------------------------------------------------


def mixed_scores(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    a, b = (np.clip(0.5 + s * (y - 0.5) + 0.3 * rng.normal(size=n), 0, 1).round(2) for s in (0.3, 0.2))
    a[:60] = rng.random(60) * 0.09
    rows = [(int(v) if i % 9 else None, float(a[i]), None if i % 13 == 0 else float(b[i])) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "y int, a double, `b.c` double"), rows


def plain_mix(mix, scores):
    def cut(x, lo, hi):
        return 0.0 if x < lo else 1.0 if x > hi else x

    return cut(sum(w * cut(x, lo, hi) for w, x, lo, hi in zip(mix.weights, scores, mix.lows, mix.highs)), mix.low, mix.high)


def plain_auc(pairs):
    pos, neg = ([s for y, s in pairs if y == v] for v in (1, 0))
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_mixes_are_rated_like_brute_force(spark):
    df, rows = mixed_scores(spark)
    rng = np.random.default_rng(5)
    mixes = [bl.mix_of(b[:, 0] + rng.random(len(b)) * (b[:, 1] - b[:, 0]), 2) for b in [bl.mix_bounds(2)] * 12]
    mixes += [bl.Mix((1.0, 0.0), (0.0, 0.0), (1.0, 1.0)), bl.Mix((0.5, 0.5), (0.3, 0.3), (0.6, 0.6), 0.4, 0.5)]
    ranks = bl.rank_table(df, "y", ["a", "b.c"])
    got = {r.mix: r.auc for r in bl.rate_mixes(ranks, mixes).collect()}
    whole = [(y, (a, b)) for y, a, b in rows if y is not None and b is not None]
    for i, m in enumerate(mixes):
        assert got[i] == pytest.approx(plain_auc([(y, plain_mix(m, s)) for y, s in whole]))
        applied = bl.apply_mix(df, ["a", "b.c"], m, "out").collect()
        for (_, a, b), r in zip(rows, applied, strict=True):
            assert r.out is None if b is None else r.out == pytest.approx(plain_mix(m, (a, b)))


def test_mixes_of_three_models(spark):
    assert len(bl.mix_bounds(2)) == 7 and len(bl.mix_bounds(3)) == 11
    m = bl.mix_of([0.2, 0.2, 0.4, 0.91, 0.01, 0.92, 0.02, 0.93, 0.03, 0.94, 0.04], 3)
    assert m.weights == pytest.approx((0.25, 0.25, 0.5))
    assert (m.lows, m.highs, m.low, m.high) == ((0.01, 0.02, 0.03), (0.91, 0.92, 0.93), 0.04, 0.94)


def test_best_mix_is_found(spark):
    df, _ = mixed_scores(spark)
    ranks = bl.rank_table(df, "y", ["a", "b.c"])
    grid = [bl.Mix((w / 10, 1 - w / 10), (lo, 0.0), (1.0, 1.0)) for w in range(11) for lo in (0.0, 0.1)]
    best = max(r.auc for r in bl.rate_mixes(ranks, grid).collect())
    found = bl.search_mix(df, "y", ["a", "b.c"], generations=8, members=20, tolerance=0.0)
    history = found.history.orderBy("generation").collect()
    assert [r.best for r in history] == sorted(r.best for r in history)
    assert found.auc == history[-1].best > best - 0.005
    assert found.auc == pytest.approx(bl.rate_mixes(ranks, [found.best]).first().auc)
    again = bl.search_mix(df, "y", ["a", "b.c"], generations=8, members=20, tolerance=0.0)
    assert again.best == found.best
    assert len(bl.search_mix(df, "y", ["a", "b.c"], members=8, tolerance=10.0).history.collect()) == 1
    nothing = bl.search_mix(df.limit(0), "y", ["a", "b.c"], members=8)
    assert nothing.auc is None


# ---- tiles of columns, sparse categories ------------------------------------------


def test_tiles_give_the_same_correlations(spark):
    from entitymill.operators.select import correlated_columns, correlations

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 23))
    x[:, 11] = 2 * x[:, 3] + 0.01 * rng.normal(size=300)
    x[:, 20] = -x[:, 19]
    x[:, 7] = 4.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[5, 14] = np.inf
    names = [f"c.{i}" for i in range(23)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).astype(object).where(~np.isnan(x), None).values.tolist(), ", ".join(f"`{n}` double" for n in names)).repartition(5)
    with np.errstate(invalid="ignore"):
        want = pd.DataFrame(x).corr(min_periods=1).to_numpy()
    for tile in (4, 10, 256):
        got = np.full((23, 23), np.nan)
        for r in correlations(df, names, tile=tile).collect():
            assert r.a < r.b
            got[r.a, r.b] = np.nan if r.correlation is None else r.correlation
        assert np.isnan(got[14, 15:]).all() and np.isnan(got[7, 8:]).all()
        for i in range(23):
            for j in range(i + 1, 23):
                if 7 not in (i, j) and 14 not in (i, j):
                    assert got[i, j] == pytest.approx(want[i, j])
    strong = {(r.a, r.b) for r in correlations(df, names, 0.9, tile=6).collect()}
    assert strong == {(3, 11), (19, 20)} and correlated_columns(df) == ["c.11", "c.20"]
    assert correlations(df, []).count() == 0 and correlations(df.limit(0), names[:3]).where("correlation is not null").count() == 0


def test_sparse_categories_equal_one_hot_columns(spark):
    from entitymill.operators.encode import category_index, one_hot, sparse_one_hot

    rows = [(i, ["b", "a", None, "", "é"][i % 5], None if i % 3 else "x", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, `p.q` string, r string, z double").repartition(3)
    for missing in (True, False):
        plain, names = one_hot(df, missing)
        vectors, size = sparse_one_hot(df, missing=missing)
        assert size == len(names) and vectors.columns == ["id", "z", "categories"]
        want = {r["id"]: [r[n] for n in names] for r in plain.collect()}
        got = {r.id: r.categories.toArray().astype(int).tolist() for r in vectors.collect()}
        assert got == want
    # Values that another table lacks get no position.
    index = category_index(df.where("id % 5 <> 0"), ["p.q", "r"])
    vectors, size = sparse_one_hot(df, ["p.q", "r"], index=index)
    assert size == 6 and all(len(r.categories.indices) == (1 if r.id % 5 == 0 else 2) for r in vectors.collect())
    nothing, size = sparse_one_hot(df.limit(0), missing=False)
    assert size == 0 and nothing.count() == 0


def test_a_million_categories_reach_the_matrix(spark):
    from pyspark.sql import functions as F

    from entitymill.operators.encode import sparse_one_hot
    from entitymill.operators.models import model_matrix

    df = spark.range(1_000_000).select("id", (F.col("id") % 2).cast("double").alias("y"), F.lit(2.5).alias("a"), F.concat(F.lit("v"), "id").alias("c"))
    vectors, size = sparse_one_hot(df)
    assert size == 1_000_001
    matrix, names = model_matrix(vectors, "id", "y", categories="categories", categories_size=size)
    assert names == ["a"]
    for r in matrix.where("id % 250007 = 0").collect():
        v = r.features
        assert v.size == size + 1 and v.indices[0] == 0 and v.values.tolist() == [2.5, 1.0]
    places = matrix.select(F.unwrap_udt("features").getField("indices")[1].alias("at"))
    assert places.distinct().count() == 1_000_000
    assert len(str(matrix.schema["features"].metadata)) < 1000


def test_mixes_are_rated_alike_in_one_span_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(21)
    n = 4000
    a, b = rng.random(n).round(3), rng.random(n).round(1)
    rows = [(float(y), float(p), float(q)) for y, p, q in zip(rng.integers(0, 2, n), a, b, strict=True)]
    df = spark.createDataFrame(rows, "y double, a double, b double").repartition(5)
    ranks = bl.rank_table(df, "y", ["a", "b"])
    mixes = [bl.Mix((w, 1 - w), (0.0, 0.1), (0.95, 1.0), 0.02, 0.9) for w in (0.0, 0.3, 1.0)]
    whole = {r.mix: r.auc for r in bl.rate_mixes(ranks, mixes).collect()}
    monkeypatch.setattr(bl, "SPAN_ROWS", 300)
    monkeypatch.setattr(bl, "SPAN_SAMPLE", 200)
    monkeypatch.setattr(bl, "MIXED_AT_ONCE", 100)
    cut = bl.rate_mixes(ranks, mixes)
    # The scores move as packed spans, once, and not as a row for each mix and score.
    plan = cut._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "rangepartitioning" not in plan
    cut = {r.mix: r.auc for r in cut.collect()}
    for i, m in enumerate(mixes):
        want = roc_auc_value(bl.apply_mix(df, ["a", "b"], m, "s"), "y", "s")
        assert whole[i] == pytest.approx(want, abs=1e-12) and cut[i] == pytest.approx(want, abs=1e-12)
    assert bl.rate_mixes(ranks.where("m0 < 0"), mixes).collect() == []
