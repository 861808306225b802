"""K-fold training, predictions, importances, traces and search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitymill.operators import models as md
from entitymill.operators.search import LEAF_WISE_BOUNDS, draw, mllib_params, search


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        x, y = rng.normal(), rng.normal()
        label = None if i % 5 == 0 else float(x + 0.3 * rng.normal() > 0)
        rows.append((i, label, float(x), None if i % 7 == 0 else float(y), float("inf") if i == 3 else 1.0))
    return spark.createDataFrame(rows, "SK_ID_CURR int, TARGET double, `x.1` double, y double, z double")


SMALL = {"maxIter": 4, "maxDepth": 3, "minInstancesPerNode": 2, "stepSize": 0.3,
         "featureSubsetStrategy": "all"}
LEARNERS = {
    "leaf_wise": md.leaf_wise_gbt(**SMALL),
    "depth_wise": md.depth_wise_gbt(**SMALL),
    "forest": md.random_forest(numTrees=8, featureSubsetStrategy="all"),
    "net": md.dense_net(hidden=(6,), maxIter=60),
}


@pytest.mark.parametrize("name", LEARNERS)
def test_kfold(people, name):
    result = md.kfold(people, LEARNERS[name], "SK_ID_CURR", "TARGET", k=3)
    oof, test = result.oof.toPandas(), result.test.toPandas()
    assert sorted(oof.SK_ID_CURR) == [i for i in range(400) if i % 5]
    assert sorted(test.SK_ID_CURR) == [i for i in range(400) if i % 5 == 0]
    assert oof.prediction.between(0, 1).all() and test.prediction.between(0, 1).all()
    assert result.full_auc().first().auc > 0.85
    assert result.fold_auc().count() == 3
    if name == "net":
        assert result.importances is None
    else:
        top = result.importances.groupBy("feature").agg(F.avg("importance").alias("i"))
        assert top.orderBy(F.desc("i")).first().feature == "x.1"
    if "wise" in name:
        parts = md.score_trace(result).groupBy("fold", "part").count().collect()
        assert len(parts) == 6


def test_matrix_policies(people):
    filled, names = md.model_matrix(people, "SK_ID_CURR", "TARGET", policy=md.SENTINEL)
    assert names == ["x.1", "y", "z"]
    row = filled.filter("SK_ID_CURR = 3").first()
    assert row.features[2] == -999.0
    assert filled.filter("SK_ID_CURR = 7").first().features[1] == -999.0
    scaled, _ = md.model_matrix(people, "SK_ID_CURR", "TARGET", policy=md.MEAN_SCALED)
    values = np.array([r.features.toArray() for r in scaled.collect()])
    assert values.min() == 0.0 and values.max() == 1.0


def test_parameters():
    import random

    point = draw(LEAF_WISE_BOUNDS, random.Random(1))
    assert all(lo <= point[n] <= hi for n, (lo, hi) in LEAF_WISE_BOUNDS.items())
    near = draw(LEAF_WISE_BOUNDS, random.Random(2), point)
    assert abs(near["subsample"] - point["subsample"]) <= 0.125
    assert md.clip_params({"subsample": 1.2, "reg_alpha": -1.0, "max_depth": 3.9}) == {
        "subsample": 1.0, "reg_alpha": 0.0, "max_depth": 3}
    assert mllib_params({"max_depth": 4.7, "min_data_in_leaf": 0.2, "gamma": 0.5}) == {
        "maxDepth": 4, "minInstancesPerNode": 1}


def test_search(people):
    found = search(people, "SK_ID_CURR", "TARGET", {"max_depth": (1, 4)}, k=2, init_points=1,
                   n_iter=1, maxIter=2)
    trials = found.trials.orderBy("trial").collect()
    best = max(trials, key=lambda r: r.auc)
    assert len(trials) == 2 and found.best == {"max_depth": best.max_depth}


@pytest.mark.parametrize("make", [lambda: md.leaf_wise_gbt(maxIter=30), lambda: md.depth_wise_gbt(maxIter=6)])
def test_published_settings_learn(spark, make):
    """Only the number of rounds differs from the published settings."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16_000, 4))
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=len(x)) > 0).astype(float)
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id int, label double, a double, b double, c double, d double")
    result = md.kfold(df, make(), "id", "label", k=2)
    for model in result.models:
        assert model.getNumTrees > 1 and max(t.depth for t in model.trees) > 0
    assert all(r.auc > 0.8 for r in result.fold_auc().collect())


def test_best_round_waits_only_so_long():
    aucs = {1: 0.5, 2: 0.7, 3: 0.6, 4: 0.7, 5: 0.65, 6: 0.9}
    assert md.best_round(aucs) == 6
    assert md.best_round(aucs, patience=3) == 2
    assert md.best_round({1: None}) is None


def test_rounds_add_up_to_the_model(people, monkeypatch):
    matrix, _ = md.model_matrix(people, "SK_ID_CURR", "TARGET")
    rows = matrix.filter("label is not null")
    model = md.gbt(**{**SMALL, "maxIter": 12}).make(0, 3).fit(rows)
    whole = md._probability(model, rows)
    from entitymill.operators.metrics import roc_auc_value

    monkeypatch.setattr(md, "LOOKS_A_PASS", 2)
    monkeypatch.setattr(md, "LOOK_EVERY", 4)
    aucs = md.round_aucs(model, rows.select("features", "label"))
    assert sorted(aucs) == [4, 8, 12]
    assert aucs[12] == pytest.approx(roc_auc_value(whole, "label", "prediction"))
    four = md._probability(md.some_trees(model, 0, 4), rows)
    assert aucs[4] == pytest.approx(roc_auc_value(four, "label", "prediction"))


def test_longer_fits_start_alike(people):
    matrix, _ = md.model_matrix(people, "SK_ID_CURR", "TARGET")
    rows = matrix.filter("label is not null")
    learner = md.gbt(**{**SMALL, "subsamplingRate": 0.5})
    short = learner.make(0, 3).fit(rows)
    long = md.gbt(**{**SMALL, "subsamplingRate": 0.5, "maxIter": 7}).make(0, 3).fit(rows)
    assert [t.toDebugString.split("\n", 1)[1] for t in long.trees[:4]] == [t.toDebugString.split("\n", 1)[1] for t in short.trees]


def test_patience_keeps_the_best_round(people):
    matrix, _ = md.model_matrix(people, "SK_ID_CURR", "TARGET")
    rows = matrix.filter("label is not null")
    train, held = rows.filter("SK_ID_CURR % 2 = 0"), rows.filter("SK_ID_CURR % 2 = 1")
    estimator = md.gbt(**{**SMALL, "maxIter": 12, "stepSize": 1.0}).make(0, 3)
    model = md.fit_patiently(estimator, train, held.select("features", "label"), patience=2)
    full = estimator.copy({estimator.maxIter: model.getNumTrees + 2}).fit(train)
    aucs = md.round_aucs(full, held.select("features", "label"))
    assert model.getNumTrees == md.best_round(aucs, 2)


# ---- the library's own boosting in searches ------------------------------------

BOUNDS = {"max_depth": (1, 4), "reg_lambda": (0, 5), "subsample": (0.5, 1)}


def boosted(people, path, **more):
    from entitymill.operators import boosting as bo
    from entitymill.operators.search import boosted_search

    base = bo.Settings(rounds=6, rate=0.3, min_rows=5, patience=5)
    settings = {"init_points": 3, "n_iter": 3, "guided_at_once": 2, "stages": (2,), "k": 2, **more}
    return boosted_search(people, "SK_ID_CURR", "TARGET", BOUNDS, base, path=path, **settings)


def test_boosted_search_goes_on_where_it_stopped(spark, people, monkeypatch, tmp_path):
    from entitymill.operators import boosting as bo
    from entitymill.operators import search as se

    path, runs = str(tmp_path / "trials"), []
    halving = se._halving
    monkeypatch.setattr(se, "_halving", lambda table, settings, *a: runs.append(len(settings)) or halving(table, settings, *a))

    def broken(table, settings, *a):
        if len(runs) == 2:
            raise RuntimeError("lost")
        return halving(table, settings, *a)

    whole = boosted(people, None)
    assert runs == [3, 2, 1]
    trials = {r.trial: r for r in whole.trials.collect()}
    assert sorted(trials) == list(range(6))
    best = max(trials.values(), key=lambda r: r.auc)
    assert whole.best == {n: best[n] for n in BOUNDS} and best.auc > 0.8
    # After the first stage one of three goes on, then one of two, and the last alone.
    assert sorted(trials[t].rounds for t in range(3)) == [2, 2, 6] and trials[5].rounds == 6

    runs.clear()
    monkeypatch.setattr(se, "_halving", lambda table, settings, *a: runs.append(len(settings)) or broken(table, settings, *a))
    with pytest.raises(RuntimeError):
        boosted(people, path)
    assert runs == [3, 2]
    runs.clear()
    monkeypatch.setattr(se, "_halving", lambda table, settings, *a: runs.append(len(settings)) or halving(table, settings, *a))
    again = boosted(people, path)
    assert runs == [2, 1]
    assert [tuple(r) for r in again.trials.orderBy("trial").collect()] == [tuple(trials[t]) for t in range(6)]
    runs.clear()
    assert boosted(people, path).best == whole.best and runs == []
    # Another seed is another search.
    boosted(people, path, seed=5, n_iter=0)
    assert runs == [3]
    assert isinstance(bo.LEAF_WISE, bo.Settings)


def test_all_published_parameters_act():
    from entitymill.operators.search import DEPTH_WISE_BASE, DEPTH_WISE_BOUNDS, LEAF_WISE_BASE, LEAF_WISE_BOUNDS, settings_of

    for bounds, base in ((LEAF_WISE_BOUNDS, LEAF_WISE_BASE), (DEPTH_WISE_BOUNDS, DEPTH_WISE_BASE)):
        for name, (lo, hi) in bounds.items():
            assert settings_of({name: lo + 0.6 * (hi - lo)}, base) != settings_of({name: lo + 0.3 * (hi - lo)}, base), name
    assert settings_of({"num_leaves": 40.7, "subsample": 1.5}, LEAF_WISE_BASE).max_leaves == 40


def test_clipped_columns_are_as_clipped_parameters(spark):
    names = ["subsample", "reg_alpha", "num_leaves", "learning_rate"]
    rows = [(1.7, -2.0, 3.9, 5.0), (-0.5, 2.5, -3.9, -1.0), (0.3, 0.0, 40.0, 0.1)]
    got = md.clip_columns(spark.createDataFrame([*rows, (None,) * 4], ", ".join(f"{n} double" for n in names))).collect()
    for row, r in zip(rows, got[:3], strict=True):
        assert r.asDict() == md.clip_params(dict(zip(names, row, strict=True)))
    assert got[3].asDict() == dict.fromkeys(names)
