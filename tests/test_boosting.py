"""Histogram boosting against a plain version, cut points against exact ranks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitymill.operators import boosting as bo
from entitymill.operators import models as md
from entitymill.operators.cuts import Summary, find_cuts
from entitymill.operators.metrics import roc_auc_value


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    n = 1500
    x = np.round(rng.normal(size=(n, 5)), 1)
    x[:, 4] = rng.integers(0, 3, n)
    x[rng.random((n, 5)) < 0.15] = np.nan
    odds = np.nan_to_num(x[:, 0], nan=1.5) + 0.7 * np.nan_to_num(x[:, 1] ** 2, nan=-1) * (np.nan_to_num(x[:, 4]) > 0) - 0.5
    y = (odds + rng.normal(size=n) > 0).astype(float)
    return x, y, rng.integers(0, 3, n)


def frame(spark, rows, partitions=4):
    x, y, fold = rows
    none = lambda v: None if np.isnan(v) else float(v)
    data = [(i, float(y[i]), int(fold[i]), *map(none, x[i])) for i in range(len(y))]
    return spark.createDataFrame(data, "id long, label double, fold int, a double, `b.x` double, c double, d double, e double").repartition(partitions)


FEATURES = ["a", "b.x", "c", "d", "e"]


def table(spark, rows, partitions=4, bins=255):
    df = frame(spark, rows, partitions)
    return bo.bin_table(df, "id", "label", FEATURES, bins, df.select("id", "fold"))


# ---- the plain version -------------------------------------------------------


def plain_split(codes, g, h, features, s):
    def part(m):
        return np.array([g[m].sum(), h[m].sum(), m.sum()])

    def score(v):
        a, b = v[0] / bo.UNIT, v[1] / bo.UNIT
        return (np.sign(a) * max(abs(a) - s.alpha, 0)) ** 2 / (b + s.lam)

    best = None
    everything = part(np.ones(len(g), bool))
    for f in features:
        for cut in range(1, 256):
            if cut > codes[:, f].max():
                break
            for missing_left in (True, False):
                m = codes[:, f] <= cut if missing_left else (codes[:, f] <= cut) & (codes[:, f] > 0)
                left, right = part(m), part(~m)
                if min(left[2], right[2]) < max(s.min_rows, 1) or min(left[1], right[1]) < s.min_weight * bo.UNIT:
                    continue
                gain = score(left) + score(right) - score(everything)
                if gain > max(s.min_gain, 1e-9) and (best is None or gain > best[0]):
                    best = (gain, f, cut, missing_left, m)
    return best


def plain_tree(codes, y, margins, s, features, allowed):
    p = 1 / (1 + np.exp(-margins))
    g, h = np.rint((p - y) * bo.UNIT), np.rint(p * (1 - p) * bo.UNIT)
    leaves, done = [("", np.arange(len(y)))], {}
    splits = {}

    def split_of(path, rows):
        if path not in splits:
            if s.max_depth and len(path) >= s.max_depth:
                splits[path] = None
            else:
                use = [f for f, a in zip(features, allowed(len(path)), strict=True) if a]
                splits[path] = plain_split(codes[rows], g[rows], h[rows], use, s)
        return splits[path]

    level = 0
    while not s.max_leaves or len(leaves) < s.max_leaves:
        open_ = [(path, rows) for path, rows in leaves if split_of(path, rows)]
        if not open_:
            break
        if s.best_first:
            path, rows = max(open_, key=lambda x: splits[x[0]][0])
        else:
            level = min(len(p) for p, _ in open_)
            path, rows = min((x for x in open_ if len(x[0]) == level), key=lambda x: x[0])
        gain, f, cut, missing_left, m = splits[path]
        done[path] = (FEATURES[f], cut, missing_left, gain)
        leaves = [x for x in leaves if x[0] != path] + [(path + "L", rows[m]), (path + "R", rows[~m])]
    values, out = {}, margins.copy()
    for path, rows in leaves:
        a, b = g[rows].sum() / bo.UNIT, h[rows].sum() / bo.UNIT
        values[path] = -s.rate * np.sign(a) * max(abs(a) - s.alpha, 0) / (b + s.lam)
        out[rows] += values[path]
    return done, values, out


CASES = {
    "leaf_wise": bo.Settings(rounds=3, max_leaves=7, min_rows=5, lam=1.0),
    "penalties": bo.Settings(rounds=3, max_leaves=12, max_depth=4, min_rows=3, alpha=2.5, lam=4.0, min_gain=1.5, min_weight=6.0),
    "columns": bo.Settings(rounds=4, max_leaves=9, min_rows=3, by_tree=0.6, by_level=0.7, seed=5),
    "depth_wise": bo.Settings(rounds=3, max_leaves=6, max_depth=5, min_rows=1, lam=0.5, best_first=False, from_average=False),
    "no_limits": bo.Settings(rounds=1, max_leaves=0, min_rows=40, best_first=False),
}


@pytest.mark.parametrize("name", CASES)
def test_trees_equal_a_plain_version(spark, rows, name):
    s = CASES[name]
    t = table(spark, rows)
    models = bo.fit(t, [s, s], [1, None])
    found = {r.id: r for r in t.rows.collect()}
    codes = np.array([list(found[i].bins) for i in range(len(rows[1]))])
    for m in models:
        use = rows[2] != 1 if m.fold == 1 else np.ones(len(rows[1]), bool)
        y, own = rows[1][use], codes[use]
        margins = np.full(len(y), np.log(y.mean() / (1 - y.mean())) if s.from_average else 0.0)
        assert m.base == pytest.approx(margins[0])
        margins[:] = m.base
        for number, tree in enumerate(m.trees):
            g = bo.Grower(s, 5, number)
            done, values, margins = plain_tree(own, y, margins, s, g.features, g.allowed)
            nodes = {r["path"]: r for r in bo.tree_table(t, m, number)}
            inner = {p: r for p, r in nodes.items() if r["feature"]}
            assert inner.keys() == done.keys()
            for path, (feature, cut, missing_left, gain) in done.items():
                r = inner[path]
                cuts = t.cuts[FEATURES.index(feature)]
                want = cuts[cut - 1] if cut <= len(cuts) else np.inf
                assert (r["feature"], r["cut"], r["missing_left"]) == (feature, want, missing_left)
                assert r["gain"] == pytest.approx(gain)
            for path, value in values.items():
                assert nodes[path]["value"] == pytest.approx(value)


def test_trees_do_not_depend_on_partitions(spark, rows):
    s = replace(CASES["columns"], subsample=0.5)
    one, many = (bo.fit(table(spark, rows, n), [s], [0])[0] for n in (1, 13))
    for a, b in zip(one.trees, many.trees, strict=True):
        assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "cut", "value", "gain"))


def test_subsamples(spark):
    key = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    s = bo.Settings(subsample=0.3)
    first, again, other = (bo._drawn(key, s, r) for r in (0, 0, 1))
    assert (first == again).all() and abs(first.mean() - 0.3) < 0.02 and abs((first & other).mean() - 0.09) < 0.02
    assert bo._drawn(key, replace(s, subsample_every=0), 0) is True
    assert (bo._drawn(key, replace(s, subsample_every=5), 4) == bo._drawn(key, replace(s, subsample_every=5), 0)).all()


def test_missing_values_alone_carry_the_label(spark):
    """The default direction is learned: missing means 1 in one column, and 0 in the other."""
    data = []
    for i in range(400):
        high, low = i % 2 == 0, i % 3 == 0
        data.append((i, float(high), None if high else float(i % 7), float(i % 5)))
        data.append((400 + i, float(not low), 1.0, None if low else float(i % 5)))
    df = spark.createDataFrame(data, "id long, y double, a double, b double")
    folds = df.select("id", F.pmod("id", F.lit(2)).cast("int").alias("fold"))
    for feature, part in (("a", df.where("id < 400")), ("b", df.where("id >= 400"))):
        t = bo.bin_table(part, "id", "y", [feature], 255, folds)
        m = bo.fit(t, [bo.Settings(rounds=1, max_leaves=2, min_rows=1)], [None])[0]
        root = bo.tree_table(t, m, 0)[0]
        assert root["cut"] == np.inf and root["missing_left"] is False
        got = {r.id: r.prediction for r in bo.predict(t, [m], t.rows).collect()}
        want = {r.id: r.y for r in part.collect()}
        ones, zeros = ([got[i] for i in want if want[i] == v] for v in (1, 0))
        assert min(ones) > max(zeros)
    # And with the values on the other side of the missing ones, at a cut between values.
    x = [(i, 1.0 if i % 4 in (0, 3) else 0.0, None if i % 4 == 0 else float(i % 4)) for i in range(400)]
    t = bo.bin_table(spark.createDataFrame(x, "id long, y double, a double"), "id", "y", ["a"])
    root = bo.tree_table(t, bo.fit(t, [bo.Settings(rounds=1, max_leaves=2)], [None])[0], 0)[0]
    assert root["cut"] == 2.5 and root["missing_left"] is False


def test_kfold_traces_and_stops(spark, rows):
    df = frame(spark, rows).drop("fold").withColumn("label", F.when(F.col("id") % 10 != 0, F.col("label")))
    learner = md.boosted_leaf_wise(rounds=60, rate=0.5, min_rows=5, min_weight=0.1, max_leaves=31, alpha=0.0, lam=0.0, min_gain=0.0, by_tree=1.0, patience=6)
    result = md.kfold(df, learner, "id", "label", k=3)
    oof, test = result.oof.toPandas(), result.test.toPandas()
    assert sorted(oof.id) == [i for i in range(1500) if i % 10] and sorted(test.id) == list(range(0, 1500, 10))
    assert oof.prediction.between(0, 1).all() and test.prediction.between(0, 1).all()
    assert result.full_auc().first().auc > 0.75
    trace = md.score_trace(result).toPandas()
    for m in result.models:
        own = trace[trace.fold == m.fold]
        valid = own[own.part == "valid"].set_index("iteration").auc
        # Ended by its patience, and cut back to its best round.
        assert len(m.trees) == m.best_round() == valid.idxmax() and 6 <= valid.index.max() - m.best_round() < 6 + bo.LOOK
        assert valid.index.max() < 60
        train = own[own.part == "train"].set_index("iteration")
        assert train.auc.iloc[-1] > train.auc.iloc[0] and train.loss.iloc[-1] < train.loss.iloc[0]
        held = result.oof.where(F.col("fold") == m.fold)
        assert roc_auc_value(held, "label", "prediction") == pytest.approx(valid[m.best_round()])
    gains = result.importances.groupBy("feature").agg(F.avg("importance").alias("i")).orderBy(F.desc("i")).first()
    assert gains.feature == "a"


def test_fits_go_on_where_they_ended(spark, rows):
    t = table(spark, rows)
    s = replace(CASES["leaf_wise"], rounds=6)
    whole = bo.fit(t, [s], [2])
    parts = bo.fit(t, [s], [2], rounds=2)
    assert len(parts[0].trees) == 2
    parts = bo.fit(t, [], [], models=parts)
    for a, b in zip(whole[0].trees, parts[0].trees, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value)
    assert [x[:2] for x in whole[0].trace] == [x[:2] for x in parts[0].trace]


def test_small_histograms_take_turns(spark, rows, monkeypatch):
    t, s = table(spark, rows), CASES["leaf_wise"]
    whole = bo.fit(t, [s, s], [0, 1])
    monkeypatch.setattr(bo, "HISTOGRAM_BYTES", 40_000)
    turns = bo.fit(t, [s, s], [0, 1])
    for a, b in zip(whole, turns, strict=True):
        assert all(np.array_equal(x.feature, y.feature) and np.array_equal(x.value, y.value) for x, y in zip(a.trees, b.trees, strict=True))


def test_empty_and_constant_tables(spark):
    schema = "id long, y double, a double, b double"
    for data in ([], [(1, None, 1.0, None)], [(1, 1.0, None, 2.0), (2, 1.0, None, 2.0)]):
        t = bo.bin_table(spark.createDataFrame(data, schema), "id", "y", ["a", "b"])
        m = bo.fit(t, [bo.Settings(rounds=2, min_rows=1)], [None])[0]
        assert all((tree.feature < 0).all() for tree in m.trees)
        assert bo.predict(t, [m], t.rows).count() == len(data)


# ---- cut points ----------------------------------------------------------------


def test_few_values_get_a_bin_each(spark, rows):
    cuts = find_cuts(frame(spark, rows), FEATURES, 255)
    for i, c in enumerate(cuts):
        values = np.unique(rows[0][:, i][~np.isnan(rows[0][:, i])])
        assert np.allclose(c, (values[1:] + values[:-1]) / 2)
    assert find_cuts(frame(spark, rows).where("id < 0"), ["a"], 10)[0].tolist() == []


@pytest.mark.parametrize("weighted", [False, True])
def test_cuts_are_near_the_weighted_quantiles(spark, monkeypatch, weighted):
    import entitymill.operators.cuts as cu

    monkeypatch.setattr(cu, "ROWS_AT_ONCE", 700)
    monkeypatch.setattr(cu, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    x, w = rng.exponential(size=20_000) ** 3, rng.random(20_000) if weighted else np.ones(20_000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double").repartition(10)
    bins = 16
    cuts = find_cuts(df, ["x"], bins, "w" if weighted else None)[0]
    share = np.array([w[x <= c].sum() for c in cuts]) / w.sum()
    assert len(cuts) == bins - 1
    # Three rows-at-once prunes, three merges between tasks and the last choice, each 1 / (8 * bins) at most.
    assert np.abs(share - np.arange(1, bins) / bins).max() < 8 / (cu.VALUES_A_BIN * bins)


def test_summaries_bound_ranks():
    rng = np.random.default_rng(4)
    values, weights = rng.integers(0, 500, 6000).astype(float), rng.random(6000)
    total = Summary.of(values[:0], weights[:0])
    for a in range(0, 6000, 500):
        total = total.merge(Summary.of(values[a : a + 500], weights[a : a + 500])).prune(60)
    for v, low, high in zip(total.values, total.low, total.high, strict=True):
        assert low <= weights[values < v].sum() + 1e-9 and high >= weights[values <= v].sum() - 1e-9
    assert not total.exact() and total.total == pytest.approx(weights.sum())
    assert Summary.parse(total.raw()).values.tolist() == total.values.tolist()


# ---- trees and state in blocks -------------------------------------------------


@pytest.mark.parametrize("inner", [0, 1, 40, 300])
def test_leaves_equal_a_walk(inner):
    """Small trees compare all rows at each node, large ones follow the rows; both end where a walk does."""
    rng = np.random.default_rng(inner)
    n = 2 * inner + 1
    tree = bo.Tree(np.full(n, -1), rng.integers(1, 6, n), rng.random(n) < 0.5, np.zeros(n, int), np.zeros(n, int), rng.random(n), np.zeros(n))
    leaves, free = [0], 1
    for _ in range(inner):
        i = leaves.pop(rng.integers(len(leaves)))
        tree.feature[i], tree.left[i], tree.right[i] = rng.integers(3), free, free + 1
        leaves += [free, free + 1]
        free += 2
    codes = rng.integers(0, 7, (500, 3)).astype(np.uint8)
    found = tree.leaves(codes)
    assert (found == tree.leaves(np.asfortranarray(codes))).all() and (found.dtype == np.uint8) == (n <= 256)
    for row, at in zip(codes, found, strict=True):
        i = 0
        while tree.feature[i] >= 0:
            c = row[tree.feature[i]]
            i = tree.left[i] if (tree.missing_left[i] if c == 0 else c <= tree.cut[i]) else tree.right[i]
        assert i == at


def test_state_holds_blocks_of_rows(spark, rows, monkeypatch):
    t = table(spark, rows)
    s = replace(CASES["leaf_wise"], rounds=2, max_leaves=4)
    labelled = t.rows.where("label IS NOT NULL").select("key", "label", "fold", "bins")
    partitions = labelled.rdd.getNumPartitions()
    trainer = bo._Trainer(t, labelled, [bo.Model(s, 0, 0.0), bo.Model(s, None, 0.0)], False)
    assert trainer.state.count() <= partitions
    trainer._drop(trainer.state, trainer.path)
    whole = bo.fit(t, [s, s], [0, None], both_parts=True)
    monkeypatch.setattr(bo, "STATE_BYTES", 2_000)
    small = bo.fit(t, [s, s], [0, None], both_parts=True)
    for a, b in zip(whole, small, strict=True):
        assert all(np.array_equal(x.feature, y.feature) and np.array_equal(x.value, y.value) for x, y in zip(a.trees, b.trees, strict=True))
        assert np.allclose([x[2:] for x in a.trace if x[2]], [x[2:] for x in b.trace if x[2]])


def test_rows_by_score_equal_rows_one_by_one():
    rng = np.random.default_rng(8)
    codes, margins = rng.integers(0, 4, (300, 2)).astype(np.uint8), rng.choice([0.5, -1.0, 2.0], 300)
    valid, positive = rng.random(300) < 0.4, rng.random(300) < 0.5
    stump = lambda f, c: bo.Tree(np.array([f, -1, -1]), np.array([c, 0, 0]), np.zeros(3, bool), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0, 0.25, -0.5]), np.zeros(3))
    trees, m = [stump(0, 1), stump(1, 2), stump(0, 3)], margins
    for tree, (part, score, pos, neg) in zip(trees, bo._by_score(margins, codes, trees, valid, positive), strict=True):
        m = tree.add_to(m, codes)
        want, got = {}, {}
        for p, x, y in zip(valid, m, positive, strict=True):
            want.setdefault((p, x), [0, 0])[0 if y else 1] += 1
        for p, x, a, b in zip(part, score, pos, neg, strict=True):
            both = got.setdefault((p, x), [0, 0])
            both[0], both[1] = both[0] + a, both[1] + b
        assert got == want


def test_spark_never_gets_large_values(spark, monkeypatch):
    """Blocks of the state are small, and hold margins of fits with many trees only; a histogram row has one feature."""
    monkeypatch.setattr(bo, "LOOK", 3)
    n, folds = 8000, 12
    df = spark.range(n).selectExpr("id", "cast(id % 7 < 3 as double) as label", "cast(id % 12 as int) as fold", "cast(id % 101 as double) as a", "cast(id % 13 as double) as b").coalesce(1)
    t = bo.bin_table(df, "id", "label", ["a", "b"], folds=df.select("id", "fold"))
    s = replace(CASES["leaf_wise"], rounds=bo.LOOK + 3, max_leaves=4)
    labelled = t.rows.where("label IS NOT NULL").select("key", "label", "fold", "bins")
    trainer = bo._Trainer(t, labelled, [bo.Model(s, k, 0.0) for k in range(folds)], False)
    columns = ["key", "label", "fold", "bins", "margins"]
    sizes = trainer.state.select(*[F.length(c).alias(c) for c in columns]).toPandas()
    assert sizes.key.sum() == 8 * n and sizes.margins.sum() == 0
    assert sizes.sum(axis=1).max() <= bo.STATE_BYTES
    seen = []
    packed = bo._Query.packed
    monkeypatch.setattr(bo._Query, "packed", lambda q: seen.append(q.start) or packed(q))
    kept = trainer._kept
    monkeypatch.setattr(trainer, "_kept", lambda rows: seen.append(rows.agg(F.sum(F.length("margins")), F.max(F.length("margins"))).first()) or kept(rows))
    trainer.run(None)
    written = [x for x in seen if isinstance(x[0], int)]
    assert len(written) == 1 and written[0][0] == 8 * n * folds and written[0][1] <= bo.STATE_BYTES
    assert {x[1] for x in seen[: seen.index(written[0])]} == {None} and {x[1] for x in seen[seen.index(written[0]) + 1 :]} == set(range(folds))
    # Fits that go on from many trees start with margins, those from a few without; both as if they had never ended.
    monkeypatch.undo()
    monkeypatch.setattr(bo, "LOOK", 3)
    whole = bo.fit(t, [s], [0])[0]
    for first in (2, bo.LOOK + 1):
        begun = bo.fit(t, [s], [0], rounds=first)
        on = bo.fit(t, [], [], models=begun)[0]
        assert all(np.array_equal(x.feature, y.feature) and np.array_equal(x.value, y.value) for x, y in zip(on.trees, whole.trees, strict=True))
        assert [x[2:] for x in on.trace] == [pytest.approx(x[2:]) for x in whole.trace]


def test_blocks_of_features_give_the_same_trees(spark, rows, monkeypatch):
    t = table(spark, rows)
    s = replace(CASES["leaf_wise"], rounds=2, by_level=0.6)
    whole = bo.fit(t, [s], [0])[0]
    monkeypatch.setattr(bo, "BLOCK", 2)
    for x, y in zip(whole.trees, bo.fit(t, [s], [0])[0].trees, strict=True):
        assert np.array_equal(x.feature, y.feature) and np.array_equal(x.cut, y.cut) and np.array_equal(x.value, y.value)
