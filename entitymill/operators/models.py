"""K-fold training with out-of-fold and averaged test predictions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import SparkContext
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.functions.scalar import named
from entitymill.operators import boosting, net
from entitymill.operators.attach import append_all
from entitymill.operators.clean import (
    feature_columns,
    fill_constant,
    fill_mean,
    min_max_scale,
    to_finite_doubles,
)
from entitymill.operators.encode import append_sparse
from entitymill.operators.folds import SEED, assign_folds
from entitymill.operators.metrics import roc_auc
from entitymill.sources.staging import cut_lineage, shared_dir

# How missing and infinite values reach a learner that accepts neither.
SENTINEL = "sentinel"
MEAN_SCALED = "mean_scaled"


@dataclass(frozen=True)
class Learner:
    """A way to make an estimator for a fold, and the fill policy it needs.

    ``make(fold, n_features)`` returns an estimator on ``features``/``label``.
    With ``patience`` a boosting model keeps the round with the best AUC on the
    held-out rows, and no round counts that comes after that many without a
    better one.
    """

    name: str
    make: Callable[[int, int], Estimator]
    policy: str = SENTINEL
    patience: int | None = None


def gbt(name: str = "gbt", patience: int | None = 200, **params) -> Learner:
    def make(fold: int, n_features: int) -> Estimator:
        settings = {"checkpointInterval": 10, "seed": 2**fold, **params}
        return GBTClassifier(featuresCol="features", labelCol="label", **settings)

    return Learner(name, make, SENTINEL, patience)


# The published settings, as far as MLlib has the same knobs. The
# published split gain is a sum over the rows of a node; MLlib's is a mean per row,
# so it is not carried over.
LEAF_WISE = {
    "maxIter": 10_000, "stepSize": 0.02, "maxDepth": 7, "subsamplingRate": 0.5336340435,
    "featureSubsetStrategy": "0.0587705926", "minInstancesPerNode": 629,
}
LEAF_WISE_PATIENCE = 200
DEPTH_WISE = {
    "maxIter": 10_000, "stepSize": 0.001, "maxDepth": 16, "subsamplingRate": 0.5,
    "featureSubsetStrategy": "0.5", "minInstancesPerNode": 4, "maxBins": 255,
}
DEPTH_WISE_PATIENCE = 100
# The published forest grows its trees without a limit; 30 levels are MLlib's most.
FOREST = {
    "numTrees": 500, "featureSubsetStrategy": "0.2", "minInstancesPerNode": 5, "maxDepth": 30,
}
HIDDEN_LAYERS = (1000, 1000, 1000)
# Rounds between two looks at the held-out AUC, and looks per pass over the held-out rows.
LOOK_EVERY = 5
LOOKS_A_PASS = 40


def leaf_wise_gbt(patience: int | None = LEAF_WISE_PATIENCE, **params) -> Learner:
    return gbt("leaf_wise_gbt", patience, **{**LEAF_WISE, **params})


def depth_wise_gbt(patience: int | None = DEPTH_WISE_PATIENCE, **params) -> Learner:
    return gbt("depth_wise_gbt", patience, **{**DEPTH_WISE, **params})


@dataclass(frozen=True)
class Boosted:
    """The library's own boosting, which takes missing values and all published settings as they are."""

    name: str
    settings: boosting.Settings


def boosted_leaf_wise(**settings) -> Boosted:
    return Boosted("leaf_wise", replace(boosting.LEAF_WISE, **settings))


def boosted_depth_wise(**settings) -> Boosted:
    return Boosted("depth_wise", replace(boosting.DEPTH_WISE, **settings))


@dataclass(frozen=True)
class DenseNet:
    """The library's own nets: rectified layers with dropout and early stop."""

    name: str
    settings: net.NetSettings


def relu_net(**settings) -> DenseNet:
    """The published net, unless ``settings`` say otherwise."""
    return DenseNet("relu_net", net.NetSettings(**settings))


def some_trees(model: GBTClassificationModel, start: int, stop: int) -> GBTClassificationModel:
    """The boosting model made of the trees [start, stop) of ``model``."""
    context = SparkContext._active_spark_context
    java, jvm = model._java_obj, context._jvm
    trees, weights = java.trees(), java.treeWeights()
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    some = context._gateway.new_array(kind, stop - start)
    some_weights = context._gateway.new_array(jvm.double, stop - start)
    for i in range(start, stop):
        some[i - start], some_weights[i - start] = trees[i], weights[i]
    make = jvm.org.apache.spark.ml.classification.GBTClassificationModel
    return GBTClassificationModel(
        make(java.uid(), some, some_weights, java.numFeatures(), java.numClasses())
    )


def round_aucs(model: GBTClassificationModel, rows: DataFrame, patience: int | None = None) -> dict:
    """AUC on ``rows`` after each looked-at round, up to ``patience`` rounds past the best.

    Trees are added up block by block: one pass over the rows scores
    ``LOOKS_A_PASS`` rounds, and every tree is applied once.
    """
    last = model.getNumTrees
    looks = [*range(LOOK_EVERY, last, LOOK_EVERY), last] if last > 2 * LOOK_EVERY else [*range(1, last + 1)]
    rows, done, aucs = rows.withColumn("_margin", F.lit(0.0)), 0, {}
    for at in range(0, len(looks), LOOKS_A_PASS):
        some = looks[at : at + LOOKS_A_PASS]
        kept = rows.columns
        scored, margins = rows, {}
        for stop in some:
            part = some_trees(model, done, stop).transform(scored)
            added = vector_to_array("rawPrediction").getItem(1)
            before = F.col(f"_m{margins[max(margins)]}") if margins else F.col("_margin")
            name = len(margins)
            scored = part.select(*scored.columns, (before + added).alias(f"_m{name}"))
            margins[stop], done = name, stop
        pairs = F.array(*[F.struct(F.lit(r).alias("round"), F.col(f"_m{k}").alias("score")) for r, k in margins.items()])
        found = roc_auc(scored.select("label", F.inline(pairs)), "label", "score", ["round"])
        aucs |= {r["round"]: r["auc"] for r in found.collect()}
        best = best_round(aucs)
        if best is None or (patience is not None and done - best >= patience):
            break
        last_margin = F.col(f"_m{margins[some[-1]]}")
        if at + LOOKS_A_PASS < len(looks):
            rows = cut_lineage(scored.select(*[c for c in kept if c != "_margin"], last_margin.alias("_margin")))
    return aucs


def best_round(aucs: Mapping[int, float | None], patience: int | None = None) -> int | None:
    """The first round with the best AUC, looking no further than ``patience`` allows."""
    best = None
    for r in sorted(aucs):
        if aucs[r] is None:
            continue
        if best is not None and patience is not None and r - best > patience:
            break
        if best is None or aucs[r] > aucs[best]:
            best = r
    return best


def fit_patiently(estimator: GBTClassifier, rows: DataFrame, held_out: DataFrame, patience: int):
    """Boosting with the round that is best on ``held_out``; rows of one class keep all rounds.

    Fits twice as many rounds at a time, until the best one lies ``patience`` rounds
    back or ``maxIter`` is reached. The first rounds of a longer fit are those of a
    shorter one, as both draw with the same seed.
    """
    limit = estimator.getMaxIter()
    rounds = min(limit, 4 * patience)
    while True:
        model = estimator.copy({estimator.maxIter: rounds}).fit(rows)
        best = best_round(round_aucs(model, held_out, patience), patience)
        if best is None:
            return model
        if rounds >= limit or rounds - best >= patience:
            return some_trees(model, 0, best)
        rounds = min(limit, 2 * rounds)


def random_forest(**params) -> Learner:
    def make(fold: int, n_features: int) -> Estimator:
        settings = {**FOREST, "seed": 2**fold, **params}
        return RandomForestClassifier(featuresCol="features", labelCol="label", **settings)

    return Learner("random_forest", make, SENTINEL)


def dense_net(hidden: Sequence[int] = HIDDEN_LAYERS, **params) -> Learner:
    def make(fold: int, n_features: int) -> Estimator:
        settings = {"layers": [n_features, *hidden, 2], "seed": 2**fold, **params}
        return MultilayerPerceptronClassifier(
            featuresCol="features", labelCol="label", **settings
        )

    return Learner("dense_net", make, MEAN_SCALED)


@dataclass
class KFoldResult:
    """What a k-fold run leaves behind; all frames are lazy but ``fold_auc``."""

    oof: DataFrame  # id, label, fold, prediction
    test: DataFrame  # id, prediction: the mean over all fold models
    importances: DataFrame | None  # feature, importance, fold
    models: list = field(repr=False)
    matrix: DataFrame = field(repr=False)

    def fold_auc(self) -> DataFrame:
        return roc_auc(self.oof, "label", "prediction", ["fold"])

    def full_auc(self) -> DataFrame:
        return roc_auc(self.oof, "label", "prediction")


def model_matrix(
    df: DataFrame,
    id_col: str,
    label: str,
    features: Sequence[str] | None = None,
    policy: str = SENTINEL,
    categories: str | None = None,
    categories_size: int = 0,
) -> tuple[DataFrame, list[str]]:
    """(id, label, features vector) for all rows, and the feature names.

    ``sentinel`` puts -999 for missing and infinite values. ``mean_scaled``
    fills them with the column mean and scales to [0, 1], both over labelled and
    unlabelled rows together; a column without any value is left out. ``categories`` names a
    sparse vector of ``sparse_one_hot``, which comes behind the features; its parts have no names.
    """
    if features is None:
        features = [c for c in feature_columns(df) if c not in (id_col, label, categories)]
    features = list(features)
    carried = [named(categories)] if categories else []
    data = to_finite_doubles(df.select(id_col, label, *[named(c) for c in features], *carried), features)
    if policy == SENTINEL:
        data = fill_constant(data, features, -999)
    else:
        counts = data.agg(*[F.count(named(c)).alias(f"n{i}") for i, c in enumerate(features)])
        row = counts.first()
        features = [c for i, c in enumerate(features) if row[f"n{i}"]]
        data = min_max_scale(fill_mean(data, features), features)
    # The assembler reads names with dots as paths, so columns are renumbered.
    plain = data.select(
        named(id_col),
        named(label).cast("double").alias("label"),
        *[named(c).alias(f"f{i}") for i, c in enumerate(features)],
        *[c.alias("_categories") for c in carried],
    )
    assembler = VectorAssembler(
        inputCols=[f"f{i}" for i in range(len(features))], outputCol="features"
    )
    matrix = assembler.transform(plain)
    if categories:
        matrix = matrix.select(id_col, "label", "features", "_categories")
        matrix = append_sparse(matrix, "features", len(features), "_categories", categories_size)
    return matrix.select(id_col, "label", "features"), features


def _probability(model, rows: DataFrame, name: str = "prediction") -> DataFrame:
    scored = model.transform(rows)
    p = vector_to_array(F.col("probability")).getItem(1).alias(name)
    return scored.select(*[named(c) for c in rows.columns], p)


def kfold(
    df: DataFrame,
    learner: Learner | Boosted | DenseNet,
    id_col: str,
    label: str,
    k: int = 5,
    stratified: bool = True,
    seed: int = SEED,
    features: Sequence[str] | None = None,
    parallelism: int = 1,
) -> KFoldResult:
    """Train one model per fold of the labelled rows.

    The assembled matrix is checkpointed once, so that a lost executor does not
    send every fold back to the raw tables. Training itself is distributed;
    ``parallelism`` folds may overlap on an otherwise idle cluster.
    """
    shared_dir(df.sparkSession)
    ids = df.filter(named(label).isNotNull()).select(named(id_col), named(label))
    folds = assign_folds(ids, k, id_col, label if stratified else None, seed)
    if isinstance(learner, Boosted):
        return _boosted_kfold(df, learner.settings, id_col, label, k, folds, features)
    policy = MEAN_SCALED if isinstance(learner, DenseNet) else learner.policy
    matrix, names = model_matrix(df, id_col, label, features, policy)
    matrix = matrix.join(folds.select(named(id_col), "fold"), id_col, "left")
    if isinstance(learner, DenseNet):
        matrix = net.spread(matrix, folds.count())
    matrix = cut_lineage(matrix)
    if isinstance(learner, DenseNet):
        return _net_kfold(matrix, learner.settings, id_col, len(names), k)
    train = matrix.filter("label IS NOT NULL")
    test = matrix.filter("label IS NULL").drop("label", "fold")

    def fit(fold: int):
        held_out = F.col("fold") == fold
        estimator = learner.make(fold, len(names))
        rows = train.filter(~held_out)
        if learner.patience is None:
            return estimator.fit(rows)
        held = train.filter(held_out).select("features", "label")
        return fit_patiently(estimator, rows, held, learner.patience)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        models = list(pool.map(fit, range(k)))
    parts = [
        _probability(m, train.filter(F.col("fold") == i)).drop("features")
        for i, m in enumerate(models)
    ]
    scored = test
    for i, m in enumerate(models):
        scored = _probability(m, scored, f"p{i}")
    mean = sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0")) / k
    return KFoldResult(
        oof=append_all(parts),
        test=scored.select(named(id_col), mean.alias("prediction")),
        importances=_importances(df.sparkSession, models, names),
        models=models,
        matrix=train,
    )


def _boosted_kfold(df, settings, id_col, label, k, folds, features) -> KFoldResult:
    """All folds grow in the same passes over one table of bins; AUC and loss of both parts are traced."""
    if features is None:
        features = [c for c in feature_columns(df) if c not in (id_col, label)]
    table = boosting.bin_table(df, id_col, label, features, settings.bins, folds)
    models = boosting.fit(table, [replace(settings, seed=2**i) for i in range(k)], range(k), both_parts=True)
    boosting.keep_best(models)
    train, test = table.rows.where("label IS NOT NULL"), table.rows.where("label IS NULL")
    oof = boosting.predict(table, models, train, own_fold=True)
    mean = boosting.predict(table, models, test)
    rows = [(n, float(g), m.fold + 1) for m in models for n, g in zip(table.names, m.gains(len(table.names)), strict=True)]
    return KFoldResult(
        oof=oof.withColumnRenamed("id", id_col),
        test=mean.select(F.col("id").alias(id_col), "prediction"),
        importances=df.sparkSession.createDataFrame(rows, "feature string, importance double, fold int"),
        models=models,
        matrix=train,
    )


def _net_kfold(matrix, settings, id_col, width, k) -> KFoldResult:
    models = net.fit_nets(matrix, width, [replace(settings, seed=2**i) for i in range(k)], range(k))
    train, test = matrix.filter("label IS NOT NULL"), matrix.filter("label IS NULL")
    oof = net.predict_nets(train, width, models, id_col, own_fold=True)
    mean = net.predict_nets(test, width, models, id_col)
    return KFoldResult(
        oof=oof.withColumnRenamed("id", id_col),
        test=mean.select(F.col("id").alias(id_col), "prediction"),
        importances=None,
        models=models,
        matrix=train,
    )


def _importances(spark, models, names: Sequence[str]) -> DataFrame | None:
    if not hasattr(models[0], "featureImportances"):
        return None
    rows = [
        (name, float(value), fold + 1)
        for fold, m in enumerate(models)
        for name, value in zip(names, m.featureImportances.toArray(), strict=True)
    ]
    return spark.createDataFrame(rows, "feature string, importance double, fold int")


def score_trace(result: KFoldResult) -> DataFrame:
    """Loss after every boosting round: (fold, part, iteration, loss). The library's own learners
    add ``auc`` and trace rounds past the best as well; nets trace the rows held out, by epoch."""
    rows = []
    if all(isinstance(m, boosting.Model) for m in result.models):
        rows = [(m.fold, part, r, loss, auc) for m in result.models for r, part, auc, loss in m.trace]
        schema = "fold int, part string, iteration int, loss double, auc double"
        return result.matrix.sparkSession.createDataFrame(rows, schema)
    if all(isinstance(m, net.NetModel) for m in result.models):
        rows = [(m.fold, "valid", r, loss, auc) for m in result.models for r, auc, loss in m.trace]
        schema = "fold int, part string, iteration int, loss double, auc double"
        return result.matrix.sparkSession.createDataFrame(rows, schema)
    for fold, model in enumerate(result.models):
        held_out = F.col("fold") == fold
        for part, where in (("train", ~held_out), ("valid", held_out)):
            losses = model.evaluateEachIteration(result.matrix.filter(where))
            rows += [(fold, part, i + 1, float(v)) for i, v in enumerate(losses)]
    schema = "fold int, part string, iteration int, loss double"
    return result.matrix.sparkSession.createDataFrame(rows, schema)


# Parameters that are shares, that can't be negative, and that are whole.
SHARES = ("subsample", "colsample_bytree", "colsample_bylevel")
NOT_NEGATIVE = ("reg_alpha", "reg_lambda", "alpha", "_lambda")
WHOLE = ("num_leaves", "max_depth", "min_data_in_leaf")


def clip_params(params: Mapping[str, float]) -> dict[str, float]:
    """Bring proposed hyper-parameters into the range their learner accepts."""
    out = dict(params)
    for name in set(out).intersection(SHARES):
        out[name] = max(min(out[name], 1.0), 0.0)
    for name in set(out).intersection(NOT_NEGATIVE):
        out[name] = max(out[name], 0.0)
    for name in set(out).intersection(WHOLE):
        out[name] = int(out[name])
    return out


def clip_columns(proposals: DataFrame) -> DataFrame:
    """``clip_params`` for a table of proposals with a column per parameter; missing values stay so."""
    clipped = {n: F.when(F.col(n).isNotNull(), F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0))) for n in SHARES}
    clipped |= {n: F.when(F.col(n).isNotNull(), F.greatest(n, F.lit(0.0))) for n in NOT_NEGATIVE}
    clipped |= {n: F.col(n).cast("int") for n in WHOLE}
    return proposals.withColumns({n: e for n, e in clipped.items() if n in proposals.columns})
