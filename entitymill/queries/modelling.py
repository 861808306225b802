"""Folds, models, ranking quality and blending on whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from entitymill.operators import blend as bl
from entitymill.operators import boosting
from entitymill.operators import models as md
from entitymill.operators.aggregate import entity_agg
from entitymill.operators.attach import attach, join_predictions
from entitymill.operators.folds import assign_folds
from entitymill.operators.metrics import roc_auc
from entitymill.operators.search import LEAF_WISE_BASE, LEAF_WISE_BOUNDS, boosted_search, search
from entitymill.queries import derived
from entitymill.queries import sqltext as sql
from entitymill.queries.base import cte, frame, query, stable, stable_sql
from entitymill.sources.staging import written

# ---- folds -----------------------------------------------------------------

PEOPLE = {
    "id": "c_custkey",
    "target": "case when c_mktsegment = 'BUILDING' then null when c_acctbal < 1500 then 1 else 0 end",
    "region": "c_nationkey",
}
PEOPLE_SQL = cte("customer", PEOPLE) + " where c_mktsegment <> 'BUILDING'"


def people(t):
    return frame(t.customer, PEOPLE).filter("target IS NOT NULL")


def _fold_sql(partition: str, k: int) -> str:
    order = "md5('47-' || cast(id as varchar)), id"
    return (
        f"select id, cast((row_number() over ({partition} order by {order}) - 1) % {k} as int) as fold"
        f" from ({PEOPLE_SQL}) s"
    )


@query("ml1_folds_stratified", _fold_sql("partition by target", 10))
def _(t):
    return assign_folds(people(t), 10, "id", "target").select("id", "fold")


@query("ml1_folds_plain", _fold_sql("", 5))
def _(t):
    return assign_folds(people(t), 5, "id").select("id", "fold")


# ---- scores: order price and month as two models of the order status --------

SCORES = {
    "id": "o_orderkey",
    "target": "case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end",
    "first": "o_totalprice / (o_totalprice + 200000)",
    "second": "extract(month from o_orderdate) / cast(13 as double)",
    "part": "o_orderpriority",
}
SCORES_SQL = cte("orders", SCORES)
BLEND = {"id": "id", "target": "target", "score": "0.5 * first + 0.5 * second", "part": "part"}
BLEND_SQL = cte(f"({SCORES_SQL}) b", BLEND)


def scores(t):
    return frame(t.orders, SCORES)


def blended(t):
    return frame(scores(t), BLEND)


@query(
    "ml6_auc_full",
    f"select {stable_sql('auc')} as auc from ({sql.auc(BLEND_SQL, 'target', 'score')}) s",
)
def _(t):
    return stable(roc_auc(blended(t), "target", "score"))


@query(
    "ml6_auc_by_group",
    f"select part, {stable_sql('auc')} as auc from"
    f" ({sql.auc(SCORES_SQL, 'target', 'second', ['part'])}) s",
)
def _(t):
    return stable(roc_auc(scores(t), "target", "second", ["part"]))


# Predictions of the first model for finished orders, of the second for all.
def prediction_sets(t):
    df = scores(t)
    first = df.filter("part <> '5-LOW'").select("id", F.col("first").alias("OOF_PRED"))
    return df, {"a": first, "b": df.select("id", F.col("second").alias("OOF_PRED"))}


@query(
    "j7_predictions_to_labels",
    f"select id, target, {stable_sql('first')} as a, {stable_sql('second')} as b from"
    f" ({SCORES_SQL}) s where target is not null and part <> '5-LOW'",
)
def _(t):
    df, sets = prediction_sets(t)
    return stable(join_predictions(df.select("id", "target"), sets, "id"))


@query(
    "j8_match_by_id",
    f"select id, {stable_sql('first')} as a, {stable_sql('second')} as b from ({SCORES_SQL}) s"
    " where part <> '5-LOW'",
)
def _(t):
    _, sets = prediction_sets(t)
    return stable(join_predictions(sets["a"].select("id"), sets, "id"))


@query(
    "b1_blend",
    f"select id, case when part <> '5-LOW' then {stable_sql('0.3::double * first + 0.7::double * second')} end"
    f' as "TARGET" from ({SCORES_SQL}) s',
)
def _(t):
    """The first model lacks some ids, which stay in the list."""
    df = scores(t)
    sets = {c: df.select("id", "part", F.col(c).alias("TARGET")) for c in ("first", "second")}
    sets["first"] = sets["first"].filter("part <> '5-LOW'")
    return stable(bl.blend(sets, [0.3, 0.7], "id", ids=df.select("id")))


# ---- thresholds ------------------------------------------------------------

LOW_GRID = "i * 0.0001::double"
HIGH_GRID = "0.9::double + i * ((0.9::double + 0.0001::double) - 0.9::double)"


def _scan_sql(side: str, source: str) -> str:
    """AUC per quantile level, from sums over the scores that are cut."""
    cut = "score < t" if side == "low" else "score > t"
    grid = LOW_GRID if side == "low" else HIGH_GRID
    kept_neg = "0" if side == "low" else "(q - coalesce(nm, 0))"
    return (
        f"with s as (select * from ({source}) x where target is not null),"
        " g as (select score, cast(count(*) filter (where target = 1) as double) as pos,"
        " cast(count(*) filter (where target = 0) as double) as neg from s group by score),"
        " c as (select *, sum(neg) over (order by score) - neg as below from g),"
        " tot as (select sum(pos) as p, sum(neg) as q, sum(pos * (below + neg / 2)) as u from c),"
        " o as (select list(score order by score) as v, count(*) as n from s),"
        f" lv as (select {grid} as level from range(0, 1001) r(i)),"
        " ps as (select level, level * (n - 1) as spot, v from lv, o),"
        " th as (select level, v[floor(spot)::bigint + 1] + (v[ceil(spot)::bigint + 1] -"
        " v[floor(spot)::bigint + 1]) * (spot - floor(spot)) as t from ps),"
        " cu as (select level, t, sum(pos) as pm, sum(neg) as nm, sum(pos * (below + neg / 2)) as um"
        f" from th left join c on {cut} group by level, t)"
        f" select level, t as threshold, (u - (coalesce(um, 0) - coalesce(pm, 0) * {kept_neg}) +"
        " coalesce(pm * nm / 2, 0)) / (p * q) as auc from cu, tot"
    )


def _rounded_scan(side: str) -> str:
    cols = ", ".join(f"{stable_sql(c)} as {c}" for c in ("level", "threshold", "auc"))
    return f"select {cols} from ({_scan_sql(side, BLEND_SQL)}) z"


@query("b2_low_threshold_scan", _rounded_scan("low"))
def _(t):
    return stable(bl.threshold_scan(blended(t), "target", "score", "low"))


@query("b2_high_threshold_scan", _rounded_scan("high"))
def _(t):
    return stable(bl.threshold_scan(blended(t), "target", "score", "high"))


def _best(side: str, source: str) -> str:
    return f"select level, threshold from ({_scan_sql(side, source)}) z where auc > 0 order by auc desc, level limit 1"


def _cut_sql(mode: str) -> str:
    pick = "level" if mode == "level_as_value" else "threshold"
    low = f"select {pick} from ({_best('low', BLEND_SQL)}) l"
    lowered = (
        f"select id, target, case when score < ({low}) then 0 else score end as score"
        f" from ({BLEND_SQL}) y"
    )
    high = f"select {pick} from ({_best('high', lowered)}) h"
    cut = f"case when score < ({low}) then 0 when score > ({high}) then 1 else score end"
    return f"select id, {stable_sql('score')} as score from (select id, {cut} as score from ({BLEND_SQL}) w) v"


def _thresholds(mode: str):
    @query(f"b3_cut_by_{mode}", _cut_sql(mode))
    def _(t):
        df = blended(t)
        cutoffs = bl.find_cutoffs(df, "target", "score", mode)
        return stable(bl.cut_by(df, "score", cutoffs, mode).select("id", "score"))


_thresholds("level_as_value")
_thresholds("quantile_value")

WEIGHTS = [i / 20 for i in range(21)]
MIXES = (
    f"select w, target, w * first + (1 - w) * second as score from ({SCORES_SQL}) s,"
    f" (select unnest({WEIGHTS})::double as w) g"
)


@query(
    "b4_weight_scan",
    f"select {stable_sql('w')} as weight, {stable_sql('auc')} as auc from"
    f" ({sql.auc(MIXES, 'target', 'score', ['w'])}) s",
)
def _(t):
    return stable(bl.weight_scan(scores(t), "target", "first", "second", WEIGHTS))


# A population by rule: weights in fifths, cuts at the ends and inside the published bounds.
MIXED = [
    bl.Mix((i % 6 / 5, 1 - i % 6 / 5), (0.02 * (i % 5), 0.1 - 0.02 * (i % 4)), (1 - 0.03 * (i % 4), 0.9 + 0.02 * (i % 6)), 0.01 * (i % 11), 1 - 0.01 * (i % 9))
    for i in range(60)
]


def _mixes_sql() -> str:
    rows = ", ".join(f"({i}, {', '.join(f'{x!r}::double' for x in (*m.weights, *m.lows, *m.highs, m.low, m.high))})" for i, m in enumerate(MIXED))
    cut = "case when {x} < {lo} then 0 when {x} > {hi} then 1 else {x} end"
    total = f"w1 * ({cut.format(x='first', lo='l1', hi='h1')}) + w2 * ({cut.format(x='second', lo='l2', hi='h2')})"
    mixed = (
        f"select mix, target, {cut.format(x='total', lo='l', hi='h')} as score from (select mix, target, l, h, {total} as total"
        f" from ({SCORES_SQL}) s, (values {rows}) v(mix, w1, w2, l1, l2, h1, h2, l, h)) z"
    )
    auc = f"select mix, auc, auc = max(auc) over () as best from ({sql.auc(mixed, 'target', 'score', ['mix'])}) a"
    return f"select mix, {stable_sql('auc')} as auc, best from ({auc}) b"


@query("b4_rated_mixes", _mixes_sql())
def _(t):
    """Weights and all cuts of two models, rated together; the best is marked."""
    ranks = bl.rank_table(scores(t), "target", ["first", "second"])
    rated = {r["mix"]: r["auc"] for r in bl.rate_mixes(ranks, MIXED).collect()}
    rows = [(mix, auc, auc == max(rated.values())) for mix, auc in rated.items()]
    return stable(t.spark.createDataFrame(rows, "mix int, auc double, best boolean"))


@query("b4_joint_optimum", f"select id, true as in_range from ({SCORES_SQL}) s")
def _(t):
    """The best mix by differential evolution, applied; it is rated no lower than any of a fixed population's first."""
    found = bl.search_mix(scores(t), "target", ["first", "second"], generations=4, members=20)
    alone = bl.rate_mixes(bl.rank_table(scores(t), "target", ["first", "second"]), [bl.Mix((1.0, 0.0), (0.0, 0.0), (1.0, 1.0))]).first()["auc"]
    mixed = bl.apply_mix(scores(t), ["first", "second"], found.best, "mixed")
    good = found.auc >= alone - 0.01
    return mixed.select("id", (F.col("mixed").between(0, 1) & F.lit(good)).alias("in_range"))


# ---- models: customers, with statistics of their orders ---------------------

SIGNALS = [
    "DAYS_BIRTH", "DAYS_EMPLOYED", "AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_2",
    "CNT_FAM_MEMBERS", "OWN_CAR_AGE",
]
HISTORY = {"AMT_CREDIT_SUM": ["mean", "max", "var", "skew"], "DAYS_CREDIT": ["min", "mean"]}
ID = "SK_ID_CURR"


def model_frame(t):
    d = derived.tables(t)
    base = d["application"].select(ID, "TARGET", *SIGNALS)
    return attach(base, entity_agg(d["bureau"], ID, HISTORY, "BURO_"), ID)


HISTORY_SQL = sql.aggregate(derived.SQL["bureau"], ID, HISTORY, "BURO_", rounded=False)
FRAME_SQL = (
    f'select "{ID}", "TARGET", {", ".join(SIGNALS)}, h.* exclude ("{ID}") from'
    f" ({derived.SQL['application']}) a left join ({HISTORY_SQL}) h using (\"{ID}\")"
)
INPUTS = SIGNALS + [f"BURO_{c}_{s.upper()}" for c, stats in HISTORY.items() for s in stats]


def _matrix(policy: str, expression: str):
    columns = ", ".join(f"{stable_sql(expression.format(c=f'"{c}"'))} as \"{c}\"" for c in INPUTS)

    @query(
        f"ml10_matrix_{policy}",
        f'select "{ID}", "TARGET" as label, {columns} from ({FRAME_SQL}) f',
    )
    def _(t):
        matrix, names = md.model_matrix(model_frame(t), ID, "TARGET", policy=policy)
        values = vector_to_array("features")
        return stable(
            matrix.select(ID, "label", *[values[i].alias(c) for i, c in enumerate(names)])
        )


_matrix(md.SENTINEL, "coalesce({c}, -999)")
_matrix(
    md.MEAN_SCALED,
    "(coalesce({c}, avg({c}) over ()) - min({c}) over ()) / (max({c}) over () - min({c}) over ())",
)

# ---- learners: orders, with a label that the price decides ---------------------

# The number of rounds and trees differs from the published settings, and so do the net's
# layers: (8, 8) for (1000, 1000, 1000). With so few rounds patience ends no fit early; it
# only picks the best round. The checks
# state what must hold of any right model: who gets a prediction, in which fold, within
# [0, 1], and that the deciding column is found.
DEAL = {
    "id": "o_orderkey",
    "target": "cast(case when o_orderstatus = 'P' then null when o_totalprice > 200000 then 1 else 0 end as double)",
    "price": "o_totalprice",
    "month": "cast(extract(month from o_orderdate) as double)",
    "day": "cast(extract(day from o_orderdate) as double)",
    "customer": "cast(o_custkey % 97 as double)",
}
DEAL_SQL = cte("orders", DEAL)
DECIDES = "price"
GOOD_AUC = 0.9


def deals(t):
    return frame(t.orders, DEAL)


def _deal_folds(k: int) -> str:
    order = "md5('47-' || cast(id as varchar)), id"
    return (
        f"select id, target as label, cast((row_number() over (partition by target order by {order}) - 1)"
        f" % {k} as int) as fold from ({DEAL_SQL}) s where target is not null"
    )


def _facts(k: int) -> str:
    return f"select id, label, fold, true as in_range, true as good_auc from ({_deal_folds(k)}) f"


def _oof(result: md.KFoldResult):
    """Every labelled row with its fold, its prediction's range and its fold's AUC; rows are scored once."""
    result = replace(result, oof=written(result.oof))
    good = result.fold_auc().select("fold", (F.col("auc") > GOOD_AUC).alias("good_auc"))
    in_range = F.col("prediction").between(0, 1).alias("in_range")
    return result.oof.join(good, "fold").select("id", "label", "fold", in_range, "good_auc")


@query("ml2_leaf_wise_gbt", _facts(3))
def _(t):
    return _oof(md.kfold(deals(t), md.boosted_leaf_wise(rounds=12), "id", "target", k=3))


@query("ml3_depth_wise_gbt", f"select id, true as in_range from ({DEAL_SQL}) s where target is null")
def _(t):
    result = md.kfold(deals(t), md.boosted_depth_wise(rounds=4), "id", "target", k=2)
    return result.test.select("id", F.col("prediction").between(0, 1).alias("in_range"))


# ---- first trees, number by number: every value of a feature has a bin of its own ------

GROWN = {
    "id": "o_orderkey",
    "target": "cast(case when o_orderstatus = 'P' then null when o_totalprice + (o_custkey % 50) * 2000 > 220000 then 1 else 0 end as double)",
    "price": "case when o_orderkey % 11 = 0 then null else floor(o_totalprice / 5000) end",
    "customer": "case when o_custkey % 5 = 0 then null else o_custkey % 50 end",
    "month": "cast(extract(month from o_orderdate) as double)",
    "missing_if_high": "case when o_totalprice > 180000 then null else cast(o_orderkey % 3 as double) end",
}
GROWN_FEATURES = list(GROWN)[2:]
TREE = {"rounds": 1, "max_depth": 2, "max_leaves": 4, "by_tree": 1.0, "subsample": 1.0, "rate": 0.1}
LEAF_WISE_TREE = replace(boosting.LEAF_WISE, min_rows=60, **TREE)
DEPTH_WISE_TREE = replace(boosting.DEPTH_WISE, min_weight=35.563, alpha=9.848, lam=3.286, min_gain=0.666, **TREE)


def _node_sql(s: boosting.Settings, source: str, name: str) -> str:
    """CTEs with the sums, the best split and the two halves of a node's rows."""

    def score(g: str, h: str) -> str:
        pulled = f"greatest(abs({g} / {boosting.UNIT}) - {s.alpha}::double, 0)"
        return f"({pulled} * {pulled} / ({h} / {boosting.UNIT} + {s.lam}::double))"

    long = " union all ".join(f"select {i} as f, {c} as v, g, h from {source}" for i, c in enumerate(GROWN_FEATURES))
    least = f"{s.min_weight * boosting.UNIT}::double"
    side = " or ".join(f"(f = {i} and (({c} is null and missing_left) or {c} <= cut))" for i, c in enumerate(GROWN_FEATURES))
    return (
        f"{name}_t as materialized (select sum(g)::double as g, sum(h)::double as h, count(*) as n from {source}),"
        f" {name}_v as (select f, v, sum(g) as g, sum(h) as h, count(*) as n from ({long}) x group by f, v),"
        f" {name}_c as (select c.f, c.i, c.cut, sum(coalesce(x.g, 0)) over w as g, sum(coalesce(x.h, 0)) over w as h,"
        f" sum(coalesce(x.n, 0)) over w as n from cuts c left join {name}_v x on c.f = x.f and c.v = x.v"
        " window w as (partition by c.f order by c.i)),"
        f" {name}_b as (select c.f, c.i, c.cut, m.missing_left, (c.g + case when m.missing_left then coalesce(x.g, 0) else 0 end)::double as g,"
        " (c.h + case when m.missing_left then coalesce(x.h, 0) else 0 end)::double as h,"
        " c.n + case when m.missing_left then coalesce(x.n, 0) else 0 end as n"
        f" from {name}_c c left join {name}_v x on c.f = x.f and x.v is null, (select unnest([true, false]) as missing_left) m),"
        f" {name}_s as materialized (select b.f, b.cut, b.missing_left, {score('b.g', 'b.h')} + {score('(t.g - b.g)', '(t.h - b.h)')} - {score('t.g', 't.h')} as gain"
        f" from {name}_b b, {name}_t t where b.n >= {max(s.min_rows, 1)} and t.n - b.n >= {max(s.min_rows, 1)}"
        f" and b.h >= {least} and t.h - b.h >= {least}"
        f" qualify gain > {max(s.min_gain, 1e-9)} and row_number() over (order by gain desc, f, b.i, missing_left desc) = 1),"
        f" {name}l as materialized (select r.* from {source} r, {name}_s where {side}),"
        f" {name}r as materialized (select r.* from {source} r, {name}_s where not coalesce({side}, false))"
    )


def _tree_sql(s: boosting.Settings) -> str:
    start = "(1 / (1 + exp(-ln(q / (1 - q)))))" if s.from_average else "0.5::double"
    values = " union ".join(f"select {i} as f, {c} as v from d where {c} is not null" for i, c in enumerate(GROWN_FEATURES))
    names = "case f " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(GROWN_FEATURES)) + " end"

    def inner(name: str, path: str) -> str:
        return f"select '{path}' as path, {names} as feature, cut, missing_left, gain, null::double as value from {name}_s"

    def leaf(rows: str, path: str, split: str | None) -> str:
        g, h = f"sum(g) / {boosting.UNIT}::double", f"sum(h) / {boosting.UNIT}::double"
        value = f"-{s.rate}::double * sign({g}) * greatest(abs({g}) - {s.alpha}::double, 0) / ({h} + {s.lam}::double)"
        none = f" having count(*) > 0 and not exists (select 1 from {split}_s)" if split else " having count(*) > 0"
        return f"select '{path}', null, null, null, null, {value} from {rows}{none}"

    rows = [inner("n", ""), inner("nl", "L"), inner("nr", "R"), leaf("nl", "L", "nl"), leaf("nr", "R", "nr")]
    rows += [leaf(f"n{path.lower()}", path, None) for path in ("LL", "LR", "RL", "RR")]
    columns = ", ".join(["path", "feature", f"{stable_sql('cut')} as cut", "case when missing_left then 'left' when not missing_left then 'right' end as missing_to", f"{stable_sql('gain')} as gain", f"{stable_sql('value')} as value"])
    text = (
        f"with d as materialized (select * from ({cte('orders', GROWN)}) x where target is not null),"
        f" p as (select {start} as p from (select avg(target) as q from d) z),"
        f" root as materialized (select d.*, round((p - target) * {boosting.UNIT})::bigint as g, round(p * (1 - p) * {boosting.UNIT})::bigint as h from d, p),"
        f" cuts as materialized (select f, v, row_number() over (partition by f order by v) as i,"
        f" coalesce(v / 2 + lead(v) over (partition by f order by v) / 2, 'inf'::double) as cut from ({values}) x), "
    )
    text += ", ".join([_node_sql(s, "root", "n"), _node_sql(s, "nl", "nl"), _node_sql(s, "nr", "nr")])
    return f"{text} select {columns} from ({' union all '.join(rows)}) o"


def _first_tree(name: str, settings: boosting.Settings):
    @query(name, _tree_sql(settings))
    def _(t):
        table = boosting.bin_table(frame(t.orders, GROWN), "id", "target", GROWN_FEATURES)
        model = boosting.fit(table, [settings], [None])[0]
        rows = boosting.tree_table(table, model, 0)
        side = {True: "left", False: "right", None: None}
        rows = [(r["path"], r["feature"], r["cut"], side[r["missing_left"]], r["gain"], None if r["feature"] else r["value"]) for r in rows]
        schema = "path string, feature string, cut double, missing_to string, gain double, value double"
        return stable(t.spark.createDataFrame(rows, schema))


# Every third label is turned over, so more rounds soon learn what doesn't hold for other rows.
NOISY = {**GROWN, "target": f"case when o_orderkey % 3 = 0 then 1 - ({GROWN['target']}) else {GROWN['target']} end"}
IMPATIENT = boosting.Settings(rounds=40, rate=1.0, max_leaves=12, max_depth=4, min_rows=5, patience=2, seed=3)


@query(
    "ml2_patience",
    "select fold, true as ended_early, true as waited, true as kept_best, true as traced from (select unnest([0, 1, 2])::int as fold) f",
)
def _(t):
    """Fits that their patience ends: so many rounds after the best one, which is kept."""
    rows = frame(t.orders, NOISY)
    table = boosting.bin_table(rows, "id", "target", GROWN_FEATURES, folds=rows.selectExpr("id", "cast(id % 3 as int) as fold"))
    models = boosting.fit(table, [IMPATIENT] * 3, range(3), both_parts=True)
    boosting.keep_best(models)
    found = []
    for m in models:
        valid = {r: auc for r, part, auc, _ in m.trace if part == "valid"}
        train = {r: auc for r, part, auc, _ in m.trace if part == "train"}
        last, best = max(valid), max(valid, key=lambda r: (valid[r], -r))
        waited = IMPATIENT.patience <= last - best < IMPATIENT.patience + boosting.LOOK
        found.append((m.fold, last < IMPATIENT.rounds, waited, len(m.trees) == best, train[last] > train[1]))
    return t.spark.createDataFrame(found, "fold int, ended_early boolean, waited boolean, kept_best boolean, traced boolean")


_first_tree("ml2_first_tree", LEAF_WISE_TREE)
_first_tree("ml3_first_tree", DEPTH_WISE_TREE)


@query("ml4_random_forest", _facts(3))
def _(t):
    return _oof(md.kfold(deals(t), md.random_forest(numTrees=20), "id", "target", k=3))


@query("ml5_dense_net", _facts(2))
def _(t):
    learner = md.dense_net(hidden=(8, 8), maxIter=60)
    return _oof(md.kfold(deals(t), learner, "id", "target", k=2))


@query("ml5_published_net", _facts(2))
def _(t):
    """The published layers, dropout, penalty and rate, for a few epochs."""
    return _oof(md.kfold(deals(t), md.relu_net(epochs=3), "id", "target", k=2))


@query(
    "ml7_published_search",
    "select trial, true as in_bounds, trial < 15 as random, true as at_most_best from (select unnest(range(40))::int as trial) s",
)
def _(t):
    """15 random and 25 guided trials over the published bounds, of few rounds; losing trials end after the first."""
    base = replace(LEAF_WISE_BASE, rounds=3)
    found = boosted_search(deals(t), "id", "target", base=base, k=3, guided_at_once=25, stages=(1,))
    inside = F.lit(True)
    for c, (lo, hi) in LEAF_WISE_BOUNDS.items():
        inside = inside & F.col(c).between(lo, hi)
    is_best = F.lit(True)
    for c, v in found.best.items():
        is_best = is_best & (F.col(c) == v)
    top = found.trials.agg(F.max(F.when(is_best, F.col("auc"))).alias("best")).first()["best"]
    return found.trials.select("trial", inside.alias("in_bounds"), (F.col("trial") < 15).alias("random"), (F.col("auc") <= top).alias("at_most_best"))


@query(
    "ml7_search",
    "select trial, true as in_bounds, true as best_is_highest, true as good_auc from"
    " (select unnest(range(3))::int as trial) s",
)
def _(t):
    bounds = {"max_depth": (2, 4), "subsample": (0.5, 1), "min_split_gain": (0, 1)}
    found = search(deals(t), "id", "target", bounds, k=2, init_points=2, n_iter=1, maxIter=4)
    inside = F.lit(True)
    for c, (lo, hi) in bounds.items():
        inside = inside & F.col(c).between(lo, hi)
    is_best = F.lit(True)
    for c, v in found.best.items():
        is_best = is_best & (F.col(c) == v)
    auc = found.trials.agg(F.max("auc").alias("top"), F.max(F.when(is_best, F.col("auc"))).alias("best")).first()
    return found.trials.select(
        "trial",
        inside.alias("in_bounds"),
        F.lit(auc["best"] == auc["top"]).alias("best_is_highest"),
        (F.col("auc") > GOOD_AUC).alias("good_auc"),
    )


@query(
    "ml8_score_trace",
    "select fold, part, true as all_rounds, true as falls from (select unnest([0, 1])::int as fold) f,"
    " (select unnest(['train', 'valid']) as part) p",
)
def _(t):
    result = md.kfold(deals(t), md.leaf_wise_gbt(maxIter=8, patience=8), "id", "target", k=2)
    rounds = {fold: m.getNumTrees for fold, m in enumerate(result.models)}
    first, last = (F.min_by("loss", order).alias(n) for n, order in (("first", F.col("iteration")), ("last", -F.col("iteration"))))
    found = md.score_trace(result).groupBy("fold", "part").agg(F.collect_set("iteration").alias("r"), first, last)
    wanted = F.when(F.col("fold") == 0, F.lit(rounds[0])).otherwise(F.lit(rounds[1]))
    all_rounds = F.sort_array("r") == F.sequence(F.lit(1), wanted)
    return found.select("fold", "part", all_rounds.alias("all_rounds"), (F.col("last") <= F.col("first")).alias("falls"))


STUMP = replace(LEAF_WISE_TREE, max_depth=1, max_leaves=2)
HALF = "cast(id % 2 as int)"


def _stump_trace_sql(fold: int) -> str:
    """AUC and loss of both parts after one split, which one half of the rows decides."""
    s = STUMP
    values = " union ".join(f"select {i} as f, {c} as v from d where {c} is not null" for i, c in enumerate(GROWN_FEATURES))
    side = " or ".join(f"(f = {i} and (({c} is null and missing_left) or {c} <= cut))" for i, c in enumerate(GROWN_FEATURES))

    def value(rows: str) -> str:
        g, h = f"sum(g) / {boosting.UNIT}::double", f"sum(h) / {boosting.UNIT}::double"
        return f"(select -{s.rate}::double * sign({g}) * greatest(abs({g}) - {s.alpha}::double, 0) / ({h} + {s.lam}::double) from {rows})"

    auc = sql.auc("select part, target, margin from scored", "target", "margin", ["part"])
    return (
        f"select {fold} as fold, * from (with d as materialized (select *, {HALF} as fold from ({cte('orders', GROWN)}) x where target is not null),"
        f" b as (select ln(q / (1 - q)) as base, 1 / (1 + exp(-ln(q / (1 - q)))) as p from (select avg(target) as q from d where fold <> {fold}) z),"
        f" root as materialized (select d.*, round((p - target) * {boosting.UNIT})::bigint as g, round(p * (1 - p) * {boosting.UNIT})::bigint as h from d, b where fold <> {fold}),"
        " cuts as materialized (select f, v, row_number() over (partition by f order by v) as i,"
        f" coalesce(v / 2 + lead(v) over (partition by f order by v) / 2, 'inf'::double) as cut from ({values}) x), "
        + _node_sql(s, "root", "n")
        + f", scored as materialized (select d.target, case when d.fold = {fold} then 'valid' else 'train' end as part,"
        f" base + case when {side} then {value('nl')} else {value('nr')} end as margin from d, b, n_s),"
        " losses as (select part, avg(ln(1 + exp(case when target = 1 then -margin else margin end))) as loss from scored group by part)"
        f" select part, 1 as iteration, {stable_sql('loss')} as loss, {stable_sql('auc')} as auc from losses join ({auc}) a using (part)) t"
    )


@query("ml8_auc_trace", " union all ".join(_stump_trace_sql(fold) for fold in (0, 1)))
def _(t):
    rows = frame(t.orders, GROWN)
    table = boosting.bin_table(rows, "id", "target", GROWN_FEATURES, folds=rows.selectExpr("id", f"{HALF} as fold"))
    models = boosting.fit(table, [STUMP, STUMP], [0, 1], both_parts=True)
    found = [(m.fold, part, r, loss, auc) for m in models for r, part, auc, loss in m.trace]
    return stable(t.spark.createDataFrame(found, "fold int, part string, iteration int, loss double, auc double"))


@query(
    "ml9_importances",
    f"select fold, true as adds_up, '{DECIDES}' as first, 4::bigint as features from"
    " (select unnest([1, 2])::int as fold) f",
)
def _(t):
    found = md.kfold(deals(t), md.random_forest(numTrees=20), "id", "target", k=2).importances
    return found.groupBy("fold").agg(
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_up"),
        F.max_by("feature", "importance").alias("first"),
        F.count(F.lit(1)).alias("features"),
    )


@query("x18_clip_parameters", "select 0.0::double as reg_alpha, 3 as max_depth, 1.0::double as subsample")
def _(t):
    """The bounds applied to parameters that come from the data: highest and lowest value."""
    row = t.customer.agg(F.max("c_acctbal").alias("hi"), F.min("c_acctbal").alias("lo")).first()
    clipped = md.clip_params({"reg_alpha": row["lo"], "max_depth": 3.9, "subsample": row["hi"]})
    return t.spark.createDataFrame(
        [(clipped["reg_alpha"], clipped["max_depth"], clipped["subsample"])], "reg_alpha double, max_depth int, subsample double"
    )


CLIPPED = {
    "subsample": "least(greatest(c_acctbal / 5000, 0), 1)", "reg_alpha": "greatest(c_acctbal / 5000, 0)",
    "num_leaves": "cast(trunc(c_acctbal / 5000) as int)", "learning_rate": "c_acctbal / 5000",
}


@query(
    "x18_clip_columns",
    "select c_custkey as id, " + ", ".join(f"{stable_sql(e)} as {n}" if "trunc" not in e else f"{e} as {n}" for n, e in CLIPPED.items()) + " from customer",
)
def _(t):
    """A proposal per customer, each parameter a column."""
    proposals = t.customer.select(F.col("c_custkey").alias("id"), *[(F.col("c_acctbal") / 5000).alias(n) for n in CLIPPED])
    return stable(md.clip_columns(proposals))
