"""Blending predictions, and cutting their ends to 0 and 1."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitymill.functions.scalar import blend_of, named, num, to_binary_ends
from entitymill.operators.attach import append_all, join_predictions
from entitymill.operators.metrics import roc_auc, score_table
from entitymill.operators.ordered import pick_quantiles, prefix_sums
from entitymill.sources.staging import cut_lineage, share_code, written

# The quantile levels tried on either side.
LOW_LEVELS = (0.0, 0.10001, 0.0001)
HIGH_LEVELS = (0.9, 1.0001, 0.0001)
MODES = ("level_as_value", "quantile_value")


def levels(start: float, stop: float, step: float) -> list[float]:
    return [float(q) for q in np.arange(start, stop, step)]


def blend(
    frames: Mapping[str, DataFrame],
    weights: Sequence[float],
    id_col: str,
    prediction: str = "TARGET",
    ids: DataFrame | None = None,
) -> DataFrame:
    """Weighted sum of several prediction sets, matched by id.

    The result has a row for every id of ``ids``, or of any set if none is given; it
    is missing where a set has no prediction for the id.
    """
    names = list(frames)
    if ids is None:
        base = append_all([f.select(named(id_col)) for f in frames.values()]).distinct()
    else:
        base = ids.select(named(id_col))
    joined = join_predictions(base, frames, id_col, prediction, drop_incomplete=False)
    return joined.select(named(id_col), blend_of(names, weights).alias(prediction))


def threshold_scan(
    df: DataFrame, label: str, score: str, side: str, grid: Sequence[float] | None = None
) -> DataFrame:
    """AUC after cutting at each quantile level: (level, threshold, auc).

    ``side="low"`` sets scores below the threshold to 0, ``"high"`` sets scores
    above it to 1. The cut rows become one tied group at the end of the order,
    so each AUC follows from running totals up to the threshold; the scores are
    sorted once for all levels. Scores must lie in [0, 1].
    """
    if side not in ("low", "high"):
        raise ValueError(f"side must be 'low' or 'high', not {side!r}")
    grid = list(grid) if grid is not None else levels(*(LOW_LEVELS if side == "low" else HIGH_LEVELS))
    table = score_table(df, label, score).withColumn("n", F.col("pos") + F.col("neg"))
    sums = {"n_before": F.col("n"), "pos_before": F.col("pos"), "neg_before": F.col("neg")}
    ranked = _running_won(prefix_sums(table, [], ["score"], sums, keep_chunk=True))
    ranked = cut_lineage(ranked)
    ends = ranked.agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    ).first()
    if ends["lo"] is not None and (ends["lo"] < 0 or ends["hi"] > 1):
        raise ValueError(f"scores must lie in [0, 1], found {ends['lo']} to {ends['hi']}")
    p, q = (F.lit(float(ends[c] or 0)) for c in ("pos", "neg"))
    payload = ["score", "pos", "neg", "won", "pos_before", "neg_before", "won_before", "won_all"]
    points = pick_quantiles(ranked, [], "score", "n", "n_before", grid, payload)
    u = F.col("won_all_lo")

    def upto(name: str):
        """Running total over the scores that do not pass the threshold."""
        lo, lo_before = F.col(f"{name}_lo"), F.col(f"{name}_before_lo")
        hi, hi_before = F.col(f"{name}_hi"), F.col(f"{name}_before_hi")
        t = F.col("quantile")
        if side == "low":  # scores strictly under the threshold
            return F.when(t > F.col("score_lo"), lo_before + lo).otherwise(lo_before)
        return F.when(t >= F.col("score_hi"), hi_before + hi).otherwise(lo_before + lo)

    pos, neg, inner = upto("pos"), upto("neg"), upto("won")
    if side == "high":
        inner = u - inner - (p - pos) * neg
        pos, neg = p - pos, q - neg
    auc = F.try_divide(u - inner + pos * neg / 2, p * q)
    return points.select("level", F.col("quantile").alias("threshold"), auc.alias("auc"))


def _running_won(ranked: DataFrame) -> DataFrame:
    """Add won pairs per score, their sum over lower scores, and over all."""
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    rows = ranked.withColumn("won", won)
    inside = Window.partitionBy("_chunk").orderBy("score")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(F.lit(0))
    offsets = rows.groupBy(F.col("_chunk").alias("_c")).agg(F.sum("won").alias("_won"))
    offsets = offsets.select(
        "_c",
        (F.sum("_won").over(chunks.orderBy("_c")) - F.col("_won")).alias("_off"),
        F.sum("_won").over(chunks).alias("won_all"),
    )
    rows = rows.withColumn("_in", F.coalesce(F.sum("won").over(before), F.lit(0.0)))
    # One row per chunk, so at most as many as there are shuffle partitions.
    rows = rows.join(F.broadcast(offsets), F.col("_chunk") == F.col("_c"))
    return rows.withColumn("won_before", F.col("_in") + F.col("_off")).drop("_in", "_off", "_c")


@dataclass(frozen=True)
class Cutoffs:
    low_level: float | None
    low_threshold: float | None
    high_level: float | None
    high_threshold: float | None


def best_level(scan: DataFrame) -> tuple[float | None, float | None]:
    """Level and threshold with the highest AUC; the lowest level wins ties."""
    row = scan.filter("auc > 0").orderBy(F.desc("auc"), "level").first()
    return (None, None) if row is None else (row["level"], row["threshold"])


def find_cutoffs(
    df: DataFrame,
    label: str,
    score: str,
    mode: str = "level_as_value",
    low_grid: Sequence[float] | None = None,
    high_grid: Sequence[float] | None = None,
) -> Cutoffs:
    """Best low and high cut; the high side is searched on low-cut scores.

    ``mode="level_as_value"`` cuts scores at the winning quantile *level*;
    ``"quantile_value"`` cuts them at the score found at that level.
    """
    _check_mode(mode)
    low, low_at = best_level(threshold_scan(df, label, score, "low", low_grid))
    cut = low if mode == "level_as_value" else low_at
    low_cut = df if cut is None else apply_cutoffs(df, score, cut, 1.0)
    high, high_at = best_level(threshold_scan(low_cut, label, score, "high", high_grid))
    return Cutoffs(low, low_at, high, high_at)


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def apply_cutoffs(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """Scores under ``low`` become 0 and scores over ``high`` become 1."""
    return df.withColumn(score, to_binary_ends(score, low, high))


def cut_by(df: DataFrame, score: str, cutoffs: Cutoffs, mode: str = "level_as_value") -> DataFrame:
    _check_mode(mode)
    by_level = mode == "level_as_value"
    low = cutoffs.low_level if by_level else cutoffs.low_threshold
    high = cutoffs.high_level if by_level else cutoffs.high_threshold
    return apply_cutoffs(df, score, 0.0 if low is None else low, 1.0 if high is None else high)


def weight_scan(
    df: DataFrame, label: str, first: str, second: str, weights: Sequence[float]
) -> DataFrame:
    """AUC of ``w * first + (1 - w) * second`` for every weight: (weight, auc).

    Rows are multiplied by the weights before they are combined by score.
    """
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight")
    rows = df.select(named(label), num(first).alias("_a"), num(second).alias("_b"), grid)
    mixed = F.col("weight") * F.col("_a") + (1 - F.col("weight")) * F.col("_b")
    return roc_auc(rows.withColumn("_score", mixed), label, "_score", ["weight"])


# ---- weights and cuts of several models together ---------------------------

# The published bounds of weights, low cuts and high cuts.
WEIGHT_BOUNDS, LOW_BOUNDS, HIGH_BOUNDS = (0.0, 1.0), (0.0, 0.1), (0.9, 1.0)
# Members of a population for each number sought, and how they are mixed.
MEMBERS_A_NUMBER, MUTATION, CROSSING = 15, (0.5, 1.0), 0.7
#: Rows of a rank table that a task mixes at a time; that make one more span of the order; that say where spans end.
MIXED_AT_ONCE, SPAN_ROWS, SPAN_SAMPLE = 200_000, 1_000_000, 20_000


@dataclass(frozen=True)
class Mix:
    """Weights of models, and where scores of each and of their sum are cut to 0 and 1."""

    weights: tuple[float, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    low: float = 0.0
    high: float = 1.0


def mix_bounds(models: int) -> np.ndarray:
    """Bounds of the numbers of a mix: weights (two models: that of the first), cuts by model, final cuts."""
    weights = [WEIGHT_BOUNDS] * (1 if models == 2 else models)
    return np.array([*weights, *([HIGH_BOUNDS, LOW_BOUNDS] * (models + 1))])


def mix_of(numbers: Sequence[float], models: int) -> Mix:
    n = 1 if models == 2 else models
    weights = [float(w) for w in numbers[:n]]
    weights = [weights[0], 1 - weights[0]] if models == 2 else [w / (sum(weights) or 1.0) for w in weights]
    cuts = [float(c) for c in numbers[n:]]
    return Mix(tuple(weights), tuple(cuts[1 : 2 * models : 2]), tuple(cuts[0 : 2 * models : 2]), cuts[-1], cuts[-2])


def rank_table(df: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """``pos`` and ``neg`` for every different tuple of scores (``m0``, ``m1``, ...), written; rows
    without a label or with a missing score are left out."""
    scores = [num(m).alias(f"m{i}") for i, m in enumerate(models)]
    rows = df.filter(named(label).isNotNull()).select((named(label) == 1).alias("_y"), *scores).dropna()
    counts = [F.count(F.when(F.col("_y"), 1)).alias("pos"), F.count(F.when(~F.col("_y"), 1)).alias("neg")]
    return written(rows.groupBy(*[f"m{i}" for i in range(len(models))]).agg(*counts))


def mixed_scores(scores: Sequence[np.ndarray], mix: Mix) -> np.ndarray:
    """The mix of the models' scores, row by row, as ``apply_mix`` has it."""

    def cut(x: np.ndarray, low: float, high: float) -> np.ndarray:
        # A score that is no number counts as greater than any, as in SQL.
        return np.where(x < low, 0.0, np.where((x > high) | np.isnan(x), 1.0, x))

    total = None
    for w, x, lo, hi in zip(mix.weights, scores, mix.lows, mix.highs, strict=True):
        part = w * cut(x, lo, hi)
        total = part if total is None else total + part
    return cut(total, mix.low, mix.high)


def _tied(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending different scores with the sums of ``pos`` and ``neg``."""
    if not len(score):
        return score, pos, neg
    order = np.argsort(score, kind="stable")
    score = score[order]
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    return score[first], np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)


def rate_mixes(ranks: DataFrame, mixes: Sequence[Mix]) -> DataFrame:
    """AUC of every mix on a ``rank_table``, in one job: (mix, auc), by its place in ``mixes``.

    Each task scores its rows with every mix, adds them up by score and cuts the order into
    spans; a span of a mix is shuffled as a few packed arrays and put in order by one task,
    so pairs are counted inside spans, and spans are lined up by their totals. Where spans end
    is read off ``SPAN_SAMPLE`` rows, and matters to their sizes alone.
    """
    share_code(ranks.sparkSession)
    mixes, models = list(mixes), len(mixes[0].weights)
    rows = ranks.select(*[F.col(f"m{i}") for i in range(models)], F.col("pos").cast("long"), F.col("neg").cast("long"))
    n = rows.count()
    spans = -(-n // SPAN_ROWS)
    ends = [np.zeros(0)] * len(mixes)
    if spans > 1:
        some = rows.sample(min(1.0, 2 * SPAN_SAMPLE / n), seed=1).limit(SPAN_SAMPLE).collect()
        scores = [np.array([r[i] for r in some], float) for i in range(models)]
        if some:
            ends = [np.unique(np.quantile(mixed_scores(scores, m), np.arange(1, spans) / spans, method="lower")) for m in mixes]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            *scores, pos, neg = (np.concatenate(c) for c in zip(*waiting, strict=True))
            for k, m in enumerate(mixes):
                tied = _tied(mixed_scores(scores, m), pos, neg)
                at = [0, *np.searchsorted(tied[0], ends[k], "right"), len(tied[0])]
                parts = [(s, [x[a:b].tobytes() for x in tied]) for s, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                columns = [pa.array([k] * len(parts), pa.int32()), pa.array([s for s, _ in parts], pa.int32())]
                columns += [pa.array([raw[j] for _, raw in parts], pa.binary()) for j in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["mix", "span", "score", "pos", "neg"])

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held += batch.num_rows
            if held >= MIXED_AT_ONCE:
                yield from packed()
                waiting, held = [], 0
        if held:
            yield from packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def done() -> pa.RecordBatch:
            _, pos, neg = _tied(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            won = float((pos * (np.cumsum(neg) - neg / 2)).sum())
            return pa.RecordBatch.from_pylist([{"mix": key[0], "span": key[1], "won": won, "pos": int(pos.sum()), "neg": int(neg.sum())}], schema=counted)

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                at = row[0].as_py(), row[1].as_py()
                if at != key:
                    if key:
                        yield done()
                    key, parts = at, []
                parts.append([np.frombuffer(x.as_buffer(), t) for x, t in zip(row[2:], ("<f8", "<i8", "<i8"), strict=True)])
        if key:
            yield done()

    counted = pa.schema([("mix", pa.int32()), ("span", pa.int32()), ("won", pa.float64()), ("pos", pa.int64()), ("neg", pa.int64())])
    packed = rows.mapInArrow(score, "mix int, span int, score binary, pos binary, neg binary")
    packed = packed.repartition(max(1, -(-n * len(mixes) // SPAN_ROWS)), "mix", "span").sortWithinPartitions("mix", "span")
    totals = packed.mapInArrow(count, "mix int, span int, won double, pos long, neg long")
    below = F.sum("neg").over(Window.partitionBy("mix").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    won = F.col("won") + F.col("pos") * F.coalesce(below, F.lit(0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return totals.withColumn("won", won).groupBy("mix").agg(F.try_divide(F.sum("won"), pairs).alias("auc"))


@dataclass
class MixSearch:
    best: Mix
    auc: float | None
    history: DataFrame  # generation, best, mean, spread of the population's AUC


def search_mix(
    df: DataFrame, label: str, models: Sequence[str], generations: int = 1000, members: int | None = None, tolerance: float = 0.01, seed: int = 47,
) -> MixSearch:
    """The mix with the best AUC by differential evolution.

    Every generation draws a rival for each member of the population: the best member, moved
    by the difference of two others, crossed with the member. All rivals are rated in one job
    over the rank table, and the better of each two stays. Ends when the population's AUC
    spread no further than ``tolerance`` times their mean, or after ``generations``.
    """
    ranks, bounds = rank_table(df, label, models), mix_bounds(len(models))
    rng, size, many = np.random.default_rng(seed), len(bounds), members or MEMBERS_A_NUMBER * len(bounds)
    low, reach = bounds[:, 0], bounds[:, 1] - bounds[:, 0]

    def rated(points: np.ndarray) -> np.ndarray:
        found = rate_mixes(ranks, [mix_of(low + p * reach, len(models)) for p in points]).collect()
        out = np.full(len(points), -np.inf)
        for r in found:
            out[r["mix"]] = -np.inf if r["auc"] is None else r["auc"]
        return out

    # In every number, one member in each of as many equal parts of its bounds.
    points = (np.array([rng.permutation(many) for _ in range(size)]).T + rng.random((many, size))) / many
    aucs, history = rated(points), []
    for generation in range(generations + 1):
        spread = float(np.std(aucs)) if np.isfinite(aucs).all() else 0.0
        history.append((generation, float(aucs.max()), float(aucs.mean()), spread))
        if generation == generations or spread <= tolerance * abs(aucs.mean()) or not np.isfinite(aucs).all():
            break
        scale = rng.uniform(*MUTATION)
        rivals = points.copy()
        for i in range(many):
            a, b = rng.choice(np.delete(np.arange(many), i), 2, replace=False)
            moved = points[aucs.argmax()] + scale * (points[a] - points[b])
            moved = np.where((moved < 0) | (moved > 1), rng.random(size), moved)
            crossed = rng.random(size) < CROSSING
            crossed[rng.integers(size)] = True
            rivals[i] = np.where(crossed, moved, points[i])
        new = rated(rivals)
        better = new >= aucs
        points[better], aucs[better] = rivals[better], new[better]
    best = int(aucs.argmax())
    frame = df.sparkSession.createDataFrame(history, "generation int, best double, mean double, spread double")
    return MixSearch(mix_of(low + points[best] * reach, len(models)), float(aucs[best]) if np.isfinite(aucs[best]) else None, frame)


def apply_mix(df: DataFrame, models: Sequence[str], mix: Mix, out: str) -> DataFrame:
    """``df`` with the mixed score as ``out``; missing where a model's score is."""
    scores = [to_binary_ends_of(num(m), lo, hi) for m, lo, hi in zip(models, mix.lows, mix.highs, strict=True)]
    total = sum((F.lit(w) * s for w, s in zip(mix.weights[1:], scores[1:], strict=True)), F.lit(mix.weights[0]) * scores[0])
    return df.withColumn(out, to_binary_ends_of(total, mix.low, mix.high))


def to_binary_ends_of(score: Column, low: float, high: float) -> Column:
    return F.when(score < low, 0.0).when(score > high, 1.0).otherwise(score)
