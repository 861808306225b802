"""Joining feature tables, lookups and predictions to entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.functions.scalar import named


def attach(left: DataFrame, features: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join of a table with at most one row per key."""
    return left.join(features, key, "left")


def attach_all(left: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of several feature tables on one key.

    All joins hash on the same key, so the left side is shuffled once.
    """
    return reduce(lambda out, t: attach(out, t, key), tables, left)


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of a value table.

    The plan decides while it runs: a lookup whose bytes turn out small is
    broadcast, a larger one is shuffled and parts of hot keys are split.
    """
    return attach(df, lookup, key)


def keep_matching(df: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, key, "left_semi")


def append_unlabelled(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows followed by test rows; columns the test lacks become NULL."""
    return train.unionByName(test, allowMissingColumns=True)


def append_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def split_labelled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(named(label).isNotNull()), df.filter(named(label).isNull())


def join_predictions(
    labels: DataFrame,
    predictions: Mapping[str, DataFrame],
    id_col: str,
    prediction: str = "OOF_PRED",
    drop_incomplete: bool = True,
) -> DataFrame:
    """Labels with one column per model; rows missing any prediction go."""
    out = labels
    for name, frame in predictions.items():
        out = attach(out, frame.select(named(id_col), named(prediction).alias(name)), id_col)
    return out.na.drop("any") if drop_incomplete else out


def top_features(importances: DataFrame, n: int = 40) -> DataFrame:
    """All folds' rows of the ``n`` features with the highest mean importance."""
    ranked = (
        importances.groupBy("feature")
        .agg(F.avg("importance").alias("importance_mean"))
        .orderBy(F.desc("importance_mean"), "feature")
        .limit(n)
    )
    return keep_matching(importances, ranked.select("feature"), "feature")
