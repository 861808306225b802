"""Ranking quality of scores: exact area under the ROC curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitymill.functions.scalar import named, num


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; tied rows become one row."""
    positive = named(label) == 1
    rows = df.filter(named(label).isNotNull() & named(score).isNotNull())
    return rows.groupBy(*[named(b) for b in by], num(score).alias("score")).agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg")
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUC per group; NULL where only one class is present.

    Scores are range partitioned, won pairs are counted inside each chunk, and
    a chunk's positives also beat all negatives of the chunks below it. Only
    one row per chunk takes part in the second step.
    """
    return table_auc(score_table(df, label, score, by), by)


def table_auc(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` of a table with ``pos`` and ``neg`` for every ``score``, one row each."""
    groups = [named(b) for b in by]
    ranged = table.repartitionByRange(*groups, F.col("score")).withColumn(
        "_chunk", F.spark_partition_id()
    )
    inside = Window.partitionBy(*groups, "_chunk").orderBy("score")
    below = F.coalesce(
        F.sum("neg").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    won = F.col("pos") * (F.col("_below") + F.col("neg") / 2)
    chunks = (
        ranged.withColumn("_below", below)
        .groupBy(*groups, "_chunk")
        .agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_chunk")
    neg_below = F.coalesce(
        F.sum("neg").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    won_all = F.col("won") + F.col("pos") * F.col("_neg_below")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return (
        chunks.withColumn("_neg_below", neg_below)
        .groupBy(*groups)
        .agg(F.try_divide(F.sum(won_all), pairs).alias("auc"))
    )


def table_loss(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean log loss per group as ``loss``, where ``score`` is the log odds of a ``score_table``."""
    away = F.log1p(F.exp(-F.abs("score")))
    won, lost = (F.greatest(x, F.lit(0.0)) + away for x in (-F.col("score"), F.col("score")))
    total = F.sum(F.col("pos") * won + F.col("neg") * lost)
    return table.groupBy(*[named(b) for b in by]).agg((total / F.sum(F.col("pos") + F.col("neg"))).alias("loss"))


def roc_auc_value(df: DataFrame, label: str, score: str) -> float | None:
    row = roc_auc(df, label, score).first()
    return None if row is None else row["auc"]
