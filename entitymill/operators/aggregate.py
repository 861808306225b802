"""Declarative multi-statistic aggregation of fact rows per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitymill.functions.scalar import named, no_nan, ratio
from entitymill.functions.stats import stat
from entitymill.operators.encode import category_column, in_category

Spec = Mapping[str, Sequence[str]]


def by_stats(groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """``{"mean max": [columns]}`` spelled out as ``{column: [statistics]}``."""
    return {c: stats.split() for stats, cols in groups.items() for c in cols}


def stat_columns(spec: Spec, prefix: str = "", subset: str | None = None) -> list[Column]:
    """Aggregate expressions named ``PREFIX`` + column + ``_`` + STATISTIC."""
    return [
        stat(s, c, subset).alias(f"{prefix}{c}_{s.upper()}")
        for c, stats in spec.items()
        for s in stats
    ]


def share_columns(categories: Mapping[str, Sequence], prefix: str = "") -> list[Column]:
    """Share of an entity's rows in each category; all rows count below."""
    return [
        F.expr(f"avg(CASE WHEN {in_category(c, value)} THEN 1D ELSE 0D END)").alias(
            f"{prefix}{category_column(c, value)}_MEAN"
        )
        for c, values in categories.items()
        for value in values
    ]


def entity_agg(
    df: DataFrame,
    key: str,
    spec: Spec,
    prefix: str = "",
    subsets: Mapping[str, str] | None = None,
    categories: Mapping[str, Sequence] | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per entity with every statistic of ``spec``.

    ``subsets`` maps further prefixes to row conditions in SQL: the same
    statistics over those rows only, in the same pass. ``categories`` adds category shares.
    Rows without a key are left out.
    """
    columns = stat_columns(spec, prefix)
    for sub_prefix, condition in (subsets or {}).items():
        columns += stat_columns(spec, sub_prefix, condition)
    columns += share_columns(categories or {}, prefix)
    columns += list(extra)
    return df.filter(named(key).isNotNull()).groupBy(named(key)).agg(*columns)


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (feature, null_share), one per column, from one pass."""
    columns = list(columns or df.columns)
    shares = df.agg(
        *[F.avg(named(c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("null_share"))
            for i, c in enumerate(columns)
        ]
    )
    return shares.select(F.inline(pairs))


def mean_ratios(
    df: DataFrame, pairs: Sequence[tuple[str, str]], default: float = 0.5
) -> list[float]:
    """Mean of each ``a / b`` over the rows where it is defined, else ``default``.

    All pairs are answered by one pass.
    """
    row = df.agg(
        *[no_nan(F.avg(ratio(a, b))).alias(f"m{i}") for i, (a, b) in enumerate(pairs)]
    ).first()
    return [default if row[f"m{i}"] is None else row[f"m{i}"] for i in range(len(pairs))]


def mean_ratio(df: DataFrame, a: str, b: str, default: float = 0.5) -> float:
    return mean_ratios(df, [(a, b)], default)[0]


def share_ratio(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    """Ratio of two aggregates of an already aggregated frame."""
    return df.withColumn(out, ratio(a, b))


def importance_totals(importances: DataFrame) -> DataFrame:
    """Sum and mean importance per feature over all folds."""
    return importances.groupBy("feature").agg(
        F.sum("importance").alias("importance_sum"), F.avg("importance").alias("importance_mean")
    )


def frame_shape(df: DataFrame, label: str) -> DataFrame:
    """Row counts of the labelled and unlabelled part, and the column count."""
    labelled = named(label).isNotNull()
    return df.agg(
        F.count(F.when(labelled, 1)).alias("train_rows"),
        F.count(F.when(~labelled, 1)).alias("test_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
    )


def two_level(
    child: DataFrame,
    parent: DataFrame,
    child_key: str,
    parent_key: str,
    child_spec: Spec,
    parent_spec: Spec,
    prefix: str = "",
    child_categories: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Child statistics per parent row, then statistics of those per entity.

    ``parent_spec`` may name any child statistic (``COL_MIN``, ...). Category
    shares of the child rows are averaged per entity.
    """
    from entitymill.operators.attach import attach

    per_parent = entity_agg(child, child_key, child_spec, categories=child_categories)
    shares = [
        f"{category_column(c, v)}_MEAN" for c, vs in (child_categories or {}).items() for v in vs
    ]
    spec = {**parent_spec, **{c: ["mean"] for c in shares}}
    return entity_agg(attach(parent, per_parent, child_key), parent_key, spec, prefix)
