"""Frame-level preparation: column choice, fills and scaling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from entitymill.functions.scalar import blank_infinite, differs, is_infinite, named, no_nan, num

# Columns that are never model features.
NOT_FEATURES = ("TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def columns_where(df: DataFrame, rule: Callable[[str], bool]) -> list[str]:
    """Names that satisfy a rule on the name."""
    return [c for c in df.columns if rule(c)]


def feature_columns(df: DataFrame, not_features: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in not_features]


def drop_where(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows with the value; rows where the column is missing stay."""
    return df.filter(differs(column, value))


def replace_columns(df: DataFrame, new: dict) -> DataFrame:
    """Replace or add columns in one projection."""
    return df.withColumns(new) if new else df


def relabel(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Means of the finite and infinite values present, in one pass."""
    if not columns:
        return {}
    row = df.agg(*[no_nan(F.avg(num(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the mean of their column over the whole frame."""
    means = column_means(df, columns)
    filled = {c: F.coalesce(num(c), F.lit(m)) for c, m in means.items() if m is not None}
    return replace_columns(df, filled)


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = -999) -> DataFrame:
    """Missing and infinite numbers become a constant; text stays as it is."""
    usable = set(numeric_columns(df))
    return replace_columns(
        df,
        {
            c: F.when(named(c).isNull() | is_infinite(c), F.lit(float(value))).otherwise(num(c))
            for c in columns
            if c in usable
        },
    )


def to_finite_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: blank_infinite(c) for c in columns})


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1] over the whole frame; a constant column becomes 0."""
    if not columns:
        return df
    bounds = df.agg(
        *[F.min(num(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(num(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if lo is not None:
            width = hi - lo if hi > lo else 1.0
            scaled[c] = (num(c) - F.lit(lo)) / F.lit(width)
    return replace_columns(df, scaled)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=None if columns is None else list(columns))
