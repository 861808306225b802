"""Group statistics by name, with the missing-value rules of this package.

Every statistic can be limited to the rows of a subset, so that statistics
over all rows and over several subsets come out of one aggregation. A group
without any row of the subset gets NULL for every statistic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitymill.functions.scalar import sql_name, sql_no_nan

# All but the distinct count need only fixed-width, partially combined buffers.
STATS = ("mean", "sum", "min", "max", "var", "std", "skew", "size", "nunique")
# Fixed value: sums of squared and cubed deviations under this count as zero.
NO_SPREAD = "1e-14"


def _skew(x: str) -> str:
    """Bias-corrected skewness: under three values NULL, values without spread 0."""
    n, g, squares = f"double(count({x}))", f"skewness({x})", f"(var_pop({x}) * count({x}))"
    cubes = f"abs({g}) * pow({squares}, 1.5) / sqrt({n})"
    flat = f"{squares} < {NO_SPREAD} OR {cubes} < {NO_SPREAD}"
    return (
        f"CASE WHEN {n} >= 3 AND NOT coalesce(isnan({g}), false) THEN CASE WHEN {flat} THEN 0D"
        f" ELSE {g} * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0) END END"
    )


def sql_stat(name: str, column: str, subset: str | None = None) -> str:
    """SQL text of the aggregate; ``column`` and ``subset`` are SQL text too."""
    guard = "" if subset is None else f"count(CASE WHEN {subset} THEN 1 END)"
    x = column if subset is None else f"CASE WHEN {subset} THEN {column} END"
    if name == "size":
        return "count(1)" if subset is None else f"double(nullif({guard}, 0))"
    if name == "nunique":
        distinct = f"count(DISTINCT {x})"
        return distinct if subset is None else f"CASE WHEN {guard} > 0 THEN double({distinct}) END"
    x = f"double({x})"
    if name == "sum":
        # 0 where nothing was there to sum, NULL where the sum is undefined.
        e = f"coalesce({sql_no_nan(f'sum({x})')}, CASE WHEN count({x}) = 0 THEN 0D END)"
        return e if subset is None else f"CASE WHEN {guard} > 0 THEN {e} END"
    if name == "mean":
        return sql_no_nan(f"avg({x})")
    if name in ("var", "std"):
        # From the same moments as the skewness, so that both share one buffer.
        e = f"CASE WHEN count({x}) > 1 THEN var_pop({x}) * count({x}) / (count({x}) - 1) END"
        return sql_no_nan(e if name == "var" else f"sqrt({e})")
    if name in ("min", "max"):
        return f"{name}({x})"
    if name == "skew":
        return _skew(x)
    raise ValueError(f"unknown statistic {name!r}; known: {', '.join(STATS)}")


def stat(name: str, column: str, subset: str | None = None) -> Column:
    """Statistic of a named column, over the rows of ``subset`` (SQL text)."""
    return F.expr(sql_stat(name, sql_name(column), subset))
