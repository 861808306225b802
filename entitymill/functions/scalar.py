"""Column expressions that keep one missing value (NULL) and keep infinities.

Data handled by this package never holds NaN: whatever could create one
(``inf - inf``, ``inf / inf``, a mean over both infinities) is turned to NULL
where it arises, because Spark ranks NaN above every number in ``max`` and lets
it spread through ``avg``.

Expressions over named columns are given to Spark as one SQL text each: wide
plans hold thousands of functions, and a call to the JVM for every one of them
would take longer than planning the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


# ---- SQL text --------------------------------------------------------------


def sql_name(name: str) -> str:
    """Quoted column name, whatever characters the name holds."""
    return "`" + name.replace("`", "``") + "`"


def sql_num(name: str) -> str:
    return f"double({sql_name(name)})"


def sql_value(value) -> str:
    """Literal for a string or a number."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"double('{value!r}')"
    return repr(value)


def sql_no_nan(e: str) -> str:
    return f"nanvl({e}, double(null))"


def sql_ratio(a: str, b: str) -> str:
    at_zero = (
        f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN double('Infinity')"
        f" WHEN {a} < 0 THEN double('-Infinity') END END"
    )
    return sql_no_nan(f"coalesce(try_divide({a}, {b}), {at_zero})")


# ---- columns ---------------------------------------------------------------


def named(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col(sql_name(name))


def num(c: Column | str) -> Column:
    return F.expr(sql_num(c)) if isinstance(c, str) else c.cast("double")


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.expr("double(null)"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``: a zero denominator gives signed infinity, 0/0 gives NULL."""
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(sql_ratio(sql_num(a), sql_num(b)))
    a, b = num(a), num(b)
    at_zero = F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)))
    return no_nan(F.coalesce(F.try_divide(a, b), at_zero))


def minus(a: str, b: str) -> Column:
    return F.expr(sql_no_nan(f"{sql_num(a)} - {sql_num(b)}"))


def plus(a: str, b: str) -> Column:
    return F.expr(sql_no_nan(f"{sql_num(a)} + {sql_num(b)}"))


def times(*factors: str) -> Column:
    """Product of the factors; ``0 * inf`` gives NULL."""
    return F.expr(sql_no_nan(" * ".join(sql_num(f) for f in factors)))


def weighted_sum(terms: dict[str, float]) -> Column:
    """``sum(weight * column)``; any missing term makes the sum missing."""
    return F.expr(
        sql_no_nan(" + ".join(f"{sql_num(c)} * {sql_value(float(w))}" for c, w in terms.items()))
    )


def flag(condition: str) -> Column:
    """1 where the SQL condition holds, 0 where it does not or is unknown."""
    return F.expr(f"int(coalesce({condition}, false))")


def differs(c: str, value) -> Column:
    """``c != value`` where a missing ``c`` counts as different."""
    return F.expr(f"NOT ({sql_name(c)} <=> {sql_value(value)})")


def blank_if(c: str, value) -> Column:
    """Turn a sentinel value into NULL."""
    return F.expr(f"nullif({sql_name(c)}, {sql_value(value)})")


def blank_below(c: str, bound: float) -> Column:
    """Turn values under ``bound`` into NULL."""
    return F.expr(f"CASE WHEN {sql_num(c)} < {bound} THEN NULL ELSE {sql_num(c)} END")


def or_value(c: str, value) -> Column:
    return F.expr(f"coalesce({sql_name(c)}, {sql_value(value)})")


def at_least_zero(c: Column | str) -> Column:
    """Negative and missing values become 0."""
    return F.greatest(F.coalesce(num(c), F.lit(0.0)), F.lit(0.0))


def is_infinite(c: str) -> Column:
    return F.expr(f"coalesce(abs({sql_num(c)}) = double('Infinity'), false)")


def blank_infinite(c: str) -> Column:
    return F.expr(f"CASE WHEN abs({sql_num(c)}) < double('Infinity') THEN {sql_num(c)} END")


def to_binary_ends(c: Column | str, low: float, high: float) -> Column:
    """Scores under ``low`` become 0, scores over ``high`` become 1."""
    c = num(c)
    return F.when(c < F.lit(float(low)), 0.0).when(c > F.lit(float(high)), 1.0).otherwise(c)


def blend_of(columns: Sequence[str], weights: Sequence[float]) -> Column:
    return weighted_sum(dict(zip(columns, weights, strict=True)))
