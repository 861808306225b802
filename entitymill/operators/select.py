"""Choosing columns by missing share and by pairwise correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.functions.scalar import blank_infinite, named
from entitymill.operators.aggregate import null_shares
from entitymill.operators.clean import numeric_columns
from entitymill.sources.staging import share_code

# Default thresholds, and the name part of columns kept always.
MISSING_SHARE = 0.75
CORRELATION = 0.9
LABEL_PART = "TARGET"


def missing_columns(df: DataFrame, threshold: float = MISSING_SHARE) -> list[str]:
    """Columns with a larger share of missing values, largest share first."""
    rows = null_shares(df).filter(F.col("null_share") > threshold)
    rows = rows.filter(~F.col("feature").contains(LABEL_PART))
    return [r["feature"] for r in rows.orderBy(F.desc("null_share"), "feature").collect()]


#: Columns a tile; columns whose means are sought in one job.
TILE = 256
COLUMNS_A_JOB = 500


def _scales(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the finite values of every column."""
    found = []
    for a in range(0, len(columns), COLUMNS_A_JOB):
        some = columns[a : a + COLUMNS_A_JOB]
        row = df.agg(
            *[F.avg(blank_infinite(c)).alias(f"m{i}") for i, c in enumerate(some)],
            *[F.stddev_pop(blank_infinite(c)).alias(f"s{i}") for i, c in enumerate(some)],
        ).first()
        found += [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in range(len(some))]
    means, spreads = np.array(found).T if found else np.zeros((2, 0))
    return means, spreads


def _correlations(sums: np.ndarray) -> np.ndarray:
    """Of a tile pair, from its counts and sums; NaN for constant columns and infinite values."""
    n, sx, sy, sxx, syy, sxy, infinite = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sy / n
        var_x, var_y = sxx - sx * sx / n, syy - sy * sy / n
        known = (var_x > 1e-12 * np.abs(sxx)) & (var_y > 1e-12 * np.abs(syy)) & (infinite == 0)
        return np.clip(np.where(known, cov / np.sqrt(var_x * var_y), np.nan), -1.0, 1.0)


def correlations(df: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = None, tile: int = TILE, own: bool = False) -> DataFrame:
    """(a, b, correlation) for all pairs of columns by place, a < b, over the rows where both are present.

    Columns are cut into tiles, and the sums of products of a pair of tiles are added up by
    the tasks and combined in a shuffle, so neither a task nor the driver holds all pairs; one
    pass takes one tile against those behind it, and reads only these. With ``threshold`` only
    stronger correlations are given, otherwise pairs with a constant or an infinite value
    have NULL. ``own`` adds every column with itself.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    spark = df.sparkSession
    share_code(spark)
    means, spreads = _scales(df, columns)
    starts = range(0, len(columns), tile)

    def stripe(first: int) -> DataFrame:
        some = columns[first:]
        center, spread = means[first:], spreads[first:]
        rows = df.select(*[named(c).cast("double").alias(f"x{i}") for i, c in enumerate(some)])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for batch in batches:
                x = np.empty((batch.num_rows, len(some)))
                for i in range(len(some)):
                    x[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
                infinite = np.isinf(x)
                present = ~np.isnan(x)
                x = np.where(present & ~infinite, (np.where(infinite, 0.0, x) - center) / spread, 0.0)
                marks, infinite, squares = present.astype(float), infinite.astype(float), x * x
                a = slice(0, tile)
                for start in range(0, len(some), tile):
                    b = slice(start, start + tile)
                    sums = np.array([
                        marks[:, a].T @ marks[:, b], x[:, a].T @ marks[:, b], marks[:, a].T @ x[:, b], squares[:, a].T @ marks[:, b],
                        marks[:, a].T @ squares[:, b], x[:, a].T @ x[:, b], infinite[:, a].T @ marks[:, b] + marks[:, a].T @ infinite[:, b],
                    ])
                    total[start] = total[start] + sums if start in total else sums
            for start, sums in total.items():
                columns_ = [pa.array([first], pa.int32()), pa.array([first + start], pa.int32()), pa.array([sums.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns_, names=["a", "b", "sums"])

        return rows.mapInArrow(add_up, "a int, b int, sums binary")

    def pairs(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        a, b = key
        height = min(tile, len(columns) - a)
        r = _correlations(total.reshape(7, height, -1))
        i, j = np.indices(r.shape)
        keep = a + i < b + j + own
        if threshold is not None:
            keep &= np.nan_to_num(np.abs(r)) > threshold
        r = pa.array(r[keep], mask=np.isnan(r[keep]))
        return pa.RecordBatch.from_arrays([pa.array((a + i[keep]).astype(np.int32)), pa.array((b + j[keep]).astype(np.int32)), r], names=["a", "b", "correlation"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = np.frombuffer(raw)
                if (a, b) == key:
                    total = total + sums
                    continue
                if key:
                    yield pairs(key, total)
                key, total = (a, b), sums
        if key:
            yield pairs(key, total)

    found = None
    for first in starts:
        part = stripe(first).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(combine, "a int, b int, correlation double")
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], "a int, b int, correlation double")


def correlation_matrix(df: DataFrame, columns: Sequence[str], tile: int = TILE) -> np.ndarray:
    """All of ``correlations`` as one symmetric array on the driver, for few columns."""
    columns = list(columns)
    out = np.full((len(columns),) * 2, np.nan)
    for r in correlations(df, columns, tile=tile, own=True).collect():
        if r["correlation"] is not None:
            out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["correlation"]
    return out


def correlated_columns(df: DataFrame, threshold: float = CORRELATION) -> list[str]:
    """Numeric columns that correlate beyond the threshold with an earlier one."""
    columns = numeric_columns(df)
    later = {r["b"] for r in correlations(df, columns, threshold).select("b").distinct().collect()}
    return [c for i, c in enumerate(columns) if i in later and LABEL_PART not in c]


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, tile: int = TILE) -> DataFrame:
    """Rows (feature_a, feature_b, correlation), earlier column first."""
    columns = numeric_columns(df) if columns is None else list(columns)
    found = correlations(df, columns, tile=tile)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [pa.array([columns[i] for i in batch.column(c).to_pylist()], pa.string()) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*ends, batch.column("correlation")], names=["feature_a", "feature_b", "correlation"])

    return found.mapInArrow(name, "feature_a string, feature_b string, correlation double")


def select_features(
    df: DataFrame,
    missing: float | None = MISSING_SHARE,
    correlation: float | None = CORRELATION,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Drop columns that are mostly missing or repeat an earlier column."""
    gone = set()
    if correlation is not None:
        gone.update(correlated_columns(df, correlation))
    if missing is not None:
        gone.update(missing_columns(df, missing))
    return df.select(*[named(c) for c in df.columns if c in keep or c not in gone])
