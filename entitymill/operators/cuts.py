"""Cut points of many columns from mergeable weighted quantile summaries.

A summary keeps some of a column's values with bounds on their weighted ranks. Tasks
summarise their rows, summaries are merged in a tree of shuffles and pruned after each
merge, and only cut points reach the driver. Up to ``size`` different values a column,
nothing is pruned and ranks are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.functions.scalar import named
from entitymill.sources.staging import share_code, written

#: Values a summary keeps, per bin; summaries merged by one task; rows summarised at a time.
VALUES_A_BIN = 8
FAN_IN = 32
ROWS_AT_ONCE = 50_000


@dataclass
class Summary:
    """Ascending ``values`` with weights ``w``; less than ``low`` weight lies below each, at most ``high`` up to it."""

    values: np.ndarray
    w: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(values: np.ndarray, weights: np.ndarray) -> Summary:
        distinct, at = np.unique(values, return_inverse=True)
        w = np.bincount(at, weights, len(distinct))
        high = np.cumsum(w)
        return Summary(distinct, w, high - w, high)

    @staticmethod
    def parse(raw: bytes) -> Summary:
        return Summary(*np.frombuffer(raw, "<f8").reshape(4, -1))

    def raw(self) -> bytes:
        return np.array([self.values, self.w, self.low, self.high], "<f8").tobytes()

    @property
    def total(self) -> float:
        return float(self.high[-1]) if len(self.high) else 0.0

    def exact(self) -> bool:
        """Whether every value is there: the values' weights fill the ranks without a gap."""
        return len(self.values) == 0 or np.isclose(self.w.sum(), self.total, rtol=1e-9)

    def _bounds_at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For any values: weight known to equal them, least and most weight below and up to them."""
        at = np.searchsorted(self.values, x)
        here = (at < len(self.values)) & (np.append(self.values, np.nan)[at] == x)
        # Between two kept values: all of the lower one, and all but the upper one's own weight.
        least = np.append(0.0, self.low + self.w)[at]
        most = np.append(self.high - self.w, self.total)[at]
        own, low, high = (np.append(v, 0.0)[at] for v in (self.w, self.low, self.high))
        return np.where(here, own, 0.0), np.where(here, low, least), np.where(here, high, most)

    def merge(self, other: Summary) -> Summary:
        if not len(self.values) or not len(other.values):
            return self if len(self.values) else other
        x = np.union1d(self.values, other.values)
        return Summary(x, *(a + b for a, b in zip(self._bounds_at(x), other._bounds_at(x), strict=True)))

    def prune(self, size: int) -> Summary:
        """At most ``size`` + 1 values, evenly spaced by rank; ranks are off by ``total / size`` more at most."""
        if len(self.values) <= size:
            return self
        wanted = np.linspace(0, self.total, size + 1)
        middle = (self.low + self.high) / 2
        at = np.searchsorted(middle, wanted).clip(0, len(middle) - 1)
        before = (at - 1).clip(0)
        at = np.where(wanted - middle[before] < middle[at] - wanted, before, at)
        keep = np.unique(np.concatenate([[0], at, [len(middle) - 1]]))
        return Summary(self.values[keep], self.w[keep], self.low[keep], self.high[keep])

    def cuts(self, bins: int) -> np.ndarray:
        """At most ``bins`` - 1 ascending cut points; a value belongs left of a cut if it is not greater.

        With no more than ``bins`` different values each gets a bin of its own.
        """
        if self.exact() and len(self.values) <= bins:
            return self.values[:-1] / 2 + self.values[1:] / 2
        wanted = np.arange(1, bins) * self.total / bins
        at = np.searchsorted((self.low + self.high) / 2, wanted).clip(0, len(self.values) - 1)
        return np.unique(self.values[at])


def columns_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Rows by columns as doubles; null becomes NaN, infinities the largest doubles."""
    out = np.empty((batch.num_rows, len(names)))
    for i, name in enumerate(names):
        out[:, i] = batch.column(name).to_numpy(zero_copy_only=False)
    return np.nan_to_num(out, copy=False, nan=np.nan)


def find_cuts(df: DataFrame, features: Sequence[str], bins: int, weight: str | None = None) -> list[np.ndarray]:
    """Cut points of every column, for up to ``bins`` bins; rows count by ``weight``, or once each.

    Missing values play no part; a column without values has no cuts. Every merge and every
    ``ROWS_AT_ONCE`` rows of a task add ``1 / (VALUES_A_BIN * bins)`` of the weight to the
    error of ranks at most, and merges of tasks are few: their logarithm to ``FAN_IN``.
    """
    spark, size = df.sparkSession, VALUES_A_BIN * bins
    share_code(spark)
    names = [f"f{i}" for i in range(len(features))]
    data = df.select(*[named(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)], (named(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    if not names:
        return []

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, waiting, rows = TaskContext.get().partitionId(), None, [], 0

        def taken(sums: list[Summary] | None) -> list[Summary]:
            values = np.concatenate([v for v, _ in waiting])
            weights = np.concatenate([w for _, w in waiting])
            out = []
            for i in range(values.shape[1]):
                known = ~np.isnan(values[:, i]) & (weights > 0)
                new = Summary.of(values[known, i], weights[known])
                out.append((sums[i].merge(new) if sums else new).prune(size))
            return out

        for batch in batches:
            weights = np.nan_to_num(batch.column("w").to_numpy(zero_copy_only=False))
            waiting.append((columns_of(batch, names), weights))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                sums, waiting, rows = taken(sums), [], 0
        if waiting:
            sums = taken(sums)
        if sums:
            yield _rows(range(len(sums)), [part] * len(sums), sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for feature, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = Summary.parse(raw)
                if (feature, part) == at:
                    total = total.merge(new).prune(4 * size)
                    continue
                if at:
                    yield _rows([at[0]], [at[1]], [total.prune(size)])
                at, total = (feature, part), new
        if at:
            yield _rows([at[0]], [at[1]], [total.prune(size)])

    schema = "feature int, part int, summary binary"
    found = written(data.mapInArrow(summarise, schema))
    most = found.agg(F.max("part")).first()[0] or 0
    while most:
        most //= FAN_IN
        groups = found.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        groups = groups.repartition("feature", "part").sortWithinPartitions("feature", "part")
        found = written(groups.mapInArrow(merged, schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [Summary.parse(raw).cuts(bins).tolist() for raw in batch.column("summary").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(points, pa.list_(pa.float64()))], names=["feature", "cuts"])

    cuts = {r["feature"]: np.array(r["cuts"]) for r in found.mapInArrow(cut, "feature int, cuts array<double>").collect()}
    return [cuts.get(i, np.zeros(0)) for i in range(len(names))]


def _rows(features, parts, sums: list[Summary]) -> pa.RecordBatch:
    arrays = [pa.array(list(features), pa.int32()), pa.array(list(parts), pa.int32()), pa.array([s.raw() for s in sums], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["feature", "part", "summary"])
