"""Running sums, ranks and quantiles that never sort one group in one task.

Rows are range partitioned by (group, order), so a large group spans many
partitions. Sums run inside each partition, and each partition is then shifted
by what earlier partitions of the same group add up to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitymill.functions.scalar import named, no_nan, num, sql_value
from entitymill.sources.staging import cut_lineage, written


def prefix_sums(
    df: DataFrame,
    groups: Sequence[str],
    order_by: Sequence[str],
    sums: Mapping[str, Column],
    keep_chunk: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Add columns with the sum of ``sums`` over all earlier rows of the group.

    ``order_by`` must order the rows of a group totally. The chunked frame is
    written, because it is read twice and must number its chunks alike.
    """
    chunked = chunk_by_order(df, [*groups, *order_by], chunks)
    keys = [*groups, "_chunk"]
    before = (
        Window.partitionBy(*keys)
        .orderBy(*[named(c) for c in order_by])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        Window.partitionBy(*groups, F.lit(0))
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = chunked.groupBy(*keys).agg(*[F.sum(e).alias(f"_in_{n}") for n, e in sums.items()])
    offsets = offsets.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    inner = chunked.select(
        "*", *[F.coalesce(F.sum(e).over(before), F.lit(0)).alias(f"_pre_{n}") for n, e in sums.items()]
    )
    on = [named(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = inner.join(offsets, on, "inner")
    return joined.select(
        *[named(c) for c in chunked.columns if keep_chunk or c != "_chunk"],
        *[(F.col(f"_pre_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums],
    )


def chunk_by_order(df: DataFrame, by: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Range partitions of ``df`` with their number as ``_chunk``, written.

    How many follows from the bytes of the rows, unless ``chunks`` says it. Results
    that are put together from chunks do not depend on it.
    """
    columns = [named(c) for c in by]
    ranged = df.repartitionByRange(*columns) if chunks is None else df.repartitionByRange(chunks, *columns)
    return written(ranged.withColumn("_chunk", F.spark_partition_id()))


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    levels: Sequence[float],
    chunks: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: (groups..., level, quantile).

    Distinct values are counted, put in order in chunks, and the bounding order
    statistics are found by running counts, whatever the size of a group.
    """
    present = df.filter(num(value).isNotNull())
    for g in groups:
        present = present.filter(named(g).isNotNull())
    counts = present.groupBy(*[named(g) for g in groups], num(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = prefix_sums(counts, groups, ["_v"], {"_before": F.col("_n")}, True, chunks)
    return pick_quantiles(cut_lineage(ranked), groups, "_v", "_n", "_before", levels)


def _double_array(values: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(sql_value(float(v)) for v in values)})")


def pick_quantiles(
    ranked: DataFrame,
    groups: Sequence[str],
    value: str,
    count: str,
    before: str,
    levels: Sequence[float],
    payload: Sequence[str] = (),
) -> DataFrame:
    """Quantiles from distinct values with their counts and running counts.

    ``ranked`` comes from ``prefix_sums(..., keep_chunk=True)`` and should be
    checkpointed, as it is read three times. Each distinct value covers the ranks
    ``before <= rank < before + count``. ``payload`` columns of the two bounding
    values come along as ``<name>_lo`` and ``<name>_hi``.
    """
    by = [named(g) for g in groups]
    sides = F.array(
        F.struct(F.lit("lo").alias("_side"), F.floor("_l._pos").alias("_at")),
        F.struct(F.lit("hi").alias("_side"), F.ceil("_l._pos").alias("_at")),
    )
    asked = F.transform(
        _double_array(levels),
        lambda q: F.struct(q.alias("level"), (q * (F.col("_rows") - 1)).alias("_pos")),
    )
    totals = ranked.groupBy(*by).agg(F.sum(count).alias("_rows")).filter("_rows > 0")
    wanted = (
        totals.select(*by, F.explode(asked).alias("_l"))
        .select(*by, "_l.*", F.inline(sides))
    )
    # Chunks and ranks in one order: a rank lies in the last chunk that starts before it.
    starts = ranked.groupBy(*by, "_chunk").agg(F.min(before).alias("_at"))
    is_rank = F.col("_side").isNotNull()
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_at", is_rank)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    lined_up = starts.unionByName(wanted, allowMissingColumns=True)
    wanted = lined_up.withColumn("_chunk", F.last("_chunk", ignorenulls=True).over(w)).filter(is_rank)
    wanted = cut_lineage(wanted.select(*by, "_chunk", "_at", "level", "_pos", "_side"))
    # Ranks and values in one order: a rank belongs to the last value before it.
    values = ranked.join(wanted.select(*by, "_chunk").distinct(), [*groups, "_chunk"], "left_semi")
    row = F.struct(named(value).alias("_value"), *[named(p) for p in payload]).alias("_row")
    values = values.select(*by, "_chunk", named(before).alias("_at"), row)
    lined_up = values.unionByName(wanted, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_chunk").orderBy("_at", is_rank)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    hits = lined_up.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).filter(is_rank)
    pick = lambda c, side: F.max(F.when(F.col("_side") == side, F.col(f"_row.{c}")))
    grid = hits.groupBy(*by, "level", "_pos").agg(
        pick("_value", "lo").alias("_lo"),
        pick("_value", "hi").alias("_hi"),
        *[pick(p, s).alias(f"{p}_{s}") for p in payload for s in ("lo", "hi")],
    )
    part = F.col("_pos") - F.floor("_pos")
    between = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        no_nan(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part)
    )
    return grid.select(
        *by,
        "level",
        between.alias("quantile"),
        *[F.col(f"{p}_{s}") for p in payload for s in ("lo", "hi")],
    )
