"""Row-to-row change of an entity's records, in a declared order.

For every feature: the mean difference and the mean percent change between
consecutive records of an entity, over all records and over those of its latest
sub-account. Percent changes compare with the last known value.

Records are range partitioned by (entity, order), so an entity of any size is
spread over as many chunks as it needs. Each chunk yields a short summary per
entity, and the changes across chunk borders follow from the summaries alone.
Statistics are combined in the same chunks before their own, short shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitymill.functions.scalar import (
    minus,
    named,
    no_nan,
    num,
    ratio,
    sql_name,
    sql_no_nan,
    sql_num,
    sql_ratio,
)
from entitymill.operators.aggregate import Spec, entity_agg, share_columns, stat_columns
from entitymill.operators.attach import attach_all
from entitymill.operators.clean import replace_columns
from entitymill.operators.ordered import chunk_by_order

CHANGES = ("DIFF", "PCT")


@dataclass(frozen=True)
class Momentum:
    """Which columns to follow, per sub-account id, in which record order.

    ``scope`` says which records count as final: ``"group"`` those of the
    entity's own highest sub-account id, ``"global"`` those whose id is the
    highest of any entity.
    """

    features: Sequence[str]
    account: str
    order_by: Sequence[str]
    prefix: str = ""
    scope: str = "group"

    def __post_init__(self):
        if self.scope not in ("group", "global"):
            raise ValueError(f"scope must be 'group' or 'global', not {self.scope!r}")

    def names(self) -> list[str]:
        return [
            f"{self.prefix}{f}_{change}_{part}"
            for f in self.features
            for part in ("MEAN", "FIN")
            for change in CHANGES
        ]


def momentum(df: DataFrame, key: str, m: Momentum, chunks: int | None = None) -> DataFrame:
    """One row per entity with four change features per followed column."""
    return entity_features(df, key, {}, m, chunks=chunks)


def entity_features(
    df: DataFrame,
    key: str,
    spec: Spec,
    m: Momentum,
    prefix: str = "",
    subsets: Mapping[str, str] | None = None,
    categories: Mapping[str, Sequence] | None = None,
    extra: Sequence[Column] = (),
    chunks: int | None = None,
    subset_spec: Spec | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``entity_agg`` and momentum of the same rows, from the same chunks.

    The rows are shuffled once, into written chunks; after that only
    summaries move, and the columns that momentum follows. ``subsets`` maps further
    prefixes to row conditions in SQL: the same statistics (or those of
    ``subset_spec``) over those rows only, NULL for entities without any. A row is added up once, and once more per subset that it
    belongs to. ``derived`` columns are computed from the others of a row where they are added
    up, so they are neither shuffled nor written.
    """
    derived = dict(derived or {})
    if {key, m.account, *m.order_by}.intersection(derived):
        df, derived = replace_columns(df, derived), {}
    df = df.filter(named(key).isNotNull())
    if m.scope == "global":
        df = _mark_global_final(df, key, m)
    rows = replace_columns(chunk_by_order(df, [key, *m.order_by], chunks), derived)
    changes = _stitch(_summaries(rows, key, m), key, m)
    if not (spec or categories or extra):
        return changes
    whole = entity_agg(rows, key, spec, prefix, categories=categories, extra=extra)
    part = spec if subset_spec is None else subset_spec
    parts = [entity_agg(rows.filter(c), key, part, p) for p, c in (subsets or {}).items()]
    return attach_all(whole, [*parts, changes], key)


def _mark_global_final(df: DataFrame, key: str, m: Momentum) -> DataFrame:
    latest = df.groupBy(named(key)).agg(F.max(named(m.account)).alias("_latest"))
    latest = latest.select("_latest").distinct().withColumn("_is_latest", F.lit(True))
    joined = df.join(latest, named(m.account) == F.col("_latest"), "left")
    return joined.drop("_latest").withColumn("_is_latest", F.col("_is_latest").isNotNull())


def _lagged(df: DataFrame, within: Sequence[str], m: Momentum) -> DataFrame:
    """Add per record and column: the previous value and the last one known."""
    keys = ", ".join(sql_name(c) for c in within)
    w = f"PARTITION BY {keys} ORDER BY {', '.join(sql_name(c) for c in m.order_by)}"
    earlier = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    lagged = []
    for i, f in enumerate(m.features):
        lagged += [
            F.expr(f"lag({sql_num(f)}) OVER ({w})").alias(f"_prev{i}"),
            F.expr(f"last({sql_num(f)}, true) OVER ({earlier})").alias(f"_before{i}"),
        ]
    return df.select("*", *lagged)


def _changes(m: Momentum) -> list[Column]:
    changes = []
    for i, f in enumerate(m.features):
        known = f"coalesce({sql_num(f)}, _before{i})"
        percent = sql_no_nan(f"{sql_ratio(known, f'_before{i}')} - 1")
        changes += [
            F.expr(known).alias(f"_known{i}"),
            minus(f, f"_prev{i}").alias(f"_DIFF{i}"),
            F.expr(percent).alias(f"_PCT{i}"),
        ]
    return changes


def _with_changes(df: DataFrame, within: Sequence[str], m: Momentum) -> DataFrame:
    """Add per record: both changes, and whether its account is the latest."""
    group = Window.partitionBy(*[named(c) for c in within])
    # Rows of equal order always share a chunk, so looking inside chunks finds all of them.
    order = F.struct(*[named(c) for c in m.order_by])
    in_order = group.orderBy(*[named(c) for c in m.order_by])
    rows = _lagged(df, within, m).select(
        "*",
        F.max(named(m.account)).over(group).alias("_newest"),
        (F.lag(order).over(in_order) == order).alias("_repeats"),
        (F.row_number().over(in_order) == 1).alias("_is_first"),
        F.lead(F.lit(True)).over(in_order).isNull().alias("_is_last"),
    )
    final = (
        F.col("_is_latest")
        if m.scope == "global"
        else F.coalesce(named(m.account) == F.col("_newest"), F.lit(False))
    )
    return rows.select("*", final.alias("_final"), *_changes(m))


def _summaries(chunks: DataFrame, key: str, m: Momentum) -> DataFrame:
    """One row per entity and chunk with what its neighbours need to know of it."""
    used = dict.fromkeys([key, "_chunk", m.account, *m.order_by, *m.features])
    if m.scope == "global":
        used["_is_latest"] = None
    records = _with_changes(chunks.select(*[named(c) for c in used]), [key, "_chunk"], m)
    final, first, last = F.col("_final"), F.col("_is_first"), F.col("_is_last")
    summary = [
        F.max("_newest").alias("_newest"),
        F.max(F.when(first, final)).alias("_first_final"),
        F.count(F.when(F.col("_repeats"), 1)).alias("_repeats"),
    ]
    for i, f in enumerate(m.features):
        x = num(f)
        first_known = x.isNotNull() & F.col(f"_before{i}").isNull()
        leading = F.col(f"_known{i}").isNull()
        # One row at most is first, last or first known, so its value is the greatest.
        summary += [
            F.max(F.when(first, x)).alias(f"_first{i}"),
            F.max(F.when(last, x)).alias(f"_last{i}"),
            F.max(F.when(first_known, x)).alias(f"_first_known{i}"),
            F.max(F.when(first_known, final)).alias(f"_first_known_final{i}"),
            F.max(F.when(last, F.col(f"_known{i}"))).alias(f"_last_known{i}"),
            F.count(F.when(leading, 1)).alias(f"_leading{i}"),
            F.count(F.when(leading & final, 1)).alias(f"_leading_final{i}"),
        ]
        for change in CHANGES:
            c = F.col(f"_{change}{i}")
            summary += [
                F.sum(c).alias(f"_{change}_sum{i}"),
                F.count(c).alias(f"_{change}_n{i}"),
                F.sum(F.when(final, c)).alias(f"_{change}_final_sum{i}"),
                F.count(F.when(final, c)).alias(f"_{change}_final_n{i}"),
            ]
    return records.groupBy(named(key), "_chunk").agg(*summary)


def _stitch(per_chunk: DataFrame, key: str, m: Momentum) -> DataFrame:
    """Entity means from chunk summaries; one row per chunk and entity."""
    entity = Window.partitionBy(named(key))
    w = entity.orderBy("_chunk")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    borders = []
    for i in range(len(m.features)):
        carried = F.last(f"_last_known{i}", ignorenulls=True).over(earlier)
        borders += [F.lag(f"_last{i}").over(w).alias(f"_border{i}"), carried.alias(f"_carry{i}")]
    newest = F.max("_newest").over(entity).alias("_entity_newest")
    chunks = per_chunk.select("*", *borders, newest)
    # Records of the entity's latest account only sit in chunks that hold it.
    counts = (
        F.lit(True) if m.scope == "global" else F.col("_newest") == F.col("_entity_newest")
    )
    steps = [counts.alias("_holds_final")]
    for i in range(len(m.features)):
        carry = F.col(f"_carry{i}")
        steps += [
            minus(f"_first{i}", f"_border{i}").alias(f"_diff_step{i}"),
            no_nan(ratio(f"_first_known{i}", carry) - 1).alias(f"_pct_step{i}"),
            # Records before the first known value repeat the carried one.
            no_nan(ratio(carry, carry) - 1).alias(f"_flat_step{i}"),
        ]
    chunks = chunks.select("*", *steps)

    def mean(sums, counted):
        value = F.sum(sum(sums[1:], sums[0]))
        n = F.sum(sum(counted[1:], counted[0]))
        return F.when(repeats, F.raise_error(message)).otherwise(no_nan(F.try_divide(value, n)))

    repeats = F.sum("_repeats") > 0
    message = _open_order(key, m)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    has = lambda c: c.isNotNull().cast("long")
    out = []
    for i, f in enumerate(m.features):
        diff, pct, flat = (F.col(f"_{s}_step{i}") for s in ("diff", "pct", "flat"))
        holds = F.col("_holds_final")
        diff_fin = F.when(holds & F.col("_first_final"), diff)
        pct_fin = F.when(holds & F.col(f"_first_known_final{i}"), pct)
        lead, lead_fin = F.col(f"_leading{i}"), F.col(f"_leading_final{i}")
        in_fin = lambda c: F.when(F.col("_holds_final"), F.col(c))
        count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        out += [
            mean(
                [zero(F.col(f"_DIFF_sum{i}")), zero(diff)], [F.col(f"_DIFF_n{i}"), has(diff)]
            ).alias(f"{m.prefix}{f}_DIFF_MEAN"),
            mean(
                [zero(F.col(f"_PCT_sum{i}")), zero(pct)],
                [F.col(f"_PCT_n{i}"), has(pct), has(flat) * lead],
            ).alias(f"{m.prefix}{f}_PCT_MEAN"),
            mean(
                [zero(in_fin(f"_DIFF_final_sum{i}")), zero(diff_fin)],
                [count(in_fin(f"_DIFF_final_n{i}")), has(diff_fin)],
            ).alias(f"{m.prefix}{f}_DIFF_FIN"),
            mean(
                [zero(in_fin(f"_PCT_final_sum{i}")), zero(pct_fin)],
                [
                    count(in_fin(f"_PCT_final_n{i}")),
                    has(pct_fin),
                    count(F.when(holds, has(flat) * lead_fin)),
                ],
            ).alias(f"{m.prefix}{f}_PCT_FIN"),
        ]
    return chunks.groupBy(named(key)).agg(*out)


def _open_order(key: str, m: Momentum) -> Column:
    return F.lit(f"records of one {key} are equal in {', '.join(m.order_by)}: their order is open")


def row_changes(
    df: DataFrame, key: str, m: Momentum, chunks: int | None = None
) -> DataFrame:
    """Per record: difference and percent change of every followed column.

    Fails where two records of an entity are equal in the declared order.
    """
    rows = _lagged_in_chunks(df.filter(named(key).isNotNull()), key, m, chunks)
    tied = F.raise_error(_open_order(key, m))
    return rows.select("*", *_changes(m)).select(
        *[named(c) for c in df.columns],
        *[
            F.when(F.col("_tied"), tied).otherwise(F.col(f"_{change}{i}")).alias(f"{m.prefix}{f}_{change}")
            for i, f in enumerate(m.features)
            for change in CHANGES
        ],
    )


def _lagged_in_chunks(df: DataFrame, key: str, m: Momentum, chunks: int | None) -> DataFrame:
    """``_lagged`` over whole entities: chunks take over their start values."""
    chunks = chunk_by_order(df, [key, *m.order_by], chunks)
    order = F.struct(*[named(c) for c in m.order_by])
    ends, starts = [], []
    w = Window.partitionBy("_k").orderBy("_c")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    for i, f in enumerate(m.features):
        x = num(f)
        ends += [
            F.max_by(x, order).alias(f"_end{i}"),
            F.max_by(x, F.when(x.isNotNull(), order)).alias(f"_end_known{i}"),
        ]
        starts += [
            F.lag(f"_end{i}").over(w).alias(f"_border{i}"),
            F.last(f"_end_known{i}", ignorenulls=True).over(earlier).alias(f"_carry{i}"),
        ]
    ends = chunks.groupBy(named(key).alias("_k"), F.col("_chunk").alias("_c")).agg(*ends)
    starts = ends.select("_k", "_c", *starts)
    inside = Window.partitionBy(named(key), "_chunk").orderBy(*[named(c) for c in m.order_by])
    rows = _lagged(chunks, [key, "_chunk"], m).withColumn("_row", F.row_number().over(inside))
    # Equal places share a chunk, as chunks are cut by them.
    rows = rows.withColumn("_tied", order.eqNullSafe(F.lag(order).over(inside)))
    rows = rows.join(starts, (named(key) == F.col("_k")) & (F.col("_chunk") == F.col("_c")))
    filled = []
    for i in range(len(m.features)):
        previous = F.when(F.col("_row") == 1, F.col(f"_border{i}")).otherwise(F.col(f"_prev{i}"))
        filled += [
            previous.alias(f"_prev{i}"),
            F.coalesce(F.col(f"_before{i}"), F.col(f"_carry{i}")).alias(f"_before{i}"),
        ]
    return rows.select(*[named(c) for c in df.columns], "_tied", *filled)
