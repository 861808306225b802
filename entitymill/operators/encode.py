"""One-hot and first-appearance encoding of string columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from entitymill.functions.scalar import named, sql_name, sql_value
from entitymill.operators.ordered import prefix_sums
from entitymill.sources.staging import cut_lineage, share_code, written

#: Categories of all columns together that may become columns.
MOST_CATEGORIES = 100_000
# Stands for the indicator of a missing category; its column ends in ``_nan``.
MISSING = type("Missing", (), {"__repr__": lambda self: "MISSING"})()


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, StringType) and f.name not in exclude
    ]


def category_column(column: str, value) -> str:
    return f"{column}_nan" if value is MISSING else f"{column}_{value}"


def in_category(column: str, value) -> str:
    """SQL condition: the row belongs to the category."""
    c = sql_name(column)
    return f"{c} IS NULL" if value is MISSING else f"{c} <=> {sql_value(value)}"


def find_categories(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    missing: bool = True,
    max_categories: int = MOST_CATEGORIES,
) -> dict[str, list]:
    """Sorted categories of each string column, from one distributed pass.

    With ``missing`` every column also gets the missing indicator, whether or
    not a value is missing. Every category becomes a column, so the driver holds
    them all; more than ``max_categories`` are an error, and work for ``sparse_one_hot``.
    """
    columns = string_columns(df) if columns is None else list(columns)
    found: dict[str, list] = {c: [] for c in columns}
    if columns:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), named(c).alias("value")) for c in columns]
        )
        distinct = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
        for row in _bounded(distinct, columns, max_categories):
            found[row["column"]].append(row["value"])
    return {c: sorted(v) + ([MISSING] if missing else []) for c, v in found.items()}


def _bounded(categories: DataFrame, columns: Sequence[str], most: int) -> list:
    rows = categories.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(
            f"more than {most} categories in {list(columns)}; drop or group the high-cardinality "
            "column, take sparse_one_hot, or pass max_categories"
        )
    return rows


def one_hot(
    df: DataFrame,
    missing: bool = True,
    categories: Mapping[str, Sequence] | None = None,
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Replace string columns by 0/1 columns; returns the frame and new names.

    ``categories`` fixes the output schema and saves the discovery pass; rows
    with other values then get zeros.
    """
    if categories is None:
        categories = find_categories(df, columns, missing)
    new = {}
    for c, values in categories.items():
        for v in values:
            new[category_column(c, v)] = F.expr(f"int({in_category(c, v)})")
    kept = [named(c) for c in df.columns if c not in categories]
    return df.select(*kept, *[e.alias(n) for n, e in new.items()]), list(new)


def first_seen(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """(column, value, first): every value of the columns and where it appears first.

    One pass over the rows, written; it serves ``factorize`` and ``categories_of``.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), named(c).alias("value")) for c in columns]
    )
    order = F.struct(*[named(c) for c in order_by]).alias("first")
    values = df.select(order, F.inline(pairs)).filter(F.col("value").isNotNull())
    return cut_lineage(values.groupBy("column", "value").agg(F.min("first").alias("first")))


def categories_of(firsts: DataFrame, columns: Sequence[str], missing: bool = True) -> dict[str, list]:
    """``find_categories`` from what ``first_seen`` found."""
    found: dict[str, list] = {c: [] for c in columns}
    values = firsts.filter(F.col("column").isin(list(columns))).select("column", "value")
    for row in _bounded(values, columns, MOST_CATEGORIES):
        found[row["column"]].append(row["value"])
    return {c: sorted(v) + ([MISSING] if missing else []) for c, v in found.items()}


def factorize(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    chunks: int | None = None,
    firsts: DataFrame | None = None,
) -> DataFrame:
    """Replace values by codes 0, 1, ... in order of first appearance.

    Missing values get -1. ``order_by`` must order the rows totally. Distinct
    values are ranked by running counts and joined; the plan broadcasts the
    codes of a column if their bytes turn out small. ``firsts`` is what
    ``first_seen`` found, if it was asked already.
    """
    if firsts is None:
        firsts = first_seen(df, columns, order_by)
    firsts = firsts.filter(F.col("column").isin(list(columns)))
    ranked = prefix_sums(firsts, ["column"], ["first"], {"code": F.lit(1)}, chunks=chunks)
    ranked = cut_lineage(ranked)
    for c in columns:
        lookup = ranked.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").cast("int").alias("_code")
        )
        df = df.join(lookup, named(c) == F.col("_value"), "left").withColumn(
            c, F.coalesce(F.col("_code"), F.lit(-1))
        )
        df = df.drop("_value", "_code")
    return df


# ---- categories as positions of a sparse vector ------------------------------


def category_index(df: DataFrame, columns: Sequence[str], missing: bool = True) -> DataFrame:
    """(column, value, index), written: the position that ``sparse_one_hot`` gives every category.

    Positions are in the order of ``one_hot``: by column, then by value, the missing
    indicator last. Distinct values are numbered in ordered chunks; none reaches the driver.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_c"), named(c).alias("value")) for i, c in enumerate(columns)])
    values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct().withColumn("_missing", F.lit(0))
    if missing:
        indicators = df.sparkSession.createDataFrame([(i, None, 1) for i in range(len(columns))], "_c int, value string, _missing int")
        values = values.unionByName(indicators)
    numbered = prefix_sums(values, [], ["_c", "_missing", "value"], {"index": F.lit(1)})
    return written(numbered.select(F.col("_c").alias("column"), "value", F.col("index").cast("int").alias("index")))


def sparse_one_hot(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    missing: bool = True,
    out: str = "categories",
    index: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """Replace string columns by one sparse 0/1 vector ``out``; returns the frame and the vector's size.

    However many categories there are, the driver holds their number and the place of each
    column's missing indicator. Categories are joined; the plan broadcasts those of a column
    if their bytes turn out small, and splits hot ones otherwise. With ``index`` of another
    table, other values get no position.
    """
    columns = string_columns(df) if columns is None else list(columns)
    if index is None:
        index = category_index(df, columns, missing)
    absent = {r["column"]: r["index"] for r in index.filter("value IS NULL").collect()}
    size = (index.agg(F.max("index")).first()[0] if columns else None) or 0
    size = size + 1 if index.take(1) else 0
    kept = [c for c in df.columns if c not in columns]
    places = [f"_at{i}" for i in range(len(columns))]
    for i, (c, at) in enumerate(zip(columns, places, strict=True)):
        lookup = index.filter((F.col("column") == i) & F.col("value").isNotNull())
        lookup = lookup.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        place = F.coalesce(F.col("_index"), F.when(named(c).isNull(), F.lit(absent.get(i)).cast("int")))
        df = df.join(lookup, named(c) == F.col("_value"), "left").withColumn(at, place).drop("_value", "_index")
    rows = df.select(*[named(c) for c in kept], *places)
    schema = StructType([*rows.schema.fields[: len(kept)], StructField(out, VectorUDT())])

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.empty((batch.num_rows, len(places)))
            for i in range(len(places)):
                at[:, i] = batch.column(len(kept) + i).to_numpy(zero_copy_only=False)
            there = ~np.isnan(at)
            vector = sparse_vectors(there.sum(axis=1), at[there].astype(np.int32), np.ones(int(there.sum())), size)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], vector], names=[*kept, out])

    share_code(rows.sparkSession)
    return rows.mapInArrow(to_vectors, schema), size


def sparse_vectors(counts: np.ndarray, indices: np.ndarray, values: np.ndarray, size: int) -> pa.StructArray:
    """MLlib's sparse vectors as Arrow structs: ``counts`` entries a row, indices ascending in each."""
    n = len(counts)
    stops = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(stops, pa.array(indices.astype(np.int32))),
         pa.ListArray.from_arrays(stops, pa.array(values.astype(np.float64)))],
        names=["type", "size", "indices", "values"],
    )


def append_sparse(df: DataFrame, dense: str, dense_size: int, sparse: str, sparse_size: int) -> DataFrame:
    """``df`` with the vectors of column ``sparse`` appended to those of ``dense``; the first column is left out.

    Unlike MLlib's assembler it keeps no names, so the size of the vectors costs the driver nothing.
    """
    kept = [c for c in df.columns if c not in (dense, sparse)]
    rows = df.select(*[named(c) for c in kept], named(dense), F.unwrap_udt(named(sparse)).alias("_s"))
    rows = rows.withColumn(dense, F.unwrap_udt(named(dense)))
    schema = StructType([*rows.schema.fields[: len(kept)], StructField(dense, VectorUDT())])

    def parts(column: pa.StructArray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for v in column.to_pylist():
            values = np.array(v["values"])
            at = np.arange(size) if v["type"] == 1 else np.array(v["indices"], np.int64)
            yield at[values != 0], values[values != 0]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, indices, values = [], [], []
            for (i, v), (j, w) in zip(parts(batch.column(len(kept)), dense_size), parts(batch.column(len(kept) + 1), sparse_size), strict=True):
                counts.append(len(i) + len(j))
                indices += [i, j + dense_size]
                values += [v, w]
            none = [np.zeros(0)]
            vector = sparse_vectors(np.array(counts, int), np.concatenate(indices or none), np.concatenate(values or none), dense_size + sparse_size)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], vector], names=[*kept, dense])

    return rows.mapInArrow(joined, schema)
