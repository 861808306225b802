"""Registry of the queries that run on the shipped tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.functions.scalar import named, sql_name
from entitymill.sources.staging import shared_dir


@dataclass(frozen=True)
class Tables:
    """The parquet tables of one folder, read on first use."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A fresh path in the folder that all executors share."""
        return f"{shared_dir(self.spark)}/entitymill/{name}-{uuid.uuid4().hex}"


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL it must agree with."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def frame(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns given as expressions that read alike in Spark SQL and in ANSI SQL."""
    return df.selectExpr(*[f"{e} as `{n}`" for n, e in columns.items()])


def cte(table: str, columns: Mapping[str, str]) -> str:
    return "select " + ", ".join(f'{e} as "{n}"' for n, e in columns.items()) + f" from {table}"


# Below this, noise around zero would still show in seven digits.
TINY = 0.00098765
# Moves exact decimals away from the point where seven digits round either way.
NUDGE = 1.00000000003


def _cut(x: str, float_type: str, nudge: str, zero: str) -> str:
    short = f"cast(cast({x} * {nudge} as {float_type}) as double)"
    return f"(case when abs({x}) < {TINY} then round({x}, 6) + {zero} else {short} end)"


def stable(df: DataFrame) -> DataFrame:
    """Doubles cut to about seven digits, so that summation order cannot show."""
    return df.select(
        *[
            F.expr(_cut(sql_name(c), "float", f"{NUDGE}D", "0D")).alias(c)
            if t == "double"
            else named(c)
            for c, t in df.dtypes
        ]
    )


def stable_sql(e: str) -> str:
    return _cut(f"({e})", "float", f"{NUDGE}::double", "0.0::double")


def stable_columns(columns) -> str:
    """``stable`` for quoted column names of a subquery."""
    return ", ".join(f'{stable_sql(q(c))} as {q(c)}' for c in columns)


def q(name: str) -> str:
    return '"' + name + '"'
