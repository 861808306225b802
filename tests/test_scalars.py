"""Null, zero and infinity rules of scalar and row-wise expressions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from entitymill.functions import rowwise as rw
from entitymill.functions import scalar as sc
from entitymill.operators import clean

INF = math.inf


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_ratio_edges(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (4.0, 2.0),
            (INF, INF), (INF, 2.0), (1.0, INF), (INF, 0.0)]
    expected = [INF, -INF, None, None, None, 2.0, None, INF, 0.0, INF]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    assert values(df, sc.ratio("a", "b")) == expected
    assert values(df, sc.ratio(F.col("a"), F.col("b"))) == expected


def test_undefined_arithmetic_is_missing(spark):
    df = spark.createDataFrame([(INF, INF), (INF, 0.0), (None, 1.0)], "a double, b double")
    df = df.coalesce(1)
    assert values(df, sc.minus("a", "b")) == [None, INF, None]
    assert values(df, sc.plus("a", "b")) == [INF, INF, None]
    assert values(df, sc.times("a", "b")) == [INF, None, None]


def test_flags_treat_missing_as_false_but_different(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "c string").coalesce(1)
    assert values(df, sc.flag("c = 'A'")) == [1, 0, 0]
    assert values(df, sc.differs("c", "A")) == [False, True, True]
    assert values(df, sc.blank_if("c", "A")) == [None, "B", None]
    assert [r[0] for r in clean.drop_where(df, "c", "A").collect()] == ["B", None]


def test_outliers_clamps_and_ends(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (0.4,), (7.0,)], "x double").coalesce(1)
    assert values(df, sc.blank_below("x", 0)) == [None, None, 0.4, 7.0]
    assert values(df, sc.at_least_zero("x")) == [0.0, 0.0, 0.4, 7.0]
    assert values(df, sc.to_binary_ends("x", 0.0, 1.0)) == [0.0, None, 0.4, 1.0]
    assert values(df, sc.or_value("x", 0.0)) == [-5.0, 0.0, 0.4, 7.0]


def test_odd_column_names(spark, tmp_path):
    names = ["NEW_SOURCE_1^2", "X_Spouse, partner", "X_a.b", "(x)=1", "it's `so`"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.0)], ", ".join(
        "`" + n.replace("`", "``") + "` double" for n in names))
    for n in names[:-1]:
        assert values(df, sc.ratio(n, names[-1])) == [INF]
    df.select(*[sc.named(n) for n in names[:-1]]).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == names[:-1]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 6])
def test_rowwise_matches_brute_force(spark, width):
    rng = np.random.default_rng(width)
    data = rng.normal(size=(200, width))
    data[rng.random((200, width)) < 0.3] = np.nan
    data[:5] = 2.5
    cols = [f"c{i}" for i in range(width)]
    pdf = pd.DataFrame(data, columns=cols)
    pdf["id"] = range(200)
    df = spark.createDataFrame([
        (*[None if np.isnan(v) else float(v) for v in r[:-1]], int(r[-1])) for r in pdf.to_numpy()
    ], ", ".join(f"{c} double" for c in cols) + ", id int")
    df = rw.with_row_kurtosis(df, "kurt", cols)
    got = df.select(
        "id", "kurt", rw.row_mean(*cols).alias("mean"), rw.row_sum(*cols).alias("sum"),
        rw.row_min(*cols).alias("min"), rw.row_max(*cols).alias("max"),
        rw.row_median(*cols).alias("median"), rw.row_std(*cols).alias("std"),
    ).toPandas().set_index("id").sort_index()
    x = pdf[cols]
    for name in ("mean", "sum", "min", "max", "median", "std"):
        np.testing.assert_allclose(got[name], getattr(x, name)(axis=1), rtol=1e-9, atol=1e-12)
    if width >= 4:
        np.testing.assert_allclose(got["kurt"], x.kurt(axis=1), rtol=1e-8, atol=1e-10)
    else:
        assert got["kurt"].isna().all()


def test_fills_and_scaling(spark):
    df = spark.createDataFrame(
        [(1, 1.0, INF, "a"), (2, None, 2.0, None), (3, 3.0, None, "b")],
        "id int, x double, y double, s string",
    )
    mean = clean.fill_mean(df, ["x"]).orderBy("id")
    assert [r.x for r in mean.collect()] == [1.0, 2.0, 3.0]
    filled = clean.fill_constant(df, ["x", "y", "s"]).orderBy("id").collect()
    assert [r.y for r in filled] == [-999.0, 2.0, -999.0]
    assert [r.s for r in filled] == ["a", None, "b"]
    finite = clean.to_finite_doubles(df, ["y"]).orderBy("id").collect()
    assert [r.y for r in finite] == [None, 2.0, None]
    scaled = clean.min_max_scale(df.withColumn("c", F.lit(5.0)), ["x", "c"]).orderBy("id")
    assert [(r.x, r.c) for r in scaled.collect()] == [(0.0, 0.0), (None, 0.0), (1.0, 0.0)]
