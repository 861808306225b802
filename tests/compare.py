"""Row-by-row comparison of a query with its SQL, order ignored."""

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [
        tuple(None if v is None or v != v or (isinstance(v, float) and math.isnan(v)) else v for v in r)
        for r in df.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns}
    assert {c: k for c, k in kinds.items() if k[0] != k[1]} == {}
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b) > 0
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, f"{len(different)} of {len(a)} rows differ, first: {different[0]}"
