"""SQL text for the checks: the same statistics, written with lists and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from entitymill.operators.encode import MISSING, category_column
from entitymill.queries.base import q, stable_sql

INF = "'inf'::double"


def ratio(a: str, b: str) -> str:
    a, b = f"cast({a} as double)", f"cast({b} as double)"
    return (
        f"(case when {a} is null or {b} is null or (isinf({a}) and isinf({b})) then null"
        f" when {b} = 0 then (case when {a} > 0 then {INF} when {a} < 0 then -{INF} end)"
        f" else {a} / {b} end)"
    )


def no_nan(e: str) -> str:
    return f"(case when isnan({e}) then null else {e} end)"


def stat(name: str, values: str, rows: str, guard: str) -> str:
    """Statistic of a list of the present values; ``guard`` is true if rows exist."""
    finite = f"list_filter({values}, lambda v: isfinite(v))"
    has_inf = f"len({finite}) < len({values})"
    if name == "size":
        e = rows
    elif name == "nunique":
        e = f"len(list_distinct({values}))"
    elif name == "mean":
        e = no_nan(f"list_avg({values})")
    elif name == "sum":
        e = f"coalesce({no_nan(f'list_sum({values})')}, case when len({values}) = 0 then 0 end)"
    elif name in ("min", "max"):
        e = f"list_{name}({values})"
    elif name in ("var", "std"):
        fn = "list_var_samp" if name == "var" else "list_stddev_samp"
        e = f"(case when {has_inf} then null else {fn}({finite}) end)"
    elif name == "skew":
        m = f"list_avg({finite})"
        s2 = f"list_sum(list_transform({finite}, lambda v: pow(v - {m}, 2)))"
        s3 = f"list_sum(list_transform({finite}, lambda v: pow(v - {m}, 3)))"
        n = f"len({values})"
        constant = (
            f"list_min({values}) = list_max({values}) or {s2} < 0.00000000000001"
            f" or abs({s3}) < 0.00000000000001"
        )
        g1 = f"sqrt({n}) * {s3} / pow({s2}, 1.5)"
        e = (
            f"(case when {n} < 3 or {has_inf} then null when {constant} then 0"
            f" else {g1} * sqrt({n} * ({n} - 1.0)) / ({n} - 2) end)"
        )
    else:
        raise ValueError(name)
    return f"(case when {guard} then {e} end)"


def aggregate(
    source: str,
    key: str,
    spec: Mapping[str, Sequence[str]],
    prefix: str = "",
    subsets: Mapping[str, tuple[Mapping, str]] | None = None,
    categories: Mapping[str, Sequence] | None = None,
    extra: Mapping[str, str] | None = None,
    rounded: bool = True,
) -> str:
    """One row per key: every statistic over all rows and over each subset.

    ``subsets`` maps a prefix to (spec, condition).
    """
    parts = {prefix: (spec, "true"), **(subsets or {})}
    lists, out = [], []
    wrap = stable_sql if rounded else (lambda e: e)
    for i, (p, (part, condition)) in enumerate(parts.items()):
        lists.append(f"count(*) filter (where {condition}) as n{i}")
        for j, (c, stats) in enumerate(part.items()):
            lists.append(
                f"coalesce(list(cast({q(c)} as double)) filter (where {q(c)} is not null and"
                f" ({condition})), []) as l{i}_{j}"
            )
            for s in stats:
                e = stat(s, f"l{i}_{j}", f"n{i}", f"n{i} > 0")
                whole = s in ("size", "nunique")
                if whole and i:  # a subset may be empty, so counts are doubles
                    e = f"cast({e} as double)"
                out.append(f"{e if whole else wrap(e)} as {q(f'{p}{c}_{s.upper()}')}")
    for c, values in (categories or {}).items():
        for v in values:
            hit = f"{q(c)} is null" if v is MISSING else f"{q(c)} is not distinct from '{v}'"
            name = f"{prefix}{category_column(c, v)}_MEAN"
            lists.append(f"avg(case when {hit} then 1.0::double else 0 end) as {q(name)}")
            out.append(f"{wrap(q(name))} as {q(name)}")
    for name, e in (extra or {}).items():
        lists.append(f"{e} as {q(name)}")
        out.append(q(name))
    return (
        f"select {q(key)}, {', '.join(out)} from (select {q(key)}, {', '.join(lists)}"
        f" from ({source}) s where {q(key)} is not null group by {q(key)}) g"
    )


def momentum(
    source: str,
    key: str,
    account: str,
    features: Sequence[str],
    order_by: Sequence[str],
    prefix: str = "",
    scope: str = "group",
    rounded: bool = True,
) -> str:
    order = ", ".join(q(c) for c in order_by)
    w = f"(partition by {q(key)} order by {order}"
    wrap = stable_sql if rounded else (lambda e: e)
    known, steps, out = [], [], []
    for i, f in enumerate(features):
        x = f"cast({q(f)} as double)"
        known.append(f"{x} as x{i}, lag({x}) over {w}) as p{i}")
        known.append(
            f"last_value({x} ignore nulls) over {w} rows between unbounded preceding and"
            f" current row) as k{i}"
        )
        steps.append(f"{no_nan(f'x{i} - p{i}')} as d{i}")
        before = f"lag(k{i}) over {w})"
        steps.append(f"{no_nan(f'{ratio(f'k{i}', before)} - 1')} as c{i}")
        for part, where in (("MEAN", ""), ("FIN", " filter (where final)")):
            for change, col in (("DIFF", "d"), ("PCT", "c")):
                e = no_nan(f"avg({col}{i}){where}")
                out.append(f"{wrap(e)} as {q(f'{prefix}{f}_{change}_{part}')}")
    keyed = f"select * from ({source}) s where {q(key)} is not null"
    if scope == "group":
        final = f"coalesce({q(account)} = max({q(account)}) over (partition by {q(key)}), false)"
    else:
        final = (
            f"{q(account)} in (select max({q(account)}) from ({keyed}) m group by {q(key)})"
        )
    return (
        f"select {q(key)}, {', '.join(out)} from ("
        f"select {q(key)}, final, {', '.join(steps)} from ("
        f"select *, {final} as final, {', '.join(known)} from ({keyed}) a) b) c"
        f" group by {q(key)}"
    )


def join_on(key: str, *parts: str) -> str:
    """Inner join of subqueries that hold the same keys."""
    text = f"select * from ({parts[0]}) t0"
    for i, p in enumerate(parts[1:], 1):
        text += f" join ({p}) t{i} using ({q(key)})"
    return text


def auc(source: str, label: str, score: str, by: Sequence[str] = ()) -> str:
    """Tie-aware AUC; columns: the groups and ``auc``, not rounded."""
    groups = "".join(f"{q(b)}, " for b in by)
    over = f"partition by {', '.join(q(b) for b in by)} " if by else ""
    tail = f" group by {', '.join(q(b) for b in by)}" if by else ""
    return (
        f"select {groups}sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) as auc"
        f" from (select *, coalesce(sum(neg) over ({over}order by score rows between unbounded"
        f" preceding and 1 preceding), 0) as below from (select {groups}{q(score)} as score,"
        f" cast(count(*) filter (where {q(label)} = 1) as double) as pos,"
        f" cast(count(*) filter (where {q(label)} <> 1) as double) as neg from ({source}) s"
        f" where {q(label)} is not null and {q(score)} is not null"
        f" group by {groups}{q(score)}) t) u{tail}"
    )
