"""Cleaning, scalar and row-wise operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitymill.functions import rowwise as rw
from entitymill.functions import scalar as sc
from entitymill.operators import clean
from entitymill.operators.attach import split_labelled
from entitymill.queries.base import cte, frame, query, stable, stable_sql
from entitymill.queries.sqltext import no_nan, ratio

LINE_KEY = {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
    "l_shipdate": "l_shipdate",
}
KEYS = ", ".join(k for k in LINE_KEY if k != "l_shipdate")
# Line items with missing values, zeros, negatives and infinities.
LINES = {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
    "qty": "l_quantity",
    "price": "l_extendedprice",
    "disc": "l_discount",
    "tax": "nullif(l_tax, 0)",
    "gap": "case when l_returnflag = 'R' then null when l_returnflag = 'A' then 0"
    " else l_quantity - 25 end",
    "edge": "case when l_discount = 0 then cast('Infinity' as double) when l_tax = 0 then"
    " cast('-Infinity' as double) else l_tax end",
    "status": "l_linestatus",
    "flag": "case when l_returnflag = 'N' then null else l_returnflag end",
}
LINES_SQL = cte("lineitem", LINES)


def lines(t):
    return frame(t.lineitem, LINES)


def keyed(df, **new):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[e.alias(n) for n, e in new.items()])


def keyed_sql(**new) -> str:
    cols = ", ".join(f"{e} as {n}" for n, e in new.items())
    return f"select {KEYS}, {cols} from ({LINES_SQL}) s"


def d(e: str) -> str:
    return f"cast({e} as double)"


# ---- projections and filters -----------------------------------------------


@query("p1_column_subset", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "p2_name_pattern",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus from lineitem",
)
def _(t):
    df = t.lineitem
    return df.select(clean.columns_where(df, lambda c: c.endswith("key") or "line" in c or "flag" in c))


@query("p3_feature_list", "select c_name, c_nationkey, c_mktsegment from customer")
def _(t):
    df = t.customer
    return df.select(clean.feature_columns(df, ["c_custkey", "c_acctbal"]))


@query("p4_drop_columns", "select p_partkey, p_brand, p_type, p_size from part")
def _(t):
    return t.part.drop("p_name", "p_retailprice")


@query(
    "p5_not_equal_keeps_missing",
    f"select {KEYS}, flag from ({LINES_SQL}) s where flag is distinct from 'A'",
)
def _(t):
    return clean.drop_where(lines(t), "flag", "A").select(*KEYS.split(", "), "flag")


LABELLED_SQL = (
    "select d.doc_id, d.n_chars, l.quality from documents d left join labels l using (doc_id)"
)


@query(
    "p7_label_split",
    f"select quality is not null as labelled, count(*) as n, sum(n_chars)::bigint as chars"
    f" from ({LABELLED_SQL}) s group by 1",
)
def _(t):
    df = t.documents.join(t.labels, "doc_id", "left")
    parts = []
    for name, part in zip((True, False), split_labelled(df, "quality"), strict=True):
        parts.append(
            part.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(
                F.lit(name).alias("labelled"), "n", "chars"
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "p8_drop_incomplete",
    f"select {KEYS}, gap, {d('tax')} as tax from ({LINES_SQL}) s"
    " where gap is not null and tax is not null",
)
def _(t):
    cols = [*KEYS.split(", "), "gap", "tax"]
    return clean.drop_incomplete(lines(t).select(cols))


@query(
    "p9_sentinel_to_missing",
    keyed_sql(disc=d("nullif(disc, 0)"), status="nullif(status, 'O')", flag="nullif(flag, 'A')"),
)
def _(t):
    return keyed(
        lines(t),
        disc=sc.blank_if("disc", 0.0),
        status=sc.blank_if("status", "O"),
        flag=sc.blank_if("flag", "A"),
    )


@query("p10_outlier_to_missing", keyed_sql(gap=d("case when gap < -10 then null else gap end")))
def _(t):
    return keyed(lines(t), gap=sc.blank_below("gap", -10))


@query("p11_fill_constant", keyed_sql(tax=d("coalesce(tax, 0)"), gap=d("coalesce(gap, 0)")))
def _(t):
    return keyed(lines(t), tax=sc.or_value("tax", 0.0), gap=sc.or_value("gap", 0.0))


@query(
    "p12_fill_mean",
    f"select {KEYS}, {stable_sql('coalesce(tax, avg(tax) over ())')} as tax,"
    f" {stable_sql('coalesce(gap, avg(gap) over ())')} as gap from ({LINES_SQL}) s",
)
def _(t):
    cols = [*KEYS.split(", "), "tax", "gap"]
    return stable(clean.fill_mean(lines(t).select(cols), ["tax", "gap"]))


@query(
    "p13_fill_sentinel",
    keyed_sql(
        tax=d("coalesce(tax, -999)"),
        edge=d("case when isinf(edge) then -999 else edge end"),
        flag="flag",
    ),
)
def _(t):
    cols = [*KEYS.split(", "), "tax", "edge", "flag"]
    return clean.fill_constant(lines(t).select(cols), ["tax", "edge", "flag"])


@query(
    "p14_infinite_to_missing",
    keyed_sql(qty=d("qty"), edge=d("case when isinf(edge) then null else edge end")),
)
def _(t):
    cols = [*KEYS.split(", "), "qty", "edge"]
    return clean.to_finite_doubles(lines(t).select(cols), ["qty", "edge"])


@query(
    "p15_min_max_scale",
    f"select {KEYS}, {'(price - min(price) over ()) / (max(price) over () - min(price) over ())'}"
    f" as price, {'(gap - min(gap) over ()) / (max(gap) over () - min(gap) over ())'} as gap,"
    f" 0.0::double as flat from ({LINES_SQL}) s",
)
def _(t):
    df = lines(t).select(*KEYS.split(", "), "price", "gap", F.lit(7.0).alias("flat"))
    return clean.min_max_scale(df, ["price", "gap", "flat"])


@query("p16_relabel", "select o_orderkey as id, o_totalprice as amount from orders")
def _(t):
    return clean.relabel(t.orders.select("o_orderkey", "o_totalprice"), ["id", "amount"])


# ---- scalar functions ------------------------------------------------------


@query(
    "x1_safe_ratio",
    keyed_sql(
        plain=ratio("price", "qty"),
        by_zero=ratio("gap", "disc"),
        edges=ratio("edge", "gap"),
        both=ratio("edge", "edge"),
    ),
)
def _(t):
    return keyed(
        lines(t),
        plain=sc.ratio("price", "qty"),
        by_zero=sc.ratio("gap", "disc"),
        edges=sc.ratio("edge", "gap"),
        both=sc.ratio("edge", "edge"),
    )


@query(
    "x2_arithmetic",
    keyed_sql(
        total="gap + tax",
        difference=no_nan("(edge - edge)"),
        product="qty * gap * tax",
    ),
)
def _(t):
    return keyed(
        lines(t),
        total=sc.plus("gap", "tax"),
        difference=sc.minus("edge", "edge"),
        product=sc.times("qty", "gap", "tax"),
    )


@query("x3_smoothed_ratio", keyed_sql(r=ratio("price", "(1 + gap)")))
def _(t):
    return keyed(lines(t), r=sc.ratio("price", 1 + sc.num("gap")))


@query(
    "x4_powers",
    keyed_sql(
        square="gap * gap", cube="gap * gap * gap",
        cross_term="qty * tax * tax",
    ),
)
def _(t):
    return keyed(
        lines(t),
        square=sc.times("gap", "gap"),
        cube=sc.times("gap", "gap", "gap"),
        cross_term=sc.times("qty", "tax", "tax"),
    )


ROW = ["qty", "tax", "gap"]
VALUES = "list_filter([qty, tax, gap], lambda v: v is not null)"


def list_stat(name: str) -> str:
    return f"list_{name}({VALUES})"


@query(
    "x5_row_mean",
    keyed_sql(
        m=list_stat("avg"),
        all_missing="list_avg(list_filter([gap, null], lambda v: v is not null))",
    ),
)
def _(t):
    return keyed(lines(t), m=rw.row_mean(*ROW), all_missing=rw.row_mean("gap"))


@query(
    "x6_row_sum",
    keyed_sql(s=f"coalesce(list_sum({VALUES}), 0)", none="coalesce(gap, 0)"),
)
def _(t):
    return keyed(lines(t), s=rw.row_sum(*ROW), none=rw.row_sum("gap"))


@query(
    "x7_row_min_max",
    keyed_sql(lo="least(qty, tax, gap)", hi="greatest(qty, tax, gap)", one=d("gap")),
)
def _(t):
    return keyed(lines(t), lo=rw.row_min(*ROW), hi=rw.row_max(*ROW), one=rw.row_max("gap"))


@query("x8_row_median", keyed_sql(m=list_stat("median")))
def _(t):
    return keyed(lines(t), m=rw.row_median(*ROW))


@query("x9_row_std", keyed_sql(s=stable_sql(list_stat("stddev_samp"))))
def _(t):
    return stable(keyed(lines(t), s=rw.row_std(*ROW)))


FLAGS = [f"b{i}" for i in range(8)]
FLAG_EXPRS = {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
    **{f"b{i}": f"case when l_quantity > {6 * i + 3} then 1.0 else 0.0 end" for i in range(8)},
}


def _kurtosis_sql() -> str:
    # Eight flags: with p ones, the fourth and second central moments are known.
    p = "(" + " + ".join(f"cast({b} as double)" for b in FLAGS) + ")"
    m = f"({p} / 8.0)"
    m2 = f"({p} * pow(1 - {m}, 2) + (8 - {p}) * pow({m}, 2))"
    m4 = f"({p} * pow(1 - {m}, 4) + (8 - {p}) * pow({m}, 4))"
    full = f"8 * 9 * 7 * {m4} / (6 * 5 * pow({m2}, 2)) - 3 * 49 / 30.0"
    return f"case when {p} = 0 or {p} = 8 then 0 else {full} end"


@query(
    "x10_row_kurtosis",
    f"select {KEYS}, {_kurtosis_sql()} as k from ({cte('lineitem', FLAG_EXPRS)}) s",
)
def _(t):
    df = rw.with_row_kurtosis(frame(t.lineitem, FLAG_EXPRS), "k", FLAGS)
    return df.select(*KEYS.split(", "), "k")


@query(
    "x11_flags",
    keyed_sql(
        below="cast(coalesce(gap < 0, false) as int)",
        above="cast(coalesce(tax > 0.04, false) as int)",
        same="cast(coalesce(flag = 'A', false) as int)",
        other="cast(flag is distinct from 'A' as int)",
    ),
)
def _(t):
    return keyed(
        lines(t),
        below=sc.flag("gap < 0"),
        above=sc.flag("tax > 0.04"),
        same=sc.flag("flag = 'A'"),
        other=sc.flag("NOT (flag <=> 'A')"),
    )


@query("x12_clamp", keyed_sql(late=d("greatest(coalesce(gap, 0), 0)"), early=d("greatest(coalesce(-gap, 0), 0)")))
def _(t):
    return keyed(
        lines(t), late=sc.at_least_zero("gap"), early=sc.at_least_zero(-sc.num("gap"))
    )


@query("x13_weighted_sum", keyed_sql(s="qty * 2 + tax * 3 + gap * 4"))
def _(t):
    return keyed(lines(t), s=sc.weighted_sum({"qty": 2, "tax": 3, "gap": 4}))


@query("x14_negated_ratio", keyed_sql(r=ratio("-gap", "disc")))
def _(t):
    return keyed(lines(t), r=sc.ratio(-sc.num("gap"), "disc"))


@query(
    "x15_ratio_of_ratios",
    keyed_sql(r=ratio(ratio("price", "qty"), ratio("gap", "disc"))),
)
def _(t):
    return keyed(lines(t), r=sc.ratio(sc.ratio("price", "qty"), sc.ratio("gap", "disc")))


@query(
    "x16_binary_ends",
    keyed_sql(p=d("case when qty / 50 < 0.1 then 0 when qty / 50 > 0.9 then 1 else qty / 50 end")),
)
def _(t):
    return keyed(lines(t), p=sc.to_binary_ends(F.col("qty") / 50, 0.1, 0.9))


@query("x17_linear_blend", keyed_sql(p="0.3::double * qty + 0.7::double * tax"))
def _(t):
    return keyed(lines(t), p=sc.blend_of(["qty", "tax"], [0.3, 0.7]))
