"""Aggregation, join, window and encoding operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitymill.operators import aggregate as ag
from entitymill.operators import attach as at
from entitymill.operators.encode import MISSING, factorize, find_categories, one_hot, sparse_one_hot
from entitymill.operators.momentum import Momentum, momentum, row_changes
from entitymill.operators.ordered import group_quantiles, prefix_sums
from entitymill.operators.select import correlation_pairs, missing_columns, select_features
from entitymill.queries import sqltext as sql
from entitymill.queries.base import SQL, cte, frame, query, stable, stable_columns, stable_sql
from entitymill.sources import tables as src
from entitymill.sources.staging import staged

# Orders with missing and zero amounts; status F/O/P stands for loan states.
ORDERS = {
    "cust": "case when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P' then null"
    " else o_custkey end",
    "id": "o_orderkey",
    "day": "o_orderdate",
    "amount": "case when o_orderpriority = '1-URGENT' then null"
    " when o_orderpriority = '2-HIGH' then 0 else o_totalprice end",
    "total": "o_totalprice",
    "rest": "case when o_orderstatus = 'F' then null else o_totalprice / 1000 end",
    "status": "o_orderstatus",
    "priority": "case when o_orderpriority = '5-LOW' then null else o_orderpriority end",
}
ORDERS_SQL = cte("orders", ORDERS)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", MISSING]


def orders(t):
    return frame(t.orders, ORDERS)


def _one_stat(key: str, stat: str):
    spec = {"amount": [stat], "rest": [stat]}

    @query(key, sql.aggregate(ORDERS_SQL, "cust", spec, "O_"))
    def _(t):
        return stable(ag.entity_agg(orders(t), "cust", spec, "O_"))


SPEC = {
    "amount": ["mean", "var", "max", "min", "skew", "sum", "size"],
    "rest": ["mean", "std", "sum", "nunique"],
}


@query("a1_multi_aggregate", sql.aggregate(ORDERS_SQL, "cust", SPEC, "O_"))
def _(t):
    return stable(ag.entity_agg(orders(t), "cust", SPEC, "O_"))


_one_stat("a2_mean", "mean")
_one_stat("a3_sum", "sum")


@query(
    "a4_min_max",
    sql.aggregate(ORDERS_SQL, "cust", {"amount": ["min", "max"], "rest": ["min", "max"]}),
)
def _(t):
    spec = {"amount": ["min", "max"], "rest": ["min", "max"]}
    return stable(ag.entity_agg(orders(t), "cust", spec))


_one_stat("a5_var", "var")
_one_stat("a6_std", "std")
_one_stat("a7_skew", "skew")
_one_stat("a8_size", "size")
_one_stat("a9_nunique", "nunique")


@query(
    "a10_group_median",
    f"select status, {stable_sql('median(amount)')} as median from ({ORDERS_SQL}) s group by status",
)
def _(t):
    rows = group_quantiles(orders(t), ["status"], "amount", [0.5])
    return stable(rows.select("status", F.col("quantile").alias("median")))


@query("a10_large_groups", SQL["a10_group_median"])
def _(t):
    """The same medians with every group cut into chunks."""
    rows = group_quantiles(orders(t), ["status"], "amount", [0.5], chunks=40)
    return stable(rows.select("status", F.col("quantile").alias("median")))


@query("a11_category_shares", sql.aggregate(ORDERS_SQL, "cust", {}, "O_", categories={"priority": PRIORITIES}))
def _(t):
    df = orders(t)
    found = find_categories(df, ["priority"])
    return stable(ag.entity_agg(df, "cust", {}, "O_", categories=found))


SUBSET_SPEC = {"amount": ["mean", "var", "max", "min", "skew", "sum", "size"], "rest": ["sum"]}
SUBSET_SQL = sql.aggregate(
    ORDERS_SQL, "cust", SUBSET_SPEC, "ALL_",
    {"OPEN_": (SUBSET_SPEC, "status = 'O'"), "PART_": (SUBSET_SPEC, "status = 'P'")},
)


@query("a12_subset_aggregates", SUBSET_SQL)
def _(t):
    subsets = {"OPEN_": "status = 'O'", "PART_": "status = 'P'"}
    return stable(ag.entity_agg(orders(t), "cust", SUBSET_SPEC, "ALL_", subsets))


@query(
    "p6_status_filter",
    sql.aggregate(f"select * from ({ORDERS_SQL}) a where status = 'F'", "cust", {"total": ["mean", "size"]}),
)
def _(t):
    df = orders(t).filter(F.col("status") == "F")
    return stable(ag.entity_agg(df, "cust", {"total": ["mean", "size"]}))


LINES = {
    # Only fulfilled lines name their order, so that some orders stay without any.
    "id": "case when l_linestatus = 'F' then l_orderkey end", "line": "l_linenumber", "qty": "l_quantity",
    "tax": "nullif(l_tax, 0)", "flag": "case when l_returnflag = 'N' then null else l_returnflag end",
    "late": "l_linestatus",
}
LINES_SQL = cte("lineitem", LINES)
CHILD = {"qty": ["min", "max", "size", "mean"]}
PARENT = {"qty_MIN": ["mean", "min"], "qty_MAX": ["mean", "max"], "qty_SIZE": ["mean", "sum"]}
FLAG_VALUES = {"flag": ["A", "R", MISSING]}


def lines(t):
    return frame(t.lineitem, LINES)


CHILD_SQL = sql.aggregate(LINES_SQL, "id", CHILD, categories=FLAG_VALUES, rounded=False)
SHARES = {f"flag_{v}_MEAN": ["mean"] for v in ("A", "R", "nan")}


@query(
    "a13_two_level",
    sql.aggregate(
        f"select o.*, c.* exclude (id) from ({ORDERS_SQL}) o left join ({CHILD_SQL}) c using (id)",
        "cust", {**PARENT, **SHARES}, "L_",
    ),
)
def _(t):
    out = ag.two_level(
        lines(t), orders(t), "id", "cust", CHILD, PARENT, "L_", child_categories=FLAG_VALUES
    )
    return stable(out)


@query(
    "a14_child_one_hot_range",
    "select id, min(cast(flag is not distinct from 'A' as int))::double as \"flag_A_MIN\","
    " max(cast(flag is not distinct from 'A' as int))::double as \"flag_A_MAX\","
    " max(cast(flag is null as int))::double as \"flag_nan_MAX\""
    f" from ({LINES_SQL}) s where id is not null group by id",
)
def _(t):
    encoded, _ = one_hot(lines(t), categories={"flag": ["A", MISSING]})
    return ag.entity_agg(encoded, "id", {"flag_A": ["min", "max"], "flag_nan": ["max"]})


@query(
    "a15_mean_ratio",
    f"select {stable_sql(f'coalesce(avg(r), 0.5)')} as mean_ratio from"
    f" (select {sql.ratio('rest', 'total')} as r from ({ORDERS_SQL}) s) u",
)
def _(t):
    df = orders(t)
    value = ag.mean_ratio(df, "rest", "total")
    return stable(df.sparkSession.createDataFrame([(value,)], "mean_ratio double"))


A16 = ["cust", "amount", "rest", "status", "priority"]


@query(
    "a16_null_shares",
    " union all ".join(
        f"select '{c}' as feature, {stable_sql(f'avg(case when {c} is null then 1.0::double else 0 end)')}"
        f" as null_share from ({ORDERS_SQL}) s"
        for c in A16
    ),
)
def _(t):
    return stable(ag.null_shares(orders(t).select(A16)))


# Order lines as (feature, importance, fold): part type, price and line number.
IMPORTANCES = {
    "feature": "p_type || ' ' || p_brand || ' ' || p_name",
    "importance": "l_extendedprice",
    "fold": "l_linenumber",
}
IMPORTANCES_SQL = cte("lineitem join part on l_partkey = p_partkey", IMPORTANCES)


def importances(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return frame(joined, IMPORTANCES)


@query(
    "a17_importance_totals",
    f"select feature, {stable_sql('sum(importance)')} as importance_sum,"
    f" {stable_sql('avg(importance)')} as importance_mean from ({IMPORTANCES_SQL}) s group by feature",
)
def _(t):
    return stable(ag.importance_totals(importances(t)))


STATUS = {"status": ["F", "O", "P"]}


@query(
    "a18_share_ratio",
    f"select cust, {stable_sql(sql.ratio('\"O_status_O_MEAN\"', '\"O_status_F_MEAN\"'))} as r"
    f" from ({sql.aggregate(ORDERS_SQL, 'cust', {}, 'O_', categories=STATUS, rounded=False)}) s",
)
def _(t):
    shares = ag.entity_agg(orders(t), "cust", {}, "O_", categories=STATUS)
    return stable(ag.share_ratio(shares, "r", "O_status_O_MEAN", "O_status_F_MEAN").select("cust", "r"))


@query(
    "a19_frame_shape",
    "select count(quality) as train_rows, count(*) - count(quality) as test_rows,"
    " 6::bigint as n_columns from documents left join labels using (doc_id)",
)
def _(t):
    df = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return ag.frame_shape(df, "quality")


# ---- joins and set operations ----------------------------------------------

OPEN_SQL = sql.aggregate(f"select * from ({ORDERS_SQL}) a where status = 'P'", "cust", {"total": ["mean"]}, "P_")
LOW_SQL = sql.aggregate(
    f"select * from ({ORDERS_SQL}) a where priority = '1-URGENT'", "cust", {"total": ["max"]}, "U_"
)


@query(
    "j1_attach_chain",
    f"select c_custkey as cust, c_name, * exclude (cust, c_custkey, c_name, u) from"
    f" (select c_custkey, c_name from customer) c left join ({OPEN_SQL}) p on c_custkey = p.cust"
    f" left join (select cust as u, \"U_total_MAX\" from ({LOW_SQL}) x) u on c_custkey = u",
)
def _(t):
    df = orders(t)
    part = ag.entity_agg(df.filter(F.col("status") == "P"), "cust", {"total": ["mean"]}, "P_")
    urgent = ag.entity_agg(
        df.filter(F.col("priority") == "1-URGENT"), "cust", {"total": ["max"]}, "U_"
    )
    base = t.customer.select(F.col("c_custkey").alias("cust"), "c_name")
    return stable(at.attach_all(base, [part, urgent], "cust"))


@query(
    "j2_attach_child",
    f"select o.id, o.status, {stable_columns(['qty_MIN', 'qty_MAX', 'qty_MEAN'])}, \"qty_SIZE\"::double as \"qty_SIZE\""
    f" from ({ORDERS_SQL}) o left join ({CHILD_SQL}) c using (id)",
)
def _(t):
    out = at.attach(orders(t), ag.entity_agg(lines(t), "id", CHILD), "id")
    size = F.col("qty_SIZE").cast("double").alias("qty_SIZE")
    return stable(out.select("id", "status", "qty_MIN", "qty_MAX", "qty_MEAN", size))


@query("j3_subset_join_free", SUBSET_SQL)
def _(t):
    """The subsets of ``a12`` by plain joins: the single pass must agree."""
    df = orders(t)
    parts = [ag.entity_agg(df, "cust", SUBSET_SPEC, "ALL_")]
    for prefix, value in (("OPEN_", "O"), ("PART_", "P")):
        rows = df.filter(F.col("status") == value)
        parts.append(ag.entity_agg(rows, "cust", SUBSET_SPEC, prefix))
    return stable(at.attach_all(parts[0], parts[1:], "cust"))


@query(
    "j4_mean_std_join",
    f"select id, {stable_sql('total - m')} as off_mean, {stable_sql('s')} as spread from"
    f" ({ORDERS_SQL}) o left join (select cust, avg(amount) as m, stddev_samp(amount) as s from"
    f" ({ORDERS_SQL}) a where cust is not null group by cust) g using (cust)",
)
def _(t):
    df = orders(t)
    stats = ag.entity_agg(df, "cust", {"amount": ["mean", "std"]})
    out = at.attach(df, stats, "cust")
    return stable(
        out.select(
            "id",
            (F.col("total") - F.col("amount_MEAN")).alias("off_mean"),
            F.col("amount_STD").alias("spread"),
        )
    )


@query(
    "j5_lookup_median",
    f"select id, priority, {stable_sql('m')} as typical from ({ORDERS_SQL}) o left join"
    f" (select priority as p, median(amount) as m from ({ORDERS_SQL}) s where priority is not null"
    " group by priority) g on priority = p",
)
def _(t):
    df = orders(t)
    medians = group_quantiles(df, ["priority"], "amount", [0.5])
    medians = medians.select("priority", F.col("quantile").alias("typical"))
    return stable(at.attach_lookup(df, medians, "priority").select("id", "priority", "typical"))


@query(
    "j6_semi_join",
    f"select id, cust from ({ORDERS_SQL}) o where id in"
    f" (select max(id) from ({ORDERS_SQL}) m where cust is not null group by cust)",
)
def _(t):
    df = orders(t)
    latest = df.filter("cust IS NOT NULL").groupBy("cust").agg(F.max("id").alias("id"))
    return at.keep_matching(df, latest.select("id"), "id").select("id", "cust")


@query(
    "u1_union_missing_column",
    "select c_custkey, c_nationkey, c_acctbal from customer union all"
    " select s_suppkey, s_nationkey, null from supplier",
)
def _(t):
    test = t.supplier.selectExpr("s_suppkey as c_custkey", "s_nationkey as c_nationkey")
    return at.append_unlabelled(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), test)


@query(
    "u2_append_folds",
    "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O', 'P')",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderstatus")
    return at.append_all([df.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")])


@query(
    "u3_new_columns",
    f"select id, {', '.join(f'cast(status = {chr(39)}{v}{chr(39)} as int) as \"status_{v}\"' for v in 'FOP')}"
    f" from ({ORDERS_SQL}) s",
)
def _(t):
    df = orders(t).select("id", "status")
    encoded, new = one_hot(df, missing=False)
    return encoded.select("id", *new)


@query(
    "k1_top_features",
    f"select * from ({IMPORTANCES_SQL}) s where feature in (select feature from ({IMPORTANCES_SQL}) u"
    " group by feature order by avg(importance) desc, feature limit 40)",
)
def _(t):
    return at.top_features(importances(t), 40)


@query(
    "k2_sort_by_share",
    "select feature, null_share from (" + " union all ".join(
        f"select '{c}' as feature, {stable_sql(f'avg(case when {c} is null then 1.0::double else 0 end)')}"
        f" as null_share from ({ORDERS_SQL}) s" for c in A16
    ) + ") t order by null_share desc, feature",
)
def _(t):
    return stable(ag.null_shares(orders(t).select(A16)).orderBy(F.desc("null_share"), "feature"))


# ---- windows ---------------------------------------------------------------

MOVES = Momentum(["amount", "rest"], "id", ["day", "id"], "O_")
LAG = "(partition by cust order by day, id"


def _row_change_sql() -> str:
    known = ", ".join(
        f"{c} - lag({c}) over {LAG}) as d_{c}, last_value({c} ignore nulls) over {LAG}"
        f" rows between unbounded preceding and current row) as k_{c}"
        for c in ("amount", "rest")
    )
    before = lambda c: f"lag(k_{c}) over {LAG})"
    cols = ", ".join(
        f"{stable_sql(f'd_{c}')} as \"O_{c}_DIFF\","
        f" {stable_sql(sql.ratio(f'k_{c}', before(c)) + ' - 1')} as \"O_{c}_PCT\""
        for c in ("amount", "rest")
    )
    return (
        f"select id, {cols} from (select *, {known} from ({ORDERS_SQL}) s"
        " where cust is not null) t"
    )


ROW_SQL = _row_change_sql()


@query("w1_row_difference", f'select id, "O_amount_DIFF", "O_rest_DIFF" from ({ROW_SQL}) r')
def _(t):
    out = row_changes(orders(t), "cust", MOVES)
    return stable(out.select("id", "O_amount_DIFF", "O_rest_DIFF"))


@query("w2_percent_change", f'select id, "O_amount_PCT", "O_rest_PCT" from ({ROW_SQL}) r')
def _(t):
    out = row_changes(orders(t), "cust", MOVES)
    return stable(out.select("id", "O_amount_PCT", "O_rest_PCT"))


MEANS = [f"O_{c}_{x}_MEAN" for c in ("amount", "rest") for x in ("DIFF", "PCT")]
MOVES_SQL = sql.momentum(ORDERS_SQL, "cust", "id", ["amount", "rest"], ["day", "id"], "O_")


@query("w3_mean_changes", f"select cust, {', '.join(f'\"{c}\"' for c in MEANS)} from ({MOVES_SQL}) m")
def _(t):
    return stable(momentum(orders(t), "cust", MOVES).select("cust", *MEANS))


# Accounts shared by customers: the order priority as account number.
SHARED = {**ORDERS, "account": "cast(substr(o_orderpriority, 1, 1) as int)"}
SHARED_SQL = cte("orders", SHARED)


def _final_loan(key: str, scope: str):
    follow = ["amount", "total"]

    @query(key, sql.momentum(SHARED_SQL, "cust", "account", follow, ["day", "id"], "O_", scope))
    def _(t):
        m = Momentum(follow, "account", ["day", "id"], "O_", scope)
        return stable(momentum(frame(t.orders, SHARED), "cust", m))


_final_loan("w4_final_account_group", "group")
_final_loan("w4_final_account_global", "global")

EVENTS = {
    "user": "user_id", "event": "event_id", "ts": "ts", "value": "value",
    "gain": "case when event_type = 'click' then null else value - 200 end",
    "spend": "case when event_type = 'view' then 0 else value * 2 end",
}


@query(
    "w5_many_columns",
    sql.momentum(cte("events", EVENTS), "user", "event", ["value", "gain", "spend"], ["ts", "event"], "E_"),
)
def _(t):
    m = Momentum(["value", "gain", "spend"], "event", ["ts", "event"], "E_")
    return stable(momentum(frame(t.events, EVENTS), "user", m))


@query(
    "w6_key_is_account",
    sql.momentum(
        cte("lineitem", {"id": "l_orderkey", "line": "l_linenumber", "part": "l_partkey", "day": "l_shipdate"}),
        "id", "id", ["line"], ["day", "line", "part"], "B_",
    ),
)
def _(t):
    df = frame(
        t.lineitem,
        {"id": "l_orderkey", "line": "l_linenumber", "part": "l_partkey", "day": "l_shipdate"},
    )
    return stable(momentum(df, "id", Momentum(["line"], "id", ["day", "line", "part"], "B_")))


@query("w5_large_entities", SQL["w5_many_columns"])
def _(t):
    """The same changes with the larger entities cut into chunks."""
    m = Momentum(["value", "gain", "spend"], "event", ["ts", "event"], "E_")
    return stable(momentum(frame(t.events, EVENTS), "user", m, chunks=40))


# ---- encoders --------------------------------------------------------------


def _hot_sql(values: dict[str, list]) -> str:
    cols = [
        f"cast({c} is null as int) as \"{c}_nan\""
        if v is MISSING
        else f"cast({c} is not distinct from '{v}' as int) as \"{c}_{v}\""
        for c, vs in values.items()
        for v in vs
    ]
    return f"select id, {', '.join(cols)} from ({ORDERS_SQL}) s"


@query("e1_one_hot", _hot_sql({"status": ["F", "O", "P", MISSING], "priority": PRIORITIES}))
def _(t):
    return one_hot(orders(t).select("id", "status", "priority"))[0]


@query("e2_one_hot_no_missing", _hot_sql({"status": ["F", "O", "P"], "priority": PRIORITIES[:-1]}))
def _(t):
    return one_hot(orders(t).select("id", "status", "priority"), missing=False)[0]


@query(
    "e3_factorize",
    f"select id, coalesce(s.code, -1)::int as status, coalesce(p.code, -1)::int as priority from ({ORDERS_SQL}) o"
    + "".join(
        f" left join (select v, row_number() over (order by f) - 1 as code from (select {c} as v,"
        f" min(struct_pack(d := day, i := id)) as f from ({ORDERS_SQL}) x where {c} is not null"
        f" group by {c}) y) {c[0]} on o.{c} = {c[0]}.v"
        for c in ("status", "priority")
    ),
)
def _(t):
    df = factorize(orders(t), ["status", "priority"], ["day", "id"])
    return df.select("id", "status", "priority")


@query("e3_factorize_many_values", SQL["e3_factorize"])
def _(t):
    """The same codes, ranked as if there were too many to broadcast."""
    df = factorize(orders(t), ["status", "priority"], ["day", "id"], chunks=40)
    return df.select("id", "status", "priority")


# ---- column selection ------------------------------------------------------

WIDE = {
    "qty": "l_quantity", "price": "l_extendedprice", "disc": "nullif(l_discount, 0)",
    "tax": "nullif(l_tax, 0)", "net": "l_extendedprice * (1 - l_discount)",
    "edge": "case when l_discount = 0 then cast('Infinity' as double) else l_discount end",
    "flat": "cast(1 as double)",
    "rare": "case when l_discount = 0 then l_tax end",
}
WIDE_SQL = cte("lineitem", WIDE)


@query(
    "f1_missing_columns",
    " union all ".join(
        f"select '{c}' as feature from ({WIDE_SQL}) s having avg(cast({c} is null as int)) > 0.75"
        for c in WIDE
    ),
)
def _(t):
    df = frame(t.lineitem, WIDE)
    names = missing_columns(df, 0.75)
    return df.sparkSession.createDataFrame([(c,) for c in names], "feature string")


def _pair_sql() -> str:
    names = list(WIDE)
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            a_, b_ = f"cast({a} as double)", f"cast({b} as double)"
            finite = f"isfinite({a_}) and isfinite({b_})"
            r = sql.no_nan(f"corr({a_}, {b_}) filter (where {finite})")
            infinite = f"count(*) filter (where {a} is not null and {b} is not null and not ({finite}))"
            pairs.append(
                f"select '{a}' as feature_a, '{b}' as feature_b, case when {infinite} = 0 then"
                f" {stable_sql(r)} end as correlation from ({WIDE_SQL}) s"
            )
    return " union all ".join(pairs)


@query("f2_correlation_pairs", _pair_sql())
def _(t):
    return stable(correlation_pairs(frame(t.lineitem, WIDE)))


@query(
    "f3_select_features",
    f"select {', '.join(stable_sql(f'cast({c} as double)') + f' as {c}' for c in WIDE if c not in ('net', 'edge', 'rare'))}"
    f" from ({WIDE_SQL}) s",
)
def _(t):
    return stable(select_features(frame(t.lineitem, WIDE), 0.75, 0.9))


# ---- sources and sinks -----------------------------------------------------


@query("s1_csv_scan", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, rest from"
       " (select *, case when o_orderstatus = 'F' then null else o_totalprice / 1000 end as rest from orders) o")  # fmt: skip
def _(t):
    path = t.scratch("s1")
    df = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.expr("case when o_orderstatus = 'F' then null else o_totalprice / 1000 end").alias("rest"),
    )
    src.write_csv(df, path)
    return src.read_csv(t.spark, path)


@query(
    "p17_file_order",
    "select c_custkey as id, cast(row_number() over (order by c_acctbal desc, c_custkey) - 1 as bigint) as place from customer",
)
def _(t):
    """Rows numbered in the order of the CSV files that they were written to."""
    path = t.scratch("p17")
    rows = t.customer.select("c_custkey", "c_acctbal")
    src.write_csv(rows.repartitionByRange(4, F.desc("c_acctbal"), "c_custkey").sortWithinPartitions(F.desc("c_acctbal"), "c_custkey"), path)
    read = src.read_csv(t.spark, path, file_order=True)
    return prefix_sums(read, [], [src.FILE_ORDER], {"place": F.lit(1)}).select(F.col("c_custkey").alias("id"), F.col("place").cast("long").alias("place"))


@query(
    "s2_head_rows",
    "select o_orderkey, o_totalprice from orders order by o_orderdate, o_orderkey limit 500",
)
def _(t):
    return src.head_rows(t.orders, ["o_orderdate", "o_orderkey"], 500).select(
        "o_orderkey", "o_totalprice"
    )


@query("s3_feature_table_scan", sql.aggregate(ORDERS_SQL, "cust", {"total": ["mean", "sum"]}))
def _(t):
    path = t.scratch("s3")
    ag.entity_agg(orders(t), "cust", {"total": ["mean", "sum"]}).write.parquet(path)
    return stable(src.read_parquet(t.spark, path, ["cust", "total_MEAN", "total_SUM"]))


@query("s4_staged_table", sql.aggregate(ORDERS_SQL, "cust", {"total": ["mean", "sum"]}))
def _(t):
    path = t.scratch("s4")
    build = lambda: ag.entity_agg(orders(t), "cust", {"total": ["mean", "sum"]})
    facts = {"table": "orders", "folder": t.folder}
    staged(build, path, t.spark, facts)
    return stable(staged(lambda: None, path, t.spark, facts))


SCORED_SQL = "select c_custkey as id, (c_acctbal + 1000) / 11000 as prediction, c_nationkey as target from customer"


def scored(t):
    return t.customer.selectExpr(
        "c_custkey as id", "(c_acctbal + 1000) / 11000 as prediction", "c_nationkey as target"
    )


@query("s5_submission_sink", f'select id, {stable_sql("prediction")} as "TARGET" from ({SCORED_SQL}) s')
def _(t):
    path = t.scratch("s5")
    src.write_submission(scored(t), path, "id")
    return stable(src.read_csv(t.spark, path, "id bigint, TARGET double"))


@query("s6_oof_sink", f'select id, target, {stable_sql("prediction")} as "OOF_PRED" from ({SCORED_SQL}) s')
def _(t):
    path = t.scratch("s6")
    src.write_oof(scored(t), path, "id", "target")
    return stable(src.read_csv(t.spark, path, "id bigint, target int, OOF_PRED double"))


@query(
    "s7_importance_sink",
    f"select feature, {stable_sql('sum(importance)')} as importance_sum,"
    f" {stable_sql('avg(importance)')} as importance_mean from ({IMPORTANCES_SQL}) s group by feature",
)
def _(t):
    path = t.scratch("s7")
    src.write_csv(ag.importance_totals(importances(t)), path)
    return stable(src.read_csv(t.spark, path))


@query(
    "s8_parameter_sink",
    f"select {stable_sql('avg(l_quantity)')} as max_depth, {stable_sql('max(l_tax)')} as subsample from lineitem",
)
def _(t):
    path = t.scratch("s8")
    row = t.lineitem.agg(F.avg("l_quantity").alias("d"), F.max("l_tax").alias("s")).first()
    src.write_params(t.spark, {"max_depth": row["d"], "subsample": row["s"]}, path)
    return stable(src.read_csv(t.spark, path))


@query(
    "s9_selected_table_scan",
    f"select {stable_sql('qty')} as qty, {stable_sql('tax')} as tax from ({WIDE_SQL}) s",
)
def _(t):
    path = t.scratch("s9")
    select_features(frame(t.lineitem, WIDE), 0.75, 0.9).write.parquet(path)
    return stable(src.read_parquet(t.spark, path, ["qty", "tax"]))


SEGMENT = "case when c_custkey % 7 = 0 then null else c_mktsegment end"


@query(
    "e1_sparse_one_hot",
    "with r as (select c_custkey as id, s, c_name, dense_rank() over (order by s nulls last) - 1 as a,"
    f" dense_rank() over (order by c_name) - 1 as b from (select *, {SEGMENT} as s from customer) c),"
    " n as (select count(distinct s) as segments, count(distinct c_name) as names from r)"
    " select id, cast(a as int) as segment_at, cast(segments + 1 + b as int) as name_at, cast(segments + names + 2 as int) as size from r, n",
)
def _(t):
    """A column of few and one of very many categories as positions of one sparse vector."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.expr(SEGMENT).alias("segment"), F.col("c_name").alias("name"))
    vectors, _ = sparse_one_hot(rows, ["segment", "name"])
    parts = F.unwrap_udt("categories")
    places = parts.getField("indices")
    return vectors.select("id", places[0].alias("segment_at"), places[1].alias("name_at"), parts.getField("size").alias("size"))
