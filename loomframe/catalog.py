"""Every operator as a query over the driver's tables, with the SQL that gives the same rows.

Statistics are rounded on both sides, since engines add in different orders. The tables hold no missing value, so
queries about missing ones make them, alike on both sides.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.expr import col, where
from loomframe.functions import datetimes
from loomframe.operators import index as labels
from loomframe.operators import vectors as V
from loomframe.operators.concat import concat
from loomframe.operators.frame import Frame, Key
from loomframe.operators.groupby import group_count, group_size
from loomframe.operators.merge import join, merge
from loomframe.operators.ndarray import NDArray, concatenate
from loomframe.operators.ndarray import where as nd_pick
from loomframe.operators.resample import resample
from loomframe.operators.reshape import melt, pivot, pivot_table, stack, unstack
from loomframe.operators.series import Series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ORDER_KEYS = {"customer": "c_custkey", "events": "event_id", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey", "embeddings": "vec_id", "documents": "doc_id"}


class Tables:
    """The driver's tables as frames, ordered by their unique key where they have one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> Frame:
        return Frame.of(self.raw(name), ORDER_KEYS.get(name))


def query(sql: str, name: str | None = None):
    def add(f: Callable[[Tables], Frame | Series | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            out = out.to_frame() if isinstance(out, Series) else out
            return out.to_spark() if isinstance(out, Frame) else out

        key = name or f.__name__
        QUERIES[key], SQL[key] = run, sql
        return f

    return add


def rounded(f: Frame, digits: int, *names: str) -> DataFrame:
    df = f.to_spark()
    return df.withColumns({n: F.round(df[n], digits) for n in names})


def gapped(f: Frame, **tests: str) -> Frame:
    """The frame with values made missing where a column equals a literal."""
    return f._put({n: F.nullif(F.col(n), F.expr(v)) for n, v in tests.items()})


# --- the text query language --------------------------------------------------------------------------------


@query("select * from lineitem where l_quantity > 30 and l_returnflag in ('A', 'R')")
def query_filter(t):
    return t.lineitem.query("l_quantity > 30 and l_returnflag in ['A', 'R']")


@query("select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity * 2 + l_linenumber > 95 and l_linenumber in (1, 2, 3)")
def query_arith_in(t):
    return t.lineitem.query("l_quantity * 2 + l_linenumber > 95 and l_linenumber in (1, 2, 3)").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus not in ('F') and (o_totalprice < 1000 or not o_totalprice < 400000)")
def query_not_in(t):
    return t.orders.query("o_orderstatus not in ['F'] and (o_totalprice < 1000 or not o_totalprice < 400000)").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("select p_partkey, p_name, p_brand from part where contains(p_type, 'BRASS') or starts_with(p_brand, 'Brand#1') and not ends_with(p_name, '5')")
def query_str(t):
    return t.part.query("p_type.str.contains('BRASS') or p_brand.str.startswith('Brand#1') and not p_name.str.endswith('5')").select("p_partkey", "p_name", "p_brand")


@query("select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-06 12:00:00'")
def query_datetime(t):
    return t.events.query("ts >= '2024-01-05' and ts < '2024-01-06 12:00:00'").select("event_id", "ts")


@query("select l_orderkey, l_linenumber, l_quantity > 45 as big from lineitem where l_quantity > 45 and l_tax = 0.04")
def query_bool(t):
    return t.lineitem.assign_expr("big", col("l_quantity") > 45).query("big and l_tax = 0.04").select("l_orderkey", "l_linenumber", "big")


@query("select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount from lineitem where not (nullif(l_discount, 0) > 0.05)")
def query_missing_not(t):
    return gapped(t.lineitem, l_discount="0D").query("not l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_discount")


@query("select p_partkey from part where p_size > 10")
def query_null_literal(t):
    return t.part.query("not p_size == null and p_size > 10").select("p_partkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12 and l_tax >= 0.02 and nullif(l_discount, 0) is not null")
def where_between_notna(t):
    return gapped(t.lineitem, l_discount="0D").where(col("l_quantity").between(10, 12) & (col("l_tax") >= 0.02) & col("l_discount").notna()).select("l_orderkey", "l_linenumber", "l_quantity")


# --- columns ------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem")
def assign_expr(t):
    f = t.lineitem.assign_expr("revenue", col("l_extendedprice") * (1 - col("l_discount"))).select("l_orderkey", "l_linenumber", "revenue")
    return rounded(f, 4, "revenue")


@query("select l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0) > 0.05, false) as high from lineitem")
def assign_predicate(t):
    return gapped(t.lineitem, l_discount="0D").assign_expr("high", col("l_discount") > 0.05).select("l_orderkey", "l_linenumber", "high")


@query("select o_orderkey, o_totalprice, 7::bigint as k from orders")
def assign_value(t):
    return t.orders.assign_value("k", 7)._put({"k": F.col("k").cast("long")}).select("o_orderkey", "o_totalprice", "k")


@query("select p_partkey, concat(p_brand, '/', p_size::varchar) as tag from part")
def assign_func(t):
    return t.part.assign_func("tag", lambda r: f"{r['p_brand']}/{r['p_size']}", "string").select("p_partkey", "tag")


@query("select p_partkey, case when p_size > 25 then 'large' else 'small' end as size_class from part")
def where_expr(t):
    return t.part.assign_expr("size_class", where(col("p_size") > 25, "large", "small")).select("p_partkey", "size_class")


@query("select l_orderkey, l_linenumber, l_tax / l_discount as ratio from lineitem where l_tax > 0 or l_discount > 0")
def arith_safe_div(t):
    return t.lineitem.query("l_tax > 0 or l_discount > 0").assign_expr("ratio", col("l_tax") / col("l_discount")).select("l_orderkey", "l_linenumber", "ratio")


@query("select p_partkey, p_size % 7 as m, pow(p_size, 2)::double as sq, abs(p_size - 25)::double as d, sqrt(p_size) as r from part")
def arith_mod_pow(t):
    f = t.part.assign_expr("m", col("p_size") % 7).assign_expr("sq", col("p_size") ** 2).assign_expr("d", (col("p_size") - 25).abs()).assign_expr("r", col("p_size").sqrt())
    return f._put({"m": F.col("m").cast("int")}).select("p_partkey", "m", "sq", "d", "r")


@query("select l_orderkey, l_linenumber, round_even(l_extendedprice * 100 / 100, 1) as p from lineitem")
def round_half_even(t):
    return t.lineitem.rename({"l_extendedprice": "p"}).round(1, "p").select("l_orderkey", "l_linenumber", "p")


@query("select c_custkey, abs(least(greatest(c_acctbal, -500.0), 5000.0)) as c_acctbal from customer")
def clip_abs(t):
    return t.customer.clip(-500.0, 5000.0, "c_acctbal").abs("c_acctbal").select("c_custkey", "c_acctbal")


@query("select o_orderkey, o_totalprice as price, o_orderstatus from orders")
def select_drop_rename(t):
    return t.orders.drop("o_orderdate", "o_orderpriority", "o_custkey").rename({"o_totalprice": "price"}).select("o_orderkey", "price", "o_orderstatus")


@query("select o_orderkey::varchar as o_orderkey, trunc(o_totalprice)::bigint as o_totalprice, o_custkey::double as o_custkey from orders")
def astype(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_custkey").astype({"o_orderkey": "string", "o_totalprice": "int", "o_custkey": "float64"})


@query("select s_suppkey, s_nationkey, s_acctbal from supplier")
def select_dtypes(t):
    return t.supplier.select_dtypes(include=["number"])


@query("select o_orderkey, null::varchar as nothing, o_custkey from orders")
def reindex_columns(t):
    return t.orders.reindex_columns("o_orderkey", "nothing", "o_custkey")


@query("select label, s_name from (values (3), (1), (-5), (7)) v(label) left join supplier on s_suppkey = label")
def reindex_labels(t):
    f = Frame(t.raw("supplier").select(F.col("s_suppkey").cast("int").alias("label"), "s_name"), [Key("label")], ["label"])
    f = Frame(f.df.withColumn("__o0", F.col("label")), [Key("__o0")], ["label"])
    return f.reindex([3, 1, -5, 7])


# --- rows ---------------------------------------------------------------------------------------------------


@query("select event_id, user_id, value from events order by event_id limit 7")
def head(t):
    return t.events.select("event_id", "user_id", "value").head(7)


@query("select event_id, user_id, value from events order by event_id desc limit 7")
def tail(t):
    return t.events.select("event_id", "user_id", "value").tail(7)


@query("select event_id, user_id from events order by event_id limit 10 offset 20")
def slice_rows(t):
    return t.events.select("event_id", "user_id").slice(20, 30)


@query("with e as (select *, row_number() over (order by event_id) - 1 as p from events) select event_id, user_id from (values (5), (2), (5), (-1)) v(k) left join e on p = k")
def take_positions(t):
    return t.events.select("event_id", "user_id").take([5, 2, 5, -1])


@query("with e as (select *, row_number() over (order by event_id) - 1 as p, count(*) over () as n from events) select event_id, user_id from e where p in (3, 10, 12, 14) or p = n - 1")
def iloc_rows(t):
    return t.events.select("event_id", "user_id").iloc_rows(3, slice(10, 16, 2), -1)


@query("select event_type, event_id, user_id from events where event_type in ('click', 'view')")
def loc_labels(t):
    f = t.events.set_index("event_type").select("event_id", "user_id")
    have = [r[0] for r in t.raw("events").select("event_type").distinct().collect()]
    return f.loc_rows(*[x for x in ("click", "view") if x in have])


@query("select ts, event_id from events where ts between timestamp '2024-01-03' and timestamp '2024-01-04'")
def loc_range(t):
    return t.events.set_index("ts").select("event_id").loc_range("2024-01-03", "2024-01-04")


@query("select o_orderkey::varchar as o_orderkey, o_custkey from orders where o_orderkey between (select min(o_orderkey) + 4 from orders) and (select min(o_orderkey) + 9 from orders)")
def loc_range_positions(t):
    f = t.orders
    first = t.raw("orders").agg(F.min("o_orderkey")).first()[0]
    return f._put({"__oid": F.col("o_orderkey")}).set_index("o_orderkey").select("o_custkey").loc_range(str(first + 4), str(first + 9))


@query("select l_orderkey, l_linenumber, l_discount, l_tax from (select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem) where l_discount is not null and l_tax is not null")
def dropna_any(t):
    return _gaps(t).dropna()


@query("select l_orderkey, l_linenumber, l_discount, l_tax from (select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem) where l_discount is not null or l_tax is not null")
def dropna_all(t):
    return _gaps(t).dropna(how="all", subset=["l_discount", "l_tax"])


@query("select l_orderkey, l_linenumber, l_discount, l_tax from (select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem) where (l_discount is not null)::int + (l_tax is not null)::int >= 1")
def dropna_thresh(t):
    return _gaps(t).dropna(thresh=3)


@query("select l_orderkey, l_linenumber, l_discount, l_tax from (select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem) where l_tax is not null")
def dropna_subset(t):
    return _gaps(t).dropna(subset=["l_tax", "nothing"])


@query("select l_orderkey, l_linenumber from lineitem")
def dropna_columns(t):
    return _gaps(t).dropna(axis=1)


@query("select l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), -1.0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem")
def fillna(t):
    return _gaps(t).fillna({"l_discount": -1.0})


@query("select false as l_orderkey, false as l_linenumber, l_discount = 0 as l_discount, l_tax = 0 as l_tax from lineitem")
def isna_matrix(t):
    return _gaps(t).isna()


def _gaps(t) -> Frame:
    return gapped(t.lineitem, l_discount="0D", l_tax="0D").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("select event_id, row_number() over (partition by user_id, event_type order by event_id) > 1 as dup from events")
def duplicated(t):
    f = t.events
    s = f.duplicated(["user_id", "event_type"])
    return s.frame.rename({"__dup": "dup"}).select("event_id", "dup")


@query("select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def drop_duplicates(t):
    return t.events.drop_duplicates(["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("select count(*) as n from (select * from events limit 100)")
def sample(t):
    return t.events.sample(100, seed=3).df.agg(F.count(F.lit(1)).alias("n"))


# --- reductions ---------------------------------------------------------------------------------------------

_STATS = ("sum", "mean", "std", "var", "min", "max", "median", "count", "nunique")


@query(
    """select 'l_quantity' as "column", sum(l_quantity) as sum, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std, round(var_samp(l_quantity), 5) as var,
    min(l_quantity) as min, max(l_quantity) as max, median(l_quantity) as median, count(l_quantity) as count, count(distinct l_quantity) as nunique from lineitem"""
)
def reduce_all(t):
    from loomframe.operators.series import reduction

    f = t.lineitem
    field = f.schema["l_quantity"]
    out = f.df.agg(*[reduction(h, F.col("l_quantity"), field).alias(h) for h in _STATS]).withColumn("column", F.lit("l_quantity"))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), "var": F.round("var", 5)})


@query(
    "with s as (select unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) as stat, unnest([count(l_quantity)::double, avg(l_quantity), stddev_samp(l_quantity), min(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), max(l_quantity)]) as q, "
    "unnest([count(l_extendedprice)::double, avg(l_extendedprice), stddev_samp(l_extendedprice), min(l_extendedprice), quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.75), max(l_extendedprice)]) as p from lineitem) "
    "select stat, round(q, 4) as l_quantity, round(p, 4) as l_extendedprice from s"
)
def describe(t):
    return rounded(t.lineitem.describe("l_quantity", "l_extendedprice"), 4, "l_quantity", "l_extendedprice")


@query("select round(quantile_cont(l_extendedprice, 0.9), 4) as l_extendedprice, quantile_cont(l_tax, 0.9) as l_tax from lineitem")
def quantile(t):
    return rounded(t.lineitem.select("l_extendedprice", "l_tax").quantile(0.9), 4, "l_extendedprice")


_PAIRS = ("l_quantity", "l_extendedprice", "l_tax")


def _pair_sql(f: str, d: int) -> str:
    return " union all ".join(f"select '{a}' as \"column\", " + ", ".join(f"round({f}({a}, {b}), {d}) as {b}" for b in _PAIRS) + " from lineitem" for a in _PAIRS)


@query(_pair_sql("corr", 8))
def corr(t):
    return rounded(t.lineitem.corr(*_PAIRS), 8, *_PAIRS)


@query(_pair_sql("covar_samp", 3))
def cov(t):
    return rounded(t.lineitem.cov(*_PAIRS), 3, *_PAIRS)


@query("select count(distinct user_id) as user_id, count(distinct event_type) as event_type from events")
def nunique(t):
    return t.events.select("user_id", "event_type").nunique()


@query("select event_type, count(*) as count from events group by 1")
def value_counts(t):
    return t.events.col("event_type").value_counts()


@query("select event_type, count(*) / (select count(*) from events)::double as proportion from events group by 1")
def value_counts_normalize(t):
    return t.events.col("event_type").value_counts(normalize=True)


@query("select c_mktsegment, c_nationkey, count(*) as count from customer group by all")
def value_counts_frame(t):
    return t.customer.value_counts("c_mktsegment", "c_nationkey")


@query("with u as (select user_id, min(event_id) as e from events group by 1) select user_id, row_number() over (order by e) - 1 as at from u")
def unique_first_seen(t):
    f = t.events.col("user_id").unique()
    return Frame(f.positioned().withColumnRenamed("__pos", "at"), f.order).select("user_id", "at")


@query("select o_orderstatus, count(*) as count from orders group by 1")
def corpus_value_counts(t):
    return t.orders.col("o_orderstatus").value_counts()


# --- groups -------------------------------------------------------------------------------------------------


def _group_query(name: str, how: str, expression: str, digits: int | None):
    shown = f"round({expression}, {digits})" if digits is not None else expression

    @query(f"select l_returnflag, l_linestatus, {shown} as l_extendedprice from lineitem group by 1, 2", name)
    def run(t):
        f = getattr(t.lineitem.groupby("l_returnflag", "l_linestatus"), how)("l_extendedprice")
        return rounded(f, digits, "l_extendedprice") if digits is not None else f


for _name, _how, _sql, _digits in (
    ("gb_sum", "sum", "sum(l_extendedprice)", 2), ("gb_mean", "mean", "avg(l_extendedprice)", 4), ("gb_median", "median", "median(l_extendedprice)", 4), ("gb_min", "min", "min(l_extendedprice)", None),
    ("gb_max", "max", "max(l_extendedprice)", None), ("gb_var", "var", "var_samp(l_extendedprice)", 0), ("gb_std", "std", "stddev_samp(l_extendedprice)", 4), ("gb_count", "count", "count(l_extendedprice)", None),
):
    _group_query(_name, _how, _sql, _digits)


@query("select o_orderpriority, count(*) as size from orders group by 1")
def gb_size(t):
    return t.orders.groupby("o_orderpriority").size()


@query("select l_returnflag, count(distinct l_suppkey) as l_suppkey, count(distinct l_partkey) as l_partkey from lineitem group by 1")
def gb_nunique(t):
    return t.lineitem.groupby("l_returnflag").nunique("l_suppkey", "l_partkey")


@query("select user_id, arg_min(v, event_id) filter (v is not null) as v from (select *, case when event_type = 'click' then value end as v from events) group by 1")
def gb_first(t):
    return t.events.assign_expr("v", where(col("event_type") == "click", col("value"), None)).groupby("user_id").first("v")


@query("select user_id, arg_max(v, event_id) filter (v is not null) as v from (select *, case when event_type = 'click' then value end as v from events) group by 1")
def gb_last(t):
    return t.events.assign_expr("v", where(col("event_type") == "click", col("value"), None)).groupby("user_id").last("v")


@query("select l_shipdate, round(avg(l_extendedprice) + 1e-9, 4) as l_extendedprice_mean, sum(l_quantity) as l_quantity_sum from lineitem group by 1")
def gb_agg(t):
    f = t.lineitem.groupby("l_shipdate").agg({"l_quantity": "sum", "l_extendedprice": "mean"})
    return rounded(f.assign_expr("l_extendedprice_mean", col("l_extendedprice_mean") + 1e-9), 4, "l_extendedprice_mean")


@query("select l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) as l_extendedprice_sum, round(avg(l_extendedprice), 4) as l_extendedprice_mean, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, count(l_quantity) as l_quantity_count from lineitem where l_quantity > 10 and l_returnflag in ('A', 'R') group by 1, 2")
def gb_agglist(t):
    f = t.lineitem.query("l_quantity > 10 and l_returnflag in ['A', 'R']").groupby("l_returnflag", "l_linestatus")
    return rounded(rounded_frame(f.agg_list({"l_extendedprice": ["sum", "mean"], "l_quantity": ["min", "max", "count"]}), 2, "l_extendedprice_sum"), 4, "l_extendedprice_mean")


def rounded_frame(f: Frame, digits: int, *names: str) -> Frame:
    return f._put({n: F.round(F.col(n), digits) for n in names})


@query("select l_suppkey, l_returnflag, sum(l_quantity) as l_quantity from lineitem group by 1, 2")
def gb_multikey(t):
    return t.lineitem.groupby("l_suppkey", "l_returnflag").sum("l_quantity")


@query("select nullif(event_type, 'click') as event_type, count(*) as size from events group by 1")
def gb_dropna_false(t):
    return gapped(t.events, event_type="'click'").groupby("event_type", dropna=False).size()


@query("select nullif(event_type, 'click') as event_type, round(sum(value), 4) as value from events where event_type <> 'click' group by 1")
def gb_dropna_true(t):
    return rounded(gapped(t.events, event_type="'click'").groupby("event_type").sum("value"), 4, "value")


@query("with g as (select event_type, count(*) as size, min(event_id) as e from events group by 1) select event_type, size, row_number() over (order by e) - 1 as at from g")
def gb_unsorted(t):
    f = t.events.groupby("event_type", sort=False).size()
    return Frame(f.positioned().withColumnRenamed("__pos", "at"), f.order)


@query("select event_id, round(avg(value) over (partition by user_id), 6) as value from events")
def gb_transform(t):
    s = t.events.groupby("user_id").transform("value", "mean")
    return rounded(s.frame.select("event_id", "value"), 6, "value")


@query("select event_id, event_type, case when event_type <> 'click' then count(*) over (partition by event_type) end as size from events")
def gb_transform_missing_key(t):
    f = gapped(t.events._put({"k": F.col("event_type")}), k="'click'")
    return f.groupby("k").transform("", "size").frame.select("event_id", "event_type", "size")


@query("select event_id, user_id from events qualify count(*) over (partition by user_id) > 65")
def gb_filter_size(t):
    return t.events.groupby("user_id").filter(group_size() > 65).select("event_id", "user_id")


@query("select event_id, user_id from events qualify count(nullif(event_type, 'click')) over (partition by user_id) <= 50")
def gb_filter_count(t):
    f = gapped(t.events._put({"k": F.col("event_type")}), k="'click'")
    return f.groupby("user_id").filter(group_count("k") <= 50).select("event_id", "user_id")


@query("select event_type, max(value) - min(value) as spread from events group by 1")
def gb_apply(t):
    import pandas as pd

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": g["event_type"].iloc[:1], "spread": [g["value"].max() - g["value"].min()]})

    return t.events.select("event_type", "value").groupby("event_type").apply(spread, "event_type string, spread double")


# --- joins --------------------------------------------------------------------------------------------------


def _sides(t) -> tuple[Frame, Frame]:
    """Customers and orders; the customers' keys are moved on by ten, so that some keys of each side have no partner."""
    a = t.customer.assign_expr("k", col("c_custkey") + 10).select("k", "c_name")
    b = t.orders.select("o_custkey", "o_totalprice").rename({"o_custkey": "k"})
    return a, b


_A = "(select c_custkey + 10 as k, c_name from customer)"
_B = "(select o_custkey as k, o_totalprice from orders)"


@query(f"select k, c_name, o_totalprice from {_A} a join {_B} b using (k)")
def merge_inner(t):
    return merge(*_sides(t), on="k")


@query(f"select k, c_name, o_totalprice from {_A} a left join {_B} b using (k)")
def merge_left(t):
    return merge(*_sides(t), on="k", how="left")


@query(f"select k, c_name, o_totalprice from {_A} a right join {_B} b using (k)")
def merge_right(t):
    return merge(*_sides(t), on="k", how="right")


@query(f"select k, c_name, o_totalprice from {_A} a full join {_B} b using (k)")
def merge_outer(t):
    return merge(*_sides(t), on="k", how="outer")


@query(f"select k, c_name, o_totalprice, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as _merge from {_A} a full join {_B} b using (k)")
def merge_indicator(t):
    return merge(*_sides(t), on="k", how="outer", indicator=True)


@query("select r.r_name, n.n_name from region r, nation n")
def merge_cross(t):
    return merge(t.region.select("r_name"), t.nation.select("n_name"), how="cross")


@query("select c_custkey, c_nationkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def merge_lefton_righton(t):
    return merge(t.customer.select("c_custkey", "c_nationkey"), t.nation.select("n_nationkey", "n_name"), left_on="c_nationkey", right_on="n_nationkey", how="left", validate="many_to_one")


@query("select n, a.v as v_x, b.v as v_y from (select c_nationkey as n, c_acctbal as v from customer) a join (select s_nationkey as n, s_acctbal as v from supplier) b using (n)")
def merge_suffixes(t):
    a = t.customer.select("c_nationkey", "c_acctbal").rename({"c_nationkey": "n", "c_acctbal": "v"})
    b = t.supplier.select("s_nationkey", "s_acctbal").rename({"s_nationkey": "n", "s_acctbal": "v"})
    return merge(a, b, on="n")


@query("select a.s, a.o, b.c from (select o_orderkey as o, nullif(o_orderstatus, 'F') as s from orders) a left join (select nullif(o_orderstatus, 'F') as s, count(*) as c from orders group by 1) b on a.s = b.s")
def merge_na_keys(t):
    f = gapped(t.orders, o_orderstatus="'F'").select("o_orderkey", "o_orderstatus").rename({"o_orderkey": "o", "o_orderstatus": "s"})
    g = f.groupby("s", dropna=False).size().rename({"size": "c"})
    return merge(f, g, on="s", how="left").select("s", "o", "c")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem a join (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 40) b using (l_orderkey, l_linenumber) group by 1, 2")
def merge_multikey(t):
    f = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    g = f.query("l_quantity > 40").groupby("l_orderkey", "l_linenumber").size().select("l_orderkey", "l_linenumber")
    return merge(f, g, on=["l_orderkey", "l_linenumber"]).groupby("l_orderkey", "l_linenumber").size().rename({"size": "n"})


@query("select n_nationkey::varchar as n_nationkey, n_name, s_n from nation left join (select s_nationkey, count(*) as s_n from supplier where s_acctbal > 0 group by 1) on n_nationkey = s_nationkey")
def join_index(t):
    a = t.nation.set_index("n_nationkey").select("n_name")
    b = t.supplier.query("s_acctbal > 0").groupby("s_nationkey").size().rename({"size": "s_n"}).set_index("s_nationkey")
    return join(a, b)


@query("select c_custkey, c_nationkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def join_on_column(t):
    return join(t.customer.select("c_custkey", "c_nationkey"), t.nation.set_index("n_nationkey").select("n_name"), on="c_nationkey")


@query("select s_suppkey as k, s_name, null as c_name from supplier union all select c_custkey, null, c_name from customer")
def concat_outer(t):
    return concat([t.supplier.select("s_suppkey", "s_name").rename({"s_suppkey": "k"}), None, t.customer.select("c_custkey", "c_name").rename({"c_custkey": "k"})])


@query("select s_suppkey as k from supplier union all select c_custkey from customer")
def concat_inner(t):
    return concat([t.supplier.select("s_suppkey", "s_name").rename({"s_suppkey": "k"}), t.customer.select("c_custkey", "c_name").rename({"c_custkey": "k"})], join="inner")


@query("select s_nationkey::double as v from supplier union all select c_acctbal from customer")
def concat_promote(t):
    return concat([t.supplier.select("s_nationkey").rename({"s_nationkey": "v"}), t.customer.select("c_acctbal").rename({"c_acctbal": "v"})])


@query("select a.n_name, a.n_nationkey, b.n_name as n_name_1 from (select *, row_number() over (order by n_nationkey) as p from nation) a join (select *, row_number() over (order by n_nationkey desc) as p from nation) b using (p)")
def concat_axis1(t):
    f = t.nation.select("n_name", "n_nationkey")
    return concat([f, f.sort_values("n_nationkey", False).select("n_name")], axis=1)


# --- windows ------------------------------------------------------------------------------------------------

_W = "rows between 4 preceding and current row"
_ROLL = {"sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_samp(value)", "var": "var_samp(value)", "median": "median(value)", "count": "count(value)::double"}


def _values(t) -> Frame:
    return t.events.select("event_id", "value")


def _with_id(f: Frame, made: Frame, digits: int = 6) -> DataFrame:
    """The result beside the events' ids: both are in id order."""
    out = f.select("event_id").assign("value", made.col("value"))
    return rounded(out, digits, "value")


def _rolling(how: str):
    expression = _ROLL[how]

    @query(f"select event_id, case when count(value) over (order by event_id {_W}) >= 5 then round({expression.replace('(value)', f'(value) over (order by event_id {_W})')}, 6) end as value from events", f"rolling_{how}")
    def run(t):
        f = _values(t)
        return _with_id(f, f.select("value").col("value").rolling(5).agg(how))


for _how in _ROLL:
    _rolling(_how)


@query("select event_id, case when count(value) over w >= 5 then round(avg(value) over w, 6) end as value from events window w as (order by event_id rows between 2 preceding and 2 following)")
def rolling_center(t):
    f = _values(t)
    return _with_id(f, f.col("value").rolling(5, center=True).mean())


@query("select event_id, case when count(v) over w >= 2 then round(sum(v) over w, 6) end as value from (select event_id, case when event_type <> 'click' then value end as v from events) window w as (order by event_id rows between 3 preceding and current row)")
def rolling_minperiods(t):
    f = t.events.assign_expr("value", where(col("event_type") != "click", col("value"), None)).select("event_id", "value")
    return _with_id(f, f.col("value").rolling(4, min_periods=2).sum())


_EXPANDING = {"sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_samp(value)", "var": "var_samp(value)", "count": "count(value)::double"}


def _expanding(how: str):
    over = _EXPANDING[how].replace("(value)", "(value) over (order by event_id rows between unbounded preceding and current row)")

    @query(f"select event_id, round({over} + 1e-9, 4) as value from events", f"expanding_{how}")
    def run(t):
        f = _values(t)
        return _with_id(f, f.col("value").expanding().agg(how).assign_expr("value", col("value") + 1e-9), 4)


for _how in _EXPANDING:
    _expanding(_how)


@query("select s_suppkey, round(median(s_acctbal) over (order by s_suppkey rows between unbounded preceding and current row), 6) as value from supplier")
def expanding_median(t):
    f = t.supplier.select("s_suppkey", "s_acctbal")
    return rounded(f.select("s_suppkey").assign("value", f.col("s_acctbal").expanding().median().col("s_acctbal")), 6, "value")


def _row_query(name: str, expression: str, make: Callable[[Series], Series], digits: int = 6):
    @query(f"select event_id, round({expression}, {digits}) as value from events", name)
    def run(t):
        f = _values(t)
        s = make(f.col("value"))
        return _with_id(f, s.to_frame(), digits)


_RUN = "over (order by event_id rows between unbounded preceding and current row)"
_row_query("shift", "lag(value, 2) over (order by event_id)", lambda s: s.shift(2))
_row_query("shift_back", "lead(value, 1) over (order by event_id)", lambda s: s.shift(-1))
_row_query("diff", "value - lag(value) over (order by event_id)", lambda s: s.diff())
_row_query("pct_change", "value / lag(value) over (order by event_id) - 1", lambda s: s.pct_change())
_row_query("cumsum", f"sum(value) {_RUN}", lambda s: s.cumsum(), 4)
_row_query("cummin", f"min(value) {_RUN}", lambda s: s.cummin())
_row_query("cummax", f"max(value) {_RUN}", lambda s: s.cummax())
_row_query("rank_average", "rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double", lambda s: s.rank("average"))
_row_query("rank_min", "(rank() over (order by value))::double", lambda s: s.rank("min"))
_row_query("rank_max", "(rank() over (order by value) + count(*) over (partition by value) - 1)::double", lambda s: s.rank("max"))
_row_query("rank_first", "(row_number() over (order by value, event_id))::double", lambda s: s.rank("first"))
_row_query("rank_dense", "(dense_rank() over (order by value desc))::double", lambda s: s.rank("dense", ascending=False))


@query("select event_id, round(product(1 + value / 1000000) over (order by event_id rows between unbounded preceding and current row), 6) as value from events")
def cumprod(t):
    f = t.events.assign_expr("value", 1 + col("value") / 1_000_000).select("event_id", "value")
    return _with_id(f, f.col("value").cumprod().to_frame())


# --- order --------------------------------------------------------------------------------------------------


@query("select o_orderkey, row_number() over (order by nullif(o_orderstatus, 'F') desc nulls last, o_totalprice nulls last, o_orderkey) - 1 as at from orders")
def sort_multi_na_last(t):
    f = gapped(t.orders, o_orderstatus="'F'").sort_values(["o_orderstatus", "o_totalprice"], [False, True])
    return Frame(f.positioned().withColumnRenamed("__pos", "at"), f.order).select("o_orderkey", "at")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_topk(t):
    return t.orders.sort_values("o_totalprice", False).head(25).select("o_orderkey", "o_totalprice")


@query("select row_number() over (order by c_acctbal, c_custkey) - 1 as at, p as position from (select *, row_number() over (order by c_custkey) - 1 as p from customer)")
def argsort(t):
    f = t.customer.col("c_acctbal").argsort()
    return Frame(f.positioned().withColumnRenamed("__pos", "at"), f.order).select("at", "position")


@query("select c_name, c_custkey, row_number() over (order by c_name desc) - 1 as at from customer")
def sort_index(t):
    f = t.customer.set_index("c_name").sort_index(ascending=False)
    return Frame(f.positioned().withColumnRenamed("__pos", "at"), f.order, f.index).select("c_custkey", "at")


# --- reshaping ----------------------------------------------------------------------------------------------


@query("select p_partkey, 'p_size' as variable, p_size::double as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def melt_columns(t):
    return melt(t.part, ["p_partkey"], ["p_size", "p_retailprice"])


@query("with g as (select l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by 1, 2) select l_returnflag, max(q) filter (l_linestatus = 'F') as \"F\", max(q) filter (l_linestatus = 'O') as \"O\" from g group by 1")
def pivot_cells(t):
    return pivot(t.lineitem.groupby("l_returnflag", "l_linestatus").sum("l_quantity"), "l_returnflag", "l_linestatus", "l_quantity")


@query("select c_nationkey, round(avg(c_acctbal) filter (c_mktsegment = 'BUILDING'), 4) as \"BUILDING\", round(avg(c_acctbal) filter (c_mktsegment = 'MACHINERY'), 4) as \"MACHINERY\" from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1")
def pivot_table_mean(t):
    return rounded(pivot_table(t.customer.query("c_mktsegment in ['BUILDING', 'MACHINERY']"), ["c_nationkey"], ["c_mktsegment"], ["c_acctbal"]), 4, "BUILDING", "MACHINERY")


@query(
    "select l_returnflag, " + ", ".join(f"coalesce(round({f}({v}) filter (l_linestatus = '{s}'), 2), 0.0) as {v}_{h}_{s}" for v in ("l_quantity", "l_tax") for h, f in (("sum", "sum"), ("max", "max")) for s in "FO") + " from lineitem group by 1"
)
def pivot_table_multi(t):
    f = pivot_table(t.lineitem, ["l_returnflag"], ["l_linestatus"], ["l_quantity", "l_tax"], ["sum", "max"], fill=0.0)
    return rounded(f, 2, *f.columns)


@query("select p_partkey, \"column\", value from (select p_partkey, p_size::double as p_size, p_retailprice from part) unpivot include nulls (value for \"column\" in (p_size, p_retailprice))")
def stack_cells(t):
    f = t.part.select("p_partkey", "p_size", "p_retailprice")
    return stack(Frame(f.df, f.order, ["p_partkey"]))


@query("select c_nationkey, " + ", ".join(f"round(sum(c_acctbal) filter (c_mktsegment = '{s}'), 2) as \"{s}\"" for s in ("BUILDING", "MACHINERY")) + " from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1")
def unstack_level(t):
    g = t.customer.query("c_mktsegment in ['BUILDING', 'MACHINERY']").groupby("c_nationkey", "c_mktsegment", as_index=True).sum("c_acctbal")
    return rounded(unstack(g), 2, "BUILDING", "MACHINERY")


# --- time ---------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_orderdate as d from orders")
def to_datetime_fmt(t):
    f = t.orders._put({"s": F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss")})
    return f._put({"d": datetimes.to_datetime(F.col("s"), f.schema["s"].dataType, "%d.%m.%Y %H:%M:%S")}).select("o_orderkey", "d")


@query("select o_orderkey, case when o_orderkey % 5 > 0 then date_trunc('day', o_orderdate)::timestamp end as d from orders")
def to_datetime_coerce(t):
    f = t.orders._put({"s": F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("no day")})
    return f._put({"d": datetimes.to_datetime(F.col("s"), f.schema["s"].dataType, errors="coerce")}).select("o_orderkey", "d")


#: A date in turn day first, month first, with slashes, with a clock, with a zone, and in forms that aren't read.
_MIXED = ("dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "dd-MM-yyyy", "yyyy-MM-dd HH:mm")


@query(
    "select o_orderkey, case o_orderkey % 7 when 1 then case when day(o_orderdate) > 12 then d else make_date(year(d), day(d), month(d)) end "
    "when 3 then o_orderdate when 4 then o_orderdate - interval 2 hour when 5 then null when 6 then null else d end::timestamp as d "
    "from (select *, date_trunc('day', o_orderdate)::date as d from orders)"
)
def to_datetime_mixed(t):
    turn = F.col("o_orderkey") % len(_MIXED)
    f = t.orders._put({"s": F.coalesce(*[F.when(turn == i, F.date_format("o_orderdate", x)) for i, x in enumerate(_MIXED)])})
    return f._put({"d": datetimes.to_datetime(F.col("s"), f.schema["s"].dataType, errors="coerce")}).select("o_orderkey", "d")


@query("select event_id, make_timestamp(event_id * 1000000) as d from events")
def to_datetime_unit(t):
    f = t.events
    return f._put({"d": datetimes.to_datetime(F.col("event_id"), f.schema["event_id"].dataType, unit="s")}).select("event_id", "d")


_FREQ = {"h": ("H", "date_trunc('hour', ts)"), "d": ("D", "date_trunc('day', ts)"), "w": ("W", "date_trunc('week', ts)"), "ms": ("MS", "date_trunc('month', ts)"), "me": ("ME", "last_day(ts)")}
_HOW = {"sum": "round(sum(value), 4)", "mean": "round(avg(value), 6)", "count": "count(value)", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)"}


def _resample(key: str, how: str):
    freq, start = _FREQ[key]

    @query(f"select {start}::timestamp as ts, {_HOW[how]} as value from events group by 1", f"resample_{key}_{how}")
    def run(t):
        f = t.events.set_index("ts").select("value")
        out = getattr(resample(f, freq), how)()
        return rounded(out, 4 if how == "sum" else 6, "value") if how in ("sum", "mean") else out


for _key in _FREQ:
    for _how in _HOW:
        _resample(_key, _how)


# --- text and time accessors --------------------------------------------------------------------------------


def _text_query(name: str, expression: str, make: Callable[[Series], Series], kind: str | None = None):
    @query(f"select p_partkey, {expression} as v from part", name)
    def run(t):
        f = t.part
        s = make(f.col("p_name"))
        return f.assign("v", s).select("p_partkey", "v")


_text_query("str_contains", "contains(p_name, '1')", lambda s: s.str.contains("1"))
_text_query("str_startswith", "starts_with(p_name, 'p')", lambda s: s.str.startswith("p"))
_text_query("str_endswith", "ends_with(p_name, '7')", lambda s: s.str.endswith("7"))
_text_query("str_match", "regexp_matches(p_name, '^(?:[a-z]+.*[13579])')", lambda s: s.str.match("[a-z]+.*[13579]"))
_text_query("str_contains_regex", "regexp_matches(p_name, '[02468]$')", lambda s: s.str.contains_regex("[02468]$"))
_text_query("str_replace", "replace(p_name, '1', 'one')", lambda s: s.str.replace("1", "one"))
_text_query("str_regex", "regexp_replace(p_name, '[0-9]+', '#', 'g')", lambda s: s.str.replace_regex("[0-9]+", "#"))
_text_query("str_strip", "trim(p_name)", lambda s: s._new(F.concat(F.lit(" \t"), s.column, F.lit("  "))).str.strip())
_text_query("str_split", "string_split(p_name, '#')", lambda s: s.str.split("#"))
_text_query("str_get", "p_name[2]", lambda s: s.str.get(1))
_text_query("str_slice", "p_name[2:4]", lambda s: s.str.slice(1, 4))
_text_query("str_slice_negative", "right(p_name, 3)", lambda s: s.str.slice(-3))
_text_query("str_len", "strlen(p_name)", lambda s: s.str.len())
_text_query("str_upper", "upper(p_name)", lambda s: s.str.upper())
_text_query("str_lower", "lower(p_name)", lambda s: s.str.lower())


@query("select doc_id, strlen(text) as n, lower(lang) as l from documents")
def str_bytes(t):
    f = t.documents
    return f.assign("n", f.col("text").str.len()).assign_expr("l", _lower("lang")).select("doc_id", "n", "l")


def _lower(name: str):
    from loomframe.expr import lower

    return lower(col(name))


_PARTS = {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "weekday": "isodow(ts) - 1", "dayofyear": "dayofyear(ts)", "quarter": "quarter(ts)"}


@query("select event_id, " + ", ".join(f"({e})::bigint as {n}" for n, e in _PARTS.items()) + ", date_trunc('day', ts)::timestamp as date, strftime(ts, '%H:%M:%S') as time from events")
def dt_parts(t):
    f = t.events
    dt = f.col("ts").dt
    df = f.df.select("event_id", *[getattr(dt, n)().column.alias(n) for n in (*_PARTS, "date", "time")])
    return df


@query("select o_orderkey, day(d) = 1 as is_month_start, d::date = last_day(d) as is_month_end, day(d) = 1 and month(d) = 1 as is_year_start, day(d) = 31 and month(d) = 12 as is_year_end from (select o_orderkey, o_orderdate as d from orders)")
def dt_flags(t):
    f = t.orders
    dt = f.col("o_orderdate").dt
    return f.df.select("o_orderkey", *[getattr(dt, n)().column.alias(n) for n in ("is_month_start", "is_month_end", "is_year_start", "is_year_end")])


# --- categories ---------------------------------------------------------------------------------------------

_SEGMENTS = ["MACHINERY", "BUILDING", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE"]
_LIST = "[" + ", ".join(f"'{s}'" for s in _SEGMENTS) + "]"


def _segments(t, ordered: bool = True) -> Frame:
    from loomframe.functions import categorical

    return categorical.make(t.customer, "c_mktsegment", _SEGMENTS, ordered)


@query("select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as code from orders")
def cat_codes(t):
    f = t.orders.astype({"o_orderpriority": "category"})
    return f.assign("code", f.col("o_orderpriority").cat.codes()).select("o_orderkey", "code")


@query(f"select c_custkey, list_position({_LIST}, c_mktsegment) >= 3 as high from customer")
def cat_ordered_cmp(t):
    f = _segments(t)
    return f.assign("high", f.col("c_mktsegment").cat.compare(">=", "HOUSEHOLD")).select("c_custkey", "high")


@query(f"select c_custkey from customer where list_position({_LIST}, c_mktsegment) < 3")
def cat_expr_cmp(t):
    return _segments(t).where(col("c_mktsegment") < "HOUSEHOLD").select("c_custkey")


@query("select s as c_mktsegment, count(c_custkey) as count from (select unnest(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'AUTOMOBILE', 'FURNITURE', 'NONE']) as s) left join customer on s = c_mktsegment group by 1")
def cat_value_counts(t):
    return _segments(t).col("c_mktsegment").cat.add(["NONE"]).value_counts()


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment end as s from customer")
def cat_set_categories(t):
    f = _segments(t)
    s = f.col("c_mktsegment").cat.set(["BUILDING", "MACHINERY"])
    return concat([f.select("c_custkey"), s.to_frame("s")], axis=1)


@query("select replace(c_mktsegment, 'BUILDING', 'HOUSE') as c_mktsegment, count(*) as size from customer group by 1")
def cat_rename(t):
    return _segments(t).col("c_mktsegment").cat.rename({"BUILDING": "HOUSE"}).to_frame().groupby("c_mktsegment").size()


@query(f"select c_custkey, row_number() over (order by list_position({_LIST}, c_mktsegment), c_custkey) - 1 as at from customer")
def cat_sort(t):
    f = _segments(t).sort_values("c_mktsegment")
    return Frame(f.positioned().withColumnRenamed("__pos", "at"), f.order).select("c_custkey", "at")


# --- labels of several levels -------------------------------------------------------------------------------


def _places(t) -> Frame:
    f = merge(t.nation.rename({"n_regionkey": "r_regionkey"}), t.region, on="r_regionkey").select("r_name", "n_name", "n_nationkey")
    return f.set_index("r_name", "n_name")


_PLACES = "(select r_name, n_name, n_nationkey from nation join region on n_regionkey = r_regionkey)"


@query(f"select * from {_PLACES} where (r_name, n_name) in (select min(r_name), min(n_name) from {_PLACES} where r_name = (select min(r_name) from region))")
def mi_tuple(t):
    first = sorted(labels.tuples(_places(t)))[0]
    return _places(t).loc_tuple(*first)


@query(f"select * from {_PLACES} where r_name = 'ASIA'")
def mi_prefix(t):
    return _places(t).loc_tuple("ASIA")


@query(f"select n_name, n_nationkey from {_PLACES} where r_name = 'EUROPE'")
def mi_xs(t):
    return _places(t).xs("EUROPE", "r_name")


@query(f"select n_name, n_nationkey from {_PLACES}")
def mi_droplevel(t):
    return _places(t).drop_level("r_name")


@query(f"select n_name, r_name, n_nationkey from {_PLACES}")
def mi_swaplevel(t):
    return _places(t).swap_level()


@query(f"select * from {_PLACES}")
def mi_reset(t):
    return _places(t).reset_index()


@query(f"select dense_rank() over (order by r_name) - 1 as r_name, dense_rank() over (order by n_name) - 1 as n_name from {_PLACES}")
def mi_codes(t):
    return labels.codes(_places(t))


@query("select c_nationkey as k from customer union select s_nationkey + 6 from supplier")
def index_union(t):
    return labels.union(*_keys(t))


@query("select c_nationkey as k from customer intersect select s_nationkey + 6 from supplier")
def index_intersection(t):
    return labels.intersection(*_keys(t))


@query("select c_nationkey as k from customer except select s_nationkey + 6 from supplier")
def index_difference(t):
    return labels.difference(*_keys(t))


def _keys(t) -> tuple[Frame, Frame]:
    a = t.customer._put({"k": F.col("c_nationkey")}).select("k")
    b = t.supplier._put({"k": (F.col("s_nationkey") + 6).cast("long")}).select("k")
    return Frame(a.df, a.order, ["k"]), Frame(b.df, b.order, ["k"])


# --- arrays -------------------------------------------------------------------------------------------------

_E = "embedding::double[]"


@query(f"select vec_id, list_transform({_E}, lambda x: round(x * 2 + 1, 9)) as e from embeddings")
def nd_elementwise(t):
    e = F.col("embedding")
    return t.raw("embeddings").select("vec_id", V.each(V.each(e, lambda x: x * 2 + 1), lambda x: F.round(x, 9)).alias("e"))


@query(f"select vec_id, round(list_sum({_E}), 6) as total, round(list_avg({_E}), 8) as mean, list_min({_E}) as low, list_max({_E}) as high, round(list_stddev_pop({_E}), 8) as std from embeddings")
def nd_reduce_axis1(t):
    e = F.col("embedding")
    return t.raw("embeddings").select("vec_id", F.round(V.total(e), 6).alias("total"), F.round(V.mean(e), 8).alias("mean"), V.low(e).alias("low"), V.high(e).alias("high"), F.round(V.std(e), 8).alias("std"))


@query(f"select j::int as j, round(avg(x), 8) as v from (select unnest({_E}) as x, generate_subscripts(embedding, 1) - 1 as j from embeddings) group by 1")
def nd_reduce_axis0(t):
    return V.columns_mean(t.raw("embeddings"), "embedding").withColumn("v", F.round("v", 8))


@query(f"select vec_id, round(list_var_samp({_E}), 8) as v from embeddings")
def nd_var_ddof(t):
    return t.raw("embeddings").select("vec_id", F.round(V.var(F.col("embedding"), 1), 8).alias("v"))


@query(f"select vec_id, (list_position({_E}, list_max({_E})) - 1)::bigint as hi, (list_position({_E}, list_min({_E})) - 1)::bigint as lo from embeddings")
def nd_argmax(t):
    return t.raw("embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("hi"), V.argmin(F.col("embedding")).alias("lo"))


@query("select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as v from embeddings a, (select embedding from embeddings order by vec_id limit 1) b")
def nd_dot(t):
    first = t.raw("embeddings").orderBy("vec_id").first()["embedding"]
    return t.raw("embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), F.array(*map(F.lit, first))), 6).alias("v"))


@query(f"with e as (select vec_id, unnest({_E}) as x, generate_subscripts(embedding, 1) - 1 as j from embeddings) select a.j::int as i, b.j::int as j, round(sum(a.x * b.x), 5) as v from e a join e b using (vec_id) group by 1, 2")
def nd_gram(t):
    return V.gram(t.raw("embeddings"), "embedding", 64).withColumn("v", F.round("v", 5))


def _matrix(t) -> NDArray:
    return NDArray.from_vectors(t.raw("embeddings"), "vec_id", "embedding", 64)


_M = f"(select (row_number() over (order by vec_id) - 1) as r, {_E} as e from embeddings)"
_ROWS = "(select count(*) from embeddings)"


@query(f"with m as (select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M}) select (a.j * 64 + b.j)::bigint as i, round(sum(a.x * b.x), 6) as v from m a join m b using (r) group by a.j, b.j")
def nd_matmul(t):
    m = _matrix(t)
    return m.T.matmul(m).df.withColumn("v", F.round("v", 6))


@query(f"with m as (select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M}), a as (select j, avg(x) as mean from m group by 1) select (r * 64 + j)::bigint as i, round(x - mean, 8) as v from m join a using (j)")
def nd_broadcast(t):
    m = _matrix(t)
    return m.sub(m.reduce("mean", axis=0)).df.withColumn("v", F.round("v", 8))


@query(f"with m as (select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M}) select (j * {_ROWS} + r)::bigint as i, x as v from m")
def nd_transpose(t):
    return _matrix(t).T.df


@query(f"with m as (select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M}) select (r / 2 * 8 + (j - 8) / 4)::bigint as i, x as v from (select *, r from m where r % 2 = 0 and j >= 8 and j < 40 and (j - 8) % 4 = 0)".replace("r / 2", "r // 2").replace("(j - 8) / 4", "(j - 8) // 4"))
def nd_slice(t):
    return _matrix(t).slice(slice(None, None, 2), slice(8, 40, 4)).df


@query(f"with m as (select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M}) select r::bigint as i, round(stddev_samp(x), 8) as v from m group by 1")
def nd_std_axis(t):
    return _matrix(t).reduce("std", axis=1, ddof=1).df.withColumn("v", F.round("v", 8))


@query(f"with m as (select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M}) select (row_number() over (order by x) - 1)::bigint as i, x as v from (select distinct x from m)")
def nd_unique(t):
    return _matrix(t).unique().df


_CELLS = f"(select r, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from {_M})"


@query(f"select (r * 3 + k)::bigint as i, e[p + 1] as v from {_M}, (values (0, 3), (1, 63), (2, 3)) t(k, p)")
def nd_take(t):
    return _matrix(t).take([3, -1, 3], axis=1).df


@query(f"select (r * 64 + j)::bigint as i, x as v from {_CELLS} union all select ((r + {_ROWS}) * 64 + j)::bigint, x * 2 from {_CELLS}")
def nd_concat(t):
    m = _matrix(t)
    return concatenate([m, m * 2.0], 0).df


@query(f"select (r * 64 + j)::bigint as i, case when x > 0 then x else 0.5 end as v from {_CELLS}")
def nd_where(t):
    m = _matrix(t)
    return nd_pick(m.gt(0.0), m, 0.5).df


@query(f"select (r * 64 + j)::bigint as i, x <= 0.05 as v from {_CELLS}")
def nd_compare(t):
    return _matrix(t).le(0.05).df


@query(f"select (r * 64 + row_number() over (partition by r order by x) - 1)::bigint as i, x as v from {_CELLS}")
def nd_sort(t):
    return _matrix(t).sort().df


@query(f"select (r * 64 + j)::bigint as i, floor(x * 10)::bigint in (0, 2) as v from {_CELLS}")
def nd_isin(t):
    return _matrix(t).mul(10.0).ufunc("floor").isin([0, 2]).df


@query(f"select r::bigint as i, arg_max(j, (x, -j))::bigint as v from {_CELLS} group by r")
def nd_arg_axis(t):
    return _matrix(t).arg("max", 1).df


@query(f"select (r * 64 + row_number() over (partition by r order by x, j) - 1)::bigint as i, j::bigint as v from {_CELLS}")
def nd_argsort(t):
    return _matrix(t).argsort().df


@query(f"select (r * 64 + j)::bigint as i, (" + " + ".join(f"(x > {g / 4})::bigint" for g in range(-4, 4)) + f")::bigint as v from {_CELLS}")
def nd_searchsorted(t):
    return NDArray.arange(t.spark, -1.0, 1.0, 0.25).searchsorted(_matrix(t)).df


@query(f"select (r * 64 + j)::bigint as i, round(ln(abs(x) + 1), 9) as v from {_CELLS}")
def nd_ufunc(t):
    return _matrix(t).ufunc("abs").add(1.0).ufunc("log").df.withColumn("v", F.round("v", 9))


@query(f"select (r * 64 + j)::bigint as i, greatest(least(x, 0.1), -0.1) as v from {_CELLS}")
def nd_maximum(t):
    return _matrix(t).minimum(0.1).maximum(-0.1).df


# --- files --------------------------------------------------------------------------------------------------


def _folder(t, name: str) -> str:
    """A new folder that executors can write to: the shared one where the session names one."""
    import uuid

    where = t.spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="loomframe-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def io_csv_roundtrip(t):
    from loomframe.sources import read_csv, write_csv

    write_csv(t.nation, path := _folder(t, "csv"))
    return read_csv(t.spark, path)


@query("select r_regionkey::bigint as r_regionkey, r_name, 'split' as orient from region union all select r_regionkey, r_name, 'records' from region union all select r_regionkey, r_name, 'columns' from region")
def io_json_orients(t):
    from loomframe.sources import read_json, write_json

    parts = []
    for orient in ("split", "records", "columns"):
        write_json(t.region, path := _folder(t, "json"), orient)
        parts.append(read_json(t.spark, path, orient).assign_value("orient", orient))
    return concat(parts)


@query("select s_suppkey, s_name, s_acctbal from supplier")
def io_ndjson_roundtrip(t):
    from loomframe.sources import read_ndjson, write_ndjson

    write_ndjson(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path := _folder(t, "ndjson"))
    return read_ndjson(t.spark, path)


@query("select p_partkey, p_size from part")
def io_parquet_roundtrip(t):
    from loomframe.sources import read_parquet, write_parquet

    write_parquet(t.part.select("p_partkey", "p_size"), path := _folder(t, "parquet"))
    return read_parquet(t.spark, path, "p_partkey")


@query("select event_id, (props->>'k')::bigint as k from events where (props->>'k')::bigint > 50")
def json_prop_filter(t):
    return t.events._put({"k": F.get_json_object("props", "$.k").cast("long")}).query("k > 50").select("event_id", "k")


# --- functions of the user ----------------------------------------------------------------------------------


@query("select n_nationkey, n_name || '!' as n_name from nation")
def udf_series_apply(t):
    f = t.nation
    return f.assign("n_name", f.col("n_name").apply(lambda s: s + "!", "string")).select("n_nationkey", "n_name")


@query("select s_suppkey, s_acctbal * 2 + s_nationkey as result from supplier")
def udf_apply_rows(t):
    f = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey")
    return f.apply(lambda r: r[1] * 2 + r[2], axis=1).frame.select("s_suppkey", "result")


@query("select r_regionkey, upper(r_name) || '.' as r_name from region")
def udf_frame_map(t):
    f = t.region.select("r_name").map(lambda v: v.upper() + ".", "string")
    return t.region.select("r_regionkey").assign("r_name", f.col("r_name"))


# --- series, labels, files and arrays by themselves ---------------------------------------------------------


@query("select o_orderkey, o_totalprice + o_custkey as s, o_totalprice - 1.5 as d, o_custkey * 3 as p, o_totalprice / nullif(o_custkey, 0) as r, o_custkey % 7 as m from orders where o_custkey > 0")
def series_arith(t):
    f = t.orders.query("o_custkey > 0")
    a, b = f.col("o_totalprice"), f.col("o_custkey")
    out = f.assign("s", a.add(b)).assign("d", f.col("o_totalprice").sub(1.5))
    out = out.assign("p", out.col("o_custkey").mul(3)).assign("r", out.col("o_totalprice").div(out.col("o_custkey")))
    return out.assign("m", out.col("o_custkey").mod(7)).select("o_orderkey", "s", "d", "p", "r", "m")


@query("select s_suppkey, round(pow(s_nationkey, 2.0), 6) as p, s_name || '!' as n from supplier")
def series_pow_text(t):
    f = t.supplier
    f = f.assign("p", f.col("s_nationkey").pow(2.0))
    return f.assign("n", f.col("s_name").add("!")).select("s_suppkey", "p", "n")


@query("select o_orderkey, o_totalprice > 200000 as gt, o_orderstatus = 'F' as eq, o_orderstatus <> 'F' as ne, o_custkey <= o_orderkey as le, coalesce(nullif(o_orderstatus, 'P') = 'F', false) as gap from orders")
def series_compare(t):
    f = gapped(t.orders.assign("g", t.orders.col("o_orderstatus")), g="'P'")
    out = f.assign("gt", f.col("o_totalprice").gt(200000))
    for name, make in (("eq", lambda x: x.col("o_orderstatus").eq("F")), ("ne", lambda x: x.col("o_orderstatus").ne("F")), ("le", lambda x: x.col("o_custkey").le(x.col("o_orderkey"))), ("gap", lambda x: x.col("g").eq("F"))):
        out = out.assign(name, make(out))
    return out.select("o_orderkey", "gt", "eq", "ne", "le", "gap")


@query("select p_partkey, p_size between 10 and 20 as b, p_size > 10 and p_size < 20 as n, p_size >= 10 and p_size < 20 as l, p_brand in ('Brand#1', 'Brand#2') as i from part")
def series_between_isin(t):
    f = t.part
    for name, make in (("b", lambda x: x.col("p_size").between(10, 20)), ("n", lambda x: x.col("p_size").between(10, 20, "neither")), ("l", lambda x: x.col("p_size").between(10, 20, "left")), ("i", lambda x: x.col("p_brand").isin(["Brand#1", "Brand#2", None]))):
        f = f.assign(name, make(f))
    return f.select("p_partkey", "b", "n", "l", "i")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0")
def filter_mask(t):
    f = t.customer.query("c_acctbal > 0")
    return f.filter(f.col("c_mktsegment").eq("BUILDING")).select("c_custkey", "c_name")


@query("select n_name as label from nation union all select r_name from region")
def concat_series(t):
    from loomframe.operators.series import concat as concat_all

    return concat_all([t.nation.col("n_name"), t.region.col("r_name")], "label")


@query("select abs(c_acctbal) as a, round(sqrt(abs(c_acctbal)), 8) as s, round(ln(abs(c_acctbal) + 1), 8) as l, round(exp(c_nationkey / 10.0), 8) as e, c_custkey from customer")
def expr_math(t):
    x = col("c_acctbal").abs()
    f = t.customer.assign_expr("a", x).assign_expr("s", x.sqrt()).assign_expr("l", (x + 1).log()).assign_expr("e", (col("c_nationkey") / 10).exp())
    return rounded(f.select("c_custkey", "a", "s", "l", "e"), 8, "s", "l", "e")


@query("select p_partkey, lower(p_brand) as lo, upper(p_name) as up, length(p_name)::bigint as n, p_name || '/' || p_brand as both from part")
def expr_text(t):
    from loomframe.expr import len_, lower, upper

    f = t.part.assign_expr("lo", lower(col("p_brand"))).assign_expr("up", upper(col("p_name"))).assign_expr("n", len_(col("p_name"))).assign_expr("both", col("p_name") + "/" + col("p_brand"))
    return f.to_spark().select("p_partkey", "lo", "up", F.col("n").cast("long").alias("n"), "both")


@query("select p_partkey, p_size * 2 + 1 as odd from part")
def expr_custom(t):
    from pyspark.sql import types as T

    from loomframe.expr.ast import Custom

    return t.part.assign_expr("odd", Custom(lambda schema: F.col("p_size") * 2 + 1, T.IntegerType())).select("p_partkey", "odd")


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def merge_validate(t):
    return merge(t.customer, t.nation, left_on="c_nationkey", right_on="n_nationkey", validate="many_to_one").select("c_custkey", "n_name")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def merge_key_widths(t):
    from pyspark.sql import types as T

    right = t.nation._put({"n_nationkey": F.col("n_nationkey").cast(T.DoubleType())})  # int keys meet float64 keys
    return merge(t.supplier, right, left_on="s_nationkey", right_on="n_nationkey").select("s_suppkey", "n_name")


@query("select a.event_id, b.event_id as other from events a join events b on a.ts = b.ts")
def merge_time_keys(t):
    right = t.events.select("event_id", "ts").rename({"event_id": "other"})
    return merge(t.events.select("event_id", "ts"), right, on="ts").select("event_id", "other")


@query("with s as (select distinct c_mktsegment from customer) select c_custkey, c_mktsegment as seg from customer join s using (c_mktsegment)")
def merge_category_keys(t):
    left = t.customer.select("c_custkey", "c_mktsegment").rename({"c_mktsegment": "seg"}).astype({"seg": "category"})
    right = t.customer.select("c_mktsegment").drop_duplicates().rename({"c_mktsegment": "seg"})
    return merge(left, right, on="seg").to_spark().select("c_custkey", F.col("seg").cast("string").alias("seg"))


@query("select event_id::varchar as event_id, round(avg(value) over w, 6) as value, round(avg(user_id) over w, 6) as user_id from events window w as (order by event_id rows 4 preceding) qualify count(*) over w = 5")
def rolling_frame(t):
    f = t.events.select("event_id", "user_id", "value")
    out = f.set_index("event_id").rolling(5).mean()
    return rounded(out, 6, "value", "user_id").filter("value is not null")


@query("select event_id::varchar as event_id, round(sum(value) over w, 4) as value, sum(user_id) over w ::double as user_id from events window w as (order by event_id rows unbounded preceding)")
def expanding_frame(t):
    out = t.events.select("event_id", "user_id", "value").set_index("event_id").expanding().sum()
    return rounded(out, 4, "value")


@query("select event_id, user_id from events")
def sample_all(t):
    return t.events.sample(len(t.events), seed=3).select("event_id", "user_id")


@query("select s_suppkey, s_name, s_acctbal from supplier where s_suppkey < 40")
def io_csv_options(t):
    from loomframe.sources import read_csv, write_csv

    write_csv(t.supplier, path := _folder(t, "csv"), sep=";", single=True)
    return read_csv(t.spark, path, sep=";", trim=True, comment="#", usecols=["s_suppkey", "s_name", "s_acctbal"], nrows=40)


@query("select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus, o_orderdate from orders")
def io_csv_dates_na(t):
    from loomframe.sources import read_csv, write_csv

    write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), path := _folder(t, "csv"))
    return read_csv(t.spark, path, na_values=["P"], parse_dates=["o_orderdate"], date_format="%Y-%m-%dT%H:%M:%SZ")


@query("select c_custkey as column_0, c_mktsegment as column_1 from customer")
def io_csv_no_header(t):
    from loomframe.sources import read_csv, write_csv

    write_csv(t.customer.select("c_custkey", "c_mktsegment"), path := _folder(t, "csv"), header=False)
    return read_csv(t.spark, path, header=False, categories=["column_1"])


@query("select r_regionkey::bigint as column_0, r_name as column_1 from region")
def io_json_values(t):
    from loomframe.sources import read_json, write_json

    write_json(t.region.select("r_regionkey", "r_name"), path := _folder(t, "json"), "values")
    return read_json(t.spark, path, "values")


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def from_records(t):
    return Frame.from_records(t.spark, t.nation.records())


@query("select n_nationkey::bigint as n_nationkey, n_regionkey::bigint as n_regionkey from nation")
def infer_objects(t):
    return t.nation.select("n_nationkey", "n_regionkey").astype({"n_nationkey": "string", "n_regionkey": "string"}).infer_objects()


@query("select i::bigint as i, (10 + i * 0.5)::double as v from range(20) r(i)")
def nd_arange(t):
    return NDArray.arange(t.spark, 10, 20, 0.5).df


@query("select (a.i * 5 + b.i)::bigint as i, (case when a.i = b.i then 1 else 0 end)::double as v from range(5) a(i), range(5) b(i)")
def nd_eye(t):
    return NDArray.eye(t.spark, 5).df


@query("select i::bigint as i, (i * 0.25)::double as v from range(9) r(i)")
def nd_linspace(t):
    return NDArray.linspace(t.spark, 0, 2, 9).df.withColumn("v", F.round("v", 9))


@query(f"select (r * 64 + j)::bigint as i, trunc(x * 100)::bigint as v from {_CELLS}")
def nd_astype(t):
    return _matrix(t).mul(100.0).astype("int64").df


@query(f"select (r * 64 + j)::bigint as i, x > 0 as v from {_CELLS}")
def nd_isnan(t):
    return _matrix(t).ufunc("sqrt").ufunc("isfinite").logical_and(_matrix(t).gt(0.0)).df


@query(f"select round(sum(x), 5) as sum, round(avg(x), 8) as mean, min(x) as min, max(x) as max, round(var_pop(x), 8) as var, round(stddev_pop(x), 8) as std from {_CELLS}")
def nd_reduce_all(t):
    m = _matrix(t)
    digits = {"sum": 5, "mean": 8, "var": 8, "std": 8}
    return t.spark.range(1).select(*[F.lit(round(v, digits[h]) if h in digits else v).alias(h) for h in ("sum", "mean", "min", "max", "var", "std") for v in [m.reduce(h)]])


@query(f"select (j * {_ROWS} + r)::bigint as i, x as v from {_CELLS}")
def nd_set(t):
    m = _matrix(t)
    return m.set((0, 0), 5.0).set((0, 0), m.item(0, 0)).T.df


@query("select r_name, n_name from nation join region on n_regionkey = r_regionkey")
def mi_from_arrays(t):
    f = merge(t.nation, t.region, left_on="n_regionkey", right_on="r_regionkey").select("r_name", "n_name")
    return labels.from_tuples(t.spark, f.rows(), ["r_name", "n_name"]).reset_index()


@query("select r_name, r_regionkey from region union all select n_name, n_nationkey from nation")
def concat_multi_index(t):
    a = t.region.select("r_name", "r_regionkey")._put({"v": F.lit(1)}).set_index("r_name", "r_regionkey")
    b = t.nation.select("n_name", "n_nationkey").rename({"n_name": "r_name", "n_nationkey": "r_regionkey"})._put({"v": F.lit(1)}).set_index("r_name", "r_regionkey")
    return concat([a, b]).reset_index().select("r_name", "r_regionkey")


@query("select min(ts) as first, max(ts) as last from events")
def time_label_ends(t):
    first, last = labels.ends(t.events.set_index("ts"))
    return t.spark.range(1).select(F.lit(first).cast("timestamp_ntz").alias("first"), F.lit(last).cast("timestamp_ntz").alias("last"))


@query("select median(value) as m, quantile_cont(value, 0.9) as q from events")
def quantile_by_ranks(t):
    from loomframe.plans.order import quantiles

    m, q = quantiles(t.raw("events"), F.col("value").cast("double"), [0.5, 0.9], block=10_000)
    return t.spark.range(1).select(F.lit(m).alias("m"), F.lit(q).alias("q"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet, text query, groups with several aggregates, sorted."""
    return QUERIES["gb_agglist"](spark, sf_dir).orderBy("l_returnflag", "l_linestatus")
