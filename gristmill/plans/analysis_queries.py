"""Analytics over the star schema: aggregates, joins, windows, trends, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import analyse as an
from gristmill.operators import filters as flt
from gristmill.operators import ordered
from gristmill.plans.registry import Tables, query

STAR = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]
STAR_SQL = """lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
REVENUE_SQL = "cast(round(l_extendedprice * (1 - l_discount), 4) as decimal(18,4))"


def revenue():
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")


def star(t: Tables) -> DataFrame:
    return an.join_edges(t.named("lineitem", "orders", "customer", "nation", "region"), "lineitem", STAR)


@query("J1 A2 A12 A15 W1 K1", f"""
with g as (select r_name, round(cast(sum({REVENUE_SQL}) as double), 2) as revenue from {STAR_SQL} group by r_name)
select r_name, revenue, round(100.0 * revenue / sum(revenue) over (), 2) as share from g
order by revenue desc, r_name limit 5""")
def revenue_share_by_region(t: Tables) -> DataFrame:
    by_region = star(t).groupBy("r_name").agg(F.round(F.sum(revenue()).cast("double"), 2).alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy())
    return (by_region.withColumn("share", F.round(100.0 * F.col("revenue") / total, 2))
            .orderBy(F.desc("revenue"), "r_name").limit(5))


@query("J1 A1 A15", f"select n_name, count(*) as row_count from {STAR_SQL} group by n_name")
def join_count_by_nation(t: Tables) -> DataFrame:
    return an.count_rows(star(t), "n_name")


@query("J1 F10 F18", f"""
select o_orderkey, c_name, n_name, o_totalprice from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey where o_totalprice > 300000 and o_orderstatus = 'F'""")
def join_list_filtered(t: Tables) -> DataFrame:
    joined = an.join_edges(t.named("orders", "customer", "nation"), "orders", STAR[1:3])
    test = flt.from_spec(joined, {"o_totalprice": {"gt": 300000}, "o_orderstatus": "F"})
    return joined.filter(test).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("A1", "select count(*) as row_count from lineitem")
def count_all(t: Tables) -> DataFrame:
    return an.count_rows(t.lineitem)


@query("A1", "select l_returnflag, count(*) as row_count from lineitem group by l_returnflag")
def count_grouped(t: Tables) -> DataFrame:
    return an.count_rows(t.lineitem, "l_returnflag")


@query("A2", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
  round(avg(l_extendedprice), 4) as avg_price, min(l_discount) as min_disc, max(l_tax) as max_tax, count(*) as order_count
from lineitem group by l_returnflag, l_linestatus""")
def aggregate_basic(t: Tables) -> DataFrame:
    out = an.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [
        {"fn": "SUM", "column": "l_quantity", "alias": "sum_qty"},
        {"fn": "AVG", "column": "l_extendedprice", "alias": "avg_price"},
        {"fn": "MIN", "column": "l_discount", "alias": "min_disc"},
        {"fn": "MAX", "column": "l_tax", "alias": "max_tax"},
        {"fn": "COUNT", "alias": "order_count"},
    ])
    return out.withColumn("sum_qty", F.round("sum_qty", 2)).withColumn("avg_price", F.round("avg_price", 4))


@query("A2 T11", """
select event_type, round(sum(try_cast(json_extract_string(props, '$.k') as double)), 2) as sum_k from events
where try_cast(json_extract_string(props, '$.k') as double) is not null group by event_type""")
def aggregate_cast_text(t: Tables) -> DataFrame:
    events = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return an.measure(events, "SUM", "k", "event_type").withColumn("sum_k", F.round("sum_k", 2))


@query("A2 A14", """
select c_mktsegment, round(sum(c_acctbal), 2) as sum_c_acctbal from customer group by c_mktsegment
having sum(c_acctbal) > 1300000""")
def aggregate_having(t: Tables) -> DataFrame:
    out = an.measure(t.customer, "SUM", "c_acctbal", "c_mktsegment")
    return (out.filter(flt.predicate("sum_c_acctbal", "gt", 1300000))
            .withColumn("sum_c_acctbal", F.round("sum_c_acctbal", 2)))


@query("A14", """
select o_custkey, count(*) as orders from orders group by o_custkey
having count(*) >= 15 and count(*) != 17""")
def having_on_count(t: Tables) -> DataFrame:
    return an.analyse({"orders": t.orders}, {
        "table": "orders", "dimensions": ["o_custkey"], "metrics": [{"fn": "COUNT", "alias": "orders"}],
        "having": [("orders", ">=", 15), ("orders", "!=", 17)],
    })


@query("A3", """
select p_brand, round(median(p_retailprice), 4) as median_price from part group by p_brand""")
def median_by_brand(t: Tables) -> DataFrame:
    out = an.aggregate(t.part, ["p_brand"], [{"fn": "MEDIAN", "column": "p_retailprice", "alias": "median_price"}])
    return out.withColumn("median_price", F.round("median_price", 4))


@query("A3 A9", """
select l_shipmode_free.l_returnflag, round(median(l_extendedprice), 4) as p50,
  round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem l_shipmode_free group by l_returnflag""")
def percentiles_spread(t: Tables) -> DataFrame:
    """The path for groups of any size: count values, cut, order only the pieces needed."""
    out = ordered.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9})
    return out.withColumn("p50", F.round("p50", 4)).withColumn("p90", F.round("p90", 4))


@query("A4", """
select o_orderpriority, round(stddev_samp(o_totalprice), 4) as std_price, round(var_samp(o_totalprice), 0) as var_price
from orders group by o_orderpriority""")
def deviation_by_priority(t: Tables) -> DataFrame:
    out = an.aggregate(t.orders, ["o_orderpriority"], [
        {"fn": "STDDEV", "column": "o_totalprice", "alias": "std_price"},
        {"fn": "VARIANCE", "column": "o_totalprice", "alias": "var_price"}])
    return out.withColumn("std_price", F.round("std_price", 4)).withColumn("var_price", F.round("var_price", 0))


@query("A5", """
select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers
from lineitem group by l_returnflag""")
def count_distinct_parts(t: Tables) -> DataFrame:
    return an.aggregate(t.lineitem, ["l_returnflag"], [
        {"fn": "COUNT_DISTINCT", "column": "l_partkey", "alias": "parts"},
        {"fn": "COUNT_DISTINCT", "column": "l_suppkey", "alias": "suppliers"}])


@query("A6 U3", "select distinct p_type from part order by p_type")
def distinct_types(t: Tables) -> DataFrame:
    return an.distinct_values(t.part, "p_type")


@query("A7", "select p_brand, count(*) as frequency from part group by p_brand")
def frequency_of_brands(t: Tables) -> DataFrame:
    return an.count_rows(t.part, "p_brand", "frequency")


@query("A8", """
with c as (select l_returnflag, l_quantity, count(*) n from lineitem group by all)
select l_returnflag, l_quantity as mode_quantity from c
qualify row_number() over (partition by l_returnflag order by n desc, l_quantity) = 1""")
def mode_by_flag(t: Tables) -> DataFrame:
    return an.aggregate(t.lineitem, ["l_returnflag"], [{"fn": "MODE", "column": "l_quantity", "alias": "mode_quantity"}])


@query("A9", """
select p_type, round(quantile_cont(p_retailprice, 0.25), 4) as q1, round(quantile_cont(p_retailprice, 0.9), 4) as d9
from part group by p_type""")
def percentile_by_type(t: Tables) -> DataFrame:
    out = ordered.percentiles(t.part, ["p_type"], "p_retailprice", {"q1": 0.25, "d9": 0.9})
    return out.select("p_type", F.round("q1", 4).alias("q1"), F.round("d9", 4).alias("d9"))


@query("A10 W1", """
select o_orderpriority, count(*) as row_count, round(100.0 * count(*) / sum(count(*)) over (), 2) as percentage
from orders group by o_orderpriority""")
def share_of_priority(t: Tables) -> DataFrame:
    return an.share(t.orders, "o_orderpriority")


@query("A11", """
select l_linestatus, round(sum(case when l_returnflag = 'A' then l_quantity end), 2) as A,
  round(sum(case when l_returnflag = 'N' then l_quantity end), 2) as N,
  round(sum(case when l_returnflag = 'R' then l_quantity end), 2) as R
from lineitem group by l_linestatus""")
def compare_flags(t: Tables) -> DataFrame:
    flags = ["A", "N", "R"]
    wide = t.lineitem.groupBy("l_linestatus").pivot("l_returnflag", flags).agg(F.sum("l_quantity"))
    return wide.select("l_linestatus", *[F.round(f, 2).alias(f) for f in flags])


@query("A12 A13 A14 K2 J1", """
select c_mktsegment, o_orderstatus, count(*) as orders, round(avg(o_totalprice), 4) as avg_total,
  round(100.0 * count(*) filter (o_orderpriority ilike '%urgent%') / nullif(count(*), 0), 4) as urgent_rate
from orders join customer on o_custkey = c_custkey where o_totalprice >= 1000
group by c_mktsegment, o_orderstatus having count(*) > 500
order by avg(o_totalprice) desc limit 10""")
def analysis_from_spec(t: Tables) -> DataFrame:
    out = an.analyse(t.named("orders", "customer"), {
        "table": "orders", "joins": [STAR[1]],
        "where": {"o_totalprice": {">=": 1000}},
        "dimensions": ["c_mktsegment", "o_orderstatus"],
        "metrics": [{"fn": "COUNT", "alias": "orders"}, {"fn": "AVG", "column": "o_totalprice", "alias": "avg total"}],
        "rates": [{"column": "o_orderpriority", "contains": "urgent", "alias": "urgent rate"}],
        "having": [("orders", ">", 500)], "sort": [("avg_total", "desc")], "limit": 10,
    })
    return out.withColumn("avg_total", F.round("avg_total", 4)).withColumn("urgent_rate", F.round("urgent_rate", 4))


@query("A13", """
select event_type, round(100.0 * sum(case when value > 20 then 1 else 0 end) / nullif(count(*), 0), 4) as high_rate
from events group by event_type""")
def rate_of_flag(t: Tables) -> DataFrame:
    flagged = t.events.withColumn("high", F.col("value") > 20)
    out = an.aggregate(flagged, ["event_type"], [], [{"column": "high", "alias": "high_rate"}])
    return out.withColumn("high_rate", F.round("high_rate", 4))


@query("A21", """
select count(l_extendedprice) as count, min(l_extendedprice) as min, max(l_extendedprice) as max,
  round(avg(l_extendedprice), 4) as average, round(median(l_extendedprice), 4) as median,
  round(stddev_samp(l_extendedprice), 4) as stddev from lineitem""")
def summary_statistics(t: Tables) -> DataFrame:
    out = an.aggregate(t.lineitem, [], [
        {"fn": fn, "column": "l_extendedprice", "alias": alias} for fn, alias in (
            ("COUNT", "count"), ("MIN", "min"), ("MAX", "max"), ("AVG", "average"),
            ("MEDIAN", "median"), ("STDDEV", "stddev"))])
    return out.select("count", "min", "max", *[F.round(c, 4).alias(c) for c in ("average", "median", "stddev")])


@query("K1", """
select p_partkey, p_name, p_retailprice from part where p_retailprice is not null
order by p_retailprice desc, p_partkey limit 25""")
def top_parts(t: Tables) -> DataFrame:
    return an.ranked(t.part, "p_retailprice", "p_partkey", 25).select("p_partkey", "p_name", "p_retailprice")


@query("K1", """
select s_suppkey, s_acctbal from supplier where s_acctbal is not null order by s_acctbal, s_suppkey limit 10""")
def bottom_suppliers(t: Tables) -> DataFrame:
    return an.ranked(t.supplier, "s_acctbal", "s_suppkey", 10, descending=False).select("s_suppkey", "s_acctbal")


@query("K7", """
select c_custkey, c_name, c_acctbal from customer order by c_custkey limit 100 offset 200""")
def page_of_customers(t: Tables) -> DataFrame:
    return ordered.page(t.customer.select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], 3, 100)


@query("K8 K3", """
select o_orderkey, o_orderstatus, o_totalprice from orders
order by o_orderstatus asc, o_totalprice desc, o_orderkey asc limit 500""")
def sort_by_many(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return an.order(rows, [("o_orderstatus", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")]).limit(500)


@query("W2 W3 D1 D3", """
with p as (select strftime(o_orderdate, '%Y-%m') as period, sum(o_totalprice) as v from orders group by 1)
select period, round(v, 2) as period_value,
  round(avg(v) over (order by period rows between 2 preceding and current row), 4) as moving_average,
  round(100.0 * (v - lag(v) over (order by period)) / nullif(lag(v) over (order by period), 0), 2) as pct_change
from p""")
def trend_monthly(t: Tables) -> DataFrame:
    out = an.trend(t.orders, "o_orderdate", "month", "o_totalprice", moving_average=3, change=True)
    return out.withColumn("period_value", F.round("period_value", 2)).withColumn("moving_average", F.round("moving_average", 4))


@query("W6 D3", """
with p as (select strftime(ts, '%Y-%m-%d') as period, count(*) as row_count from events group by 1)
select period, row_count, round(avg(row_count) over (order by period rows between 6 preceding and current row), 6) as moving_average
from p""")
def trend_daily_events(t: Tables) -> DataFrame:
    out = an.trend(t.events, "ts", "day", moving_average=7)
    return out.withColumn("moving_average", F.round("moving_average", 6))


@query("D1", """
select strftime(o_orderdate, '%Y-%m-%d %H:00') as h, strftime(o_orderdate, '%Y-%W') as w,
  strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) as q, strftime(o_orderdate, '%Y') as y,
  count(*) as row_count from orders group by all""")
def time_buckets(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    return t.orders.groupBy(an.bucket(day, "hour").alias("h"), an.bucket(day, "week").alias("w"),
                            an.bucket(day, "quarter").alias("q"), an.bucket(day, "year").alias("y")
                            ).agg(F.count("*").alias("row_count"))


@query("D2", """
with s as (select 'events' as name, date_diff('day', min(ts), max(ts)) as days from events
  union all select 'orders', date_diff('day', min(o_orderdate), max(o_orderdate)) from orders
  union all select 'lineitem', date_diff('day', min(l_shipdate), max(l_shipdate)) from lineitem)
select name, case when days <= 3 then 'hour' when days <= 90 then 'day' when days <= 730 then 'week'
  when days <= 2920 then 'month' when days <= 10950 then 'quarter' else 'year' end as granularity from s""")
def granularity_from_span(t: Tables) -> DataFrame:
    spans = [df.agg(F.lit(name).alias("name"), F.min(c).alias("lo"), F.max(c).alias("hi"))
             for name, df, c in (("events", t.events, "ts"), ("orders", t.orders, "o_orderdate"),
                                 ("lineitem", t.lineitem, "l_shipdate"))]
    together = spans[0].unionByName(spans[1]).unionByName(spans[2])
    return together.select("name", an.granularity_of(F.col("lo"), F.col("hi")).alias("granularity"))


@query("W4", """
with g as (select c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) as total from customer group by all)
select c_mktsegment, c_nationkey, total, rank() over w as rank, dense_rank() over w as dense,
  row_number() over (partition by c_mktsegment order by total desc, c_nationkey) as position
from g window w as (partition by c_mktsegment order by total desc)""")
def rank_nations(t: Tables) -> DataFrame:
    """Ranks of aggregated groups: at most one row per nation in a window."""
    totals = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    by_total = Window.partitionBy("c_mktsegment").orderBy(F.desc("total"))
    return totals.select("*", F.rank().over(by_total).cast("long").alias("rank"),
                         F.dense_rank().over(by_total).cast("long").alias("dense"),
                         F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("total"), "c_nationkey"))
                         .cast("long").alias("position"))


@query("W5", """
select o_orderstatus, o_orderkey, round(cast(sum(cast(o_totalprice as decimal(18,2))) over
  (partition by o_orderstatus order by o_orderkey rows unbounded preceding) as double), 2) as running from orders""")
def running_total_by_status(t: Tables) -> DataFrame:
    """Three status groups hold all rows, so each is cut into ordered pieces."""
    out = ordered.running_total(t.orders, ["o_orderstatus"], ["o_orderkey"],
                                F.col("o_totalprice").cast("decimal(18,2)"), "running")
    return out.select("o_orderstatus", "o_orderkey", F.round(F.col("running").cast("double"), 2).alias("running"))


@query("U4", """
select count(*) as shared from (select distinct o_custkey from orders intersect select distinct c_custkey from customer)""")
def key_intersection(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey").intersect(t.customer.select("c_custkey")).agg(F.count("*").alias("shared"))
