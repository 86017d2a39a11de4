"""Joins, groupings, windows and set operations over the star schema and the event stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.operators.changes import first_by
from listwright.operators.joins import band_join, count_in_ranges
from listwright.queries.registry import query, table


@query("events_top_types", """with e as (select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by day order by n desc, event_type) as place from e)
select day, event_type, n, place::int as place from r where place <= 3""")
def _(l, spark, d):
    e = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "event_type"))).filter("place <= 3")


@query("event_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(l, spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("events_first_wins", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def _(l, spark, d):
    return first_by(table(spark, d, "events"), "user_id", "event_type", order="event_id").select("user_id", "event_type", "event_id")


@query("closest_event", "with e as (select user_id, event_id, abs(epoch_ms(ts) - epoch_ms(timestamp '2024-01-15')) as far from events) select user_id, arg_min(event_id, (far, event_id)) as event_id from e group by 1")
def _(l, spark, d):
    far = F.abs(F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-15").cast("timestamp")))
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(far, F.col("event_id"))).alias("event_id"))


@query("calendar_duplicates", """select a.event_id as left_id, b.event_id as right_id from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(epoch_ms(a.ts) - epoch_ms(b.ts)) < 600000""")
def _(l, spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    pairs = band_join(e, e, ["user_id", "event_type"], "ts", timedelta(minutes=10))
    return pairs.filter("left_event_id < right_event_id").select(F.col("left_event_id").alias("left_id"), F.col("right_event_id").alias("right_id"))


@query("events_in_ranges", """with r as (select o_orderkey, o_orderdate, o_orderdate + interval 2 day as until from orders), e as (select event_id, timestamp '1995-01-01' + to_days((event_id % 1000)::int) as at from events)
select o_orderkey, count(*) as n from r join e on e.at >= r.o_orderdate and e.at < r.until group by 1""")
def _(l, spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("begin")).withColumn("until", F.col("begin") + F.expr("interval 2 days"))
    e = table(spark, d, "events").select("event_id", (F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval(F.col("event_id") % 1000)).alias("at"))
    return count_in_ranges(r, e, "begin", "until", "at", timedelta(days=2)).groupBy("o_orderkey").agg(F.sum("n").alias("n"))


@query("revenue_by_region", """select r_name, n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def _(l, spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority))")
def _(l, spark, d):
    return table(spark, d, "orders").groupingSets([[], ["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("favourites_semi", "select distinct o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(l, spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_custkey").distinct()


@query("never_ordered", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def _(l, spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("keyed_union", "select p_partkey, 'big' as size from part where p_size > 25 union all select p_partkey, 'small' from part where p_size <= 25 and p_partkey % 2 = 0")
def _(l, spark, d):
    from listwright.operators.changes import merge

    p = table(spark, d, "part").select("p_partkey", "p_size")
    base, update = p.filter("p_partkey % 2 = 0").withColumn("size", F.lit("small")), p.filter("p_size > 25").withColumn("size", F.lit("big"))
    return merge(base, update, "p_partkey").select("p_partkey", "size")


@query("distinct_values", "select distinct l_returnflag, l_linestatus from lineitem")
def _(l, spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("widest_first", "select l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) as line from lineitem group by 1")
def _(l, spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("line"))
