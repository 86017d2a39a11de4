"""Queries of readers and administrators: filters, sorts, feeds, calendars, maps, reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from listwright.functions import geo, price
from listwright.operators import filters, views
from listwright.operators.changes import first_by
from listwright.queries.registry import query

NOW = datetime(2024, 1, 13, 9, 30)  # a Saturday
HOME = (33.6846, -117.8265)

_TS = "cast({c} as timestamp)"
_FREE = "coalesce(lower(trim(price)) in ('free', '$0', '0') or contains(lower(price), 'free'), false)"
_LAST = "coalesce(cast(end_date as timestamp), cast(start_date as timestamp))"
_VALID = "(latitude is not null and longitude is not null and (latitude <> 0 or longitude <> 0))"
_VISIBLE = "coalesce(status not in ('draft', 'rejected'), true)"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(33.6846 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(33.6846)) * pow(sin(radians(-117.8265 - longitude) / 2), 2), 1)))"
_TIER_TOP = """list_max(list_transform(case when len(regexp_extract_all(price, '\\$\\s*(\\d+(?:\\.\\d{1,2})?)', 1)) > 0
  then regexp_extract_all(price, '\\$\\s*(\\d+(?:\\.\\d{1,2})?)', 1) else regexp_extract_all(price, '(\\d+(?:\\.\\d{1,2})?)', 1) end, lambda x: x::double))"""
_TIER = f"""(case when coalesce(trim(price), '') = '' then null when {_FREE} then 0 when {_TIER_TOP} is null then 1 when {_TIER_TOP} = 0 then 0
  when {_TIER_TOP} between 1 and 10 then 1 when {_TIER_TOP} between 11 and 25 then 2 when {_TIER_TOP} between 26 and 50 then 3
  when {_TIER_TOP} between 51 and 100 then 4 else 5 end)"""


@query("filter_category", "select source_id, category from {listings} where category in ('Music', 'Craft')")
def _(l, spark, d):
    return filters.ListingFilter(categories={"Music", "Craft"}).apply(l, NOW).select("source_id", "category")


@query("filter_free", f"select source_id, price from {{listings}} where {_FREE}")
def _(l, spark, d):
    return filters.ListingFilter(price="free").apply(l, NOW).select("source_id", "price")


@query("filter_paid", f"select source_id, price from {{listings}} where coalesce(trim(price) <> '', false) and not {_FREE}")
def _(l, spark, d):
    return filters.ListingFilter(price="paid").apply(l, NOW).select("source_id", "price")


def _range(name: str, begin: str, until: str):
    @query(f"filter_dates_{name}", f"select source_id, start_date, end_date from {{listings}} where cast(start_date as timestamp) < timestamp '{until}' and {_LAST} >= timestamp '{begin}'")
    def _(l, spark, d):
        return filters.ListingFilter(dates=name).apply(l, NOW).select("source_id", "start_date", "end_date")


_range("today", "2024-01-13", "2024-01-14")
_range("week", "2024-01-07", "2024-01-14")
_range("weekend", "2024-01-13", "2024-01-15")
_range("month", "2024-01-01", "2024-02-01")


@query("filter_dates_custom", f"select source_id, start_date from {{listings}} where cast(start_date as timestamp) < timestamp '2024-01-22' and {_LAST} >= timestamp '2024-01-20'")
def _(l, spark, d):
    return filters.ListingFilter(dates="custom", custom=(datetime(2024, 1, 20, 5), datetime(2024, 1, 21))).apply(l, NOW).select("source_id", "start_date")


@query("filter_distance", f"select source_id from {{listings}} where {_VALID} and {_HAVERSINE} <= 20 * 1609.34")
def _(l, spark, d):
    return filters.ListingFilter(miles=20).apply(l, NOW, current=HOME).select("source_id")


@query("filter_combined", f"select source_id from {{listings}} where category in ('Music') and coalesce(trim(price) <> '', false) and not {_FREE} and {_VALID} and {_HAVERSINE} <= 30 * 1609.34 and cast(start_date as timestamp) < timestamp '2024-02-01' and {_LAST} >= timestamp '2024-01-01'")
def _(l, spark, d):
    f = filters.ListingFilter(categories={"Music"}, price="paid", dates="month", miles=30, origin="home", sort="price")
    return f.apply(l, NOW, home=HOME).select("source_id")


@query("filter_stale", "select source_id, start_date from {listings} where not (start_date < '2024-01-13T00:00:00.000Z')")
def _(l, spark, d):
    return l.filter(~filters.stale(F.col("start_date"), NOW)).select("source_id", "start_date")


@query("filter_window", "select source_id from {listings} where cast(start_date as timestamp) between timestamp '2024-01-13 09:30:00' and timestamp '2024-01-20 09:30:00'")
def _(l, spark, d):
    return l.filter(filters.in_window(F.col("start_date"), NOW, 7)).select("source_id")


@query("filter_keywords", "select source_id from {listings} where contains(lower(description), 'that the') or contains(lower(description), 'und die')")
def _(l, spark, d):
    return l.filter(filters.any_keyword(F.col("description"), ["That the", "und die"])).select("source_id")


@query("filter_family", """select source_id from {listings} where not coalesce(regexp_matches(title, '\\bthe\\b') or regexp_matches(description, 'password|token')
  or (source in ('src1', 'src2') and (contains(lower(location_name), 'hall 2') or contains(lower(location_name), 'hall 4'))), false)""")
def _(l, spark, d):
    return filters.family_friendly(l, [r"\bthe\b"], ["password", "token"], ["Hall 2", "Hall 4"], ["src1", "src2"]).select("source_id")


@query("filter_guides", "select source_id from {listings} where (contains(description, ' the ')::int + contains(description, ' und ')::int + contains(description, ' de ')::int + contains(description, ' it ')::int) >= 2")
def _(l, spark, d):
    return l.filter(filters.guide_article(F.lit(""), F.col("description"), [" the ", " und ", " de ", " it "], 2)).select("source_id")


@query("filter_search", f"select source_id from {{listings}} where {_VISIBLE} and (contains(lower(title), 'tion') or contains(lower(city), 'tion'))")
def _(l, spark, d):
    return filters.search(l.filter(filters.visible(F.col("status"))), "Tion", ["title", "city"]).select("source_id")


@query("filter_search_tags", "select source_id from {listings} where contains(lower(title), 'music') or contains(lower(city), 'music') or contains(lower(category), 'music')")
def _(l, spark, d):
    return filters.search(l, "music", ["title", "city", "category"], tags="tags").select("source_id")


@query("filter_status", f"select coalesce(status, 'published') as status, count(*) as n from {{listings}} group by 1")
def _(l, spark, d):
    return l.groupBy(F.coalesce("status", F.lit("published")).alias("status")).agg(F.count("*").alias("n"))


@query("filter_coordinates", f"""select source_id, {_VALID} as valid, coalesce({_VALID} and latitude between 24 and 50 and longitude between -130 and -65, false) as in_country from {{listings}}""")
def _(l, spark, d):
    lat, lon = F.col("latitude"), F.col("longitude")
    return l.select("source_id", geo.has_coordinates(lat, lon).alias("valid"), geo.in_country(lat, lon).alias("in_country"))


@query("upcoming", f"select source_id, start_date from {{listings}} where cast(start_date as timestamp) between timestamp '2024-01-13' and timestamp '2024-03-13' and coalesce(metro, 'los-angeles') = 'los-angeles' and {_VISIBLE}")
def _(l, spark, d):
    return views.upcoming(l, NOW, "los-angeles").select("source_id", "start_date")


@query("sort_distance", f"select source_id, round({_HAVERSINE}, 3) as metres from {{listings}} order by {_HAVERSINE} nulls last, ord")
def _(l, spark, d):
    away = geo.metres(F.col("latitude"), F.col("longitude"), *HOME)
    return l.orderBy(*filters.ListingFilter(sort="distance").order(HOME)).select("source_id", F.round(away, 3).alias("metres"))


@query("sort_price", f"select source_id, {_TIER}::int as tier from {{listings}} order by coalesce({_TIER}, 99), start_date, ord")
def _(l, spark, d):
    return l.orderBy(*filters.ListingFilter(sort="price").order()).select("source_id", price.tier(F.col("price")).alias("tier"))


@query("price_tiers", f"select price, {_TIER}::int as tier, {_FREE} as free, count(*) as n from {{listings}} group by all")
def _(l, spark, d):
    p = F.col("price")
    return l.groupBy(p, price.tier(p).alias("tier"), price.is_free(p).alias("free")).agg(F.count("*").alias("n"))


@query("popular", """select source_id from {listings} order by (ord % 7 = 0)::int desc, is_featured::int desc, coalesce(image_url <> '', false)::int desc, start_date, ord limit 20""")
def _(l, spark, d):
    return views.popular(l, l.filter("ord % 7 = 0").select("source_id"), 20).select("source_id")


@query("recommended", """with l as (select * from {listings}), liked as (select distinct category from l where ord % 50 = 0), s as (
  select l.*, (case when category in ('Music') then 3 else 0 end + case when lower(category) = 'music' then 2 else 0 end
    + case when category in (select category from liked) then 1 else 0 end + case when cast(start_date as timestamp) <= timestamp '2024-01-20 09:30:00' then 1 else 0 end
    + case when image_url <> '' then 1 else 0 end - case when ord % 50 = 0 then 1 else 0 end)::int as score
  from l where cast(start_date as timestamp) >= timestamp '2024-01-13 09:30:00')
select source_id, score from s where score > 0 order by score desc, start_date, ord limit 10""")
def _(l, spark, d):
    return views.recommended(l, ["Music"], l.filter("ord % 50 = 0").select("source_id"), NOW).select("source_id", "score")


@query("calendar_days", """with r as (select source_id, cast(start_date as date) as day, row_number() over (partition by cast(start_date as date) order by start_date, ord) as place from {listings})
select day, count(*) as n, array_to_string(list(source_id order by place) filter (place <= 3), ',') as ids, greatest(count(*) - 3, 0) as more from r group by day""")
def _(l, spark, d):
    return views.by_day(l, 3).select("day", "n", F.array_join("ids", ",").alias("ids"), "more")


@query("calendar_month", """select g.day::date as day, 4 as blanks, count(l.source_id) as n from generate_series(timestamp '2024-02-01', timestamp '2024-02-29', interval 1 day) g(day)
  left join (select source_id, cast(end_date as date) as day from {listings}) l on l.day = g.day::date group by 1""")
def _(l, spark, d):
    return views.month_grid(l.withColumn("start_date", F.col("end_date")), date(2024, 2, 5))


@query("map_clusters", f"select round(latitude, 1) as lat_key, round(longitude, 1) as lon_key, count(*) as n, min(ord) as first_ord, arg_min(latitude, ord) as latitude, arg_min(longitude, ord) as longitude from {{listings}} where {_VALID} group by 1, 2")
def _(l, spark, d):
    return views.clusters(l, 1)


@query("summary", """with l as (select * from {listings}) select 'total' as kind, '' as value, count(*) as n from l union all select 'metro', metro, count(*) from l group by 2
  union all select 'source', source, count(*) from l group by 2 union all select 'category', category, count(*) from l group by 2""")
def _(l, spark, d):
    return views.summary(l)


@query("dashboard", f"""select count(*) as total, count(*) filter ({_LAST} >= timestamp '2024-01-13') as active, count(*) filter ({_LAST} < timestamp '2024-01-13') as expired,
  count(*) filter (is_featured) as featured, count(*) filter (not coalesce(image_url <> '', false)) as no_image, count(*) filter (not {_VALID} and {_LAST} >= timestamp '2024-01-13') as no_place,
  avg({_VALID}::int::double) as located_share from {{listings}}""")
def _(l, spark, d):
    return views.dashboard(l, NOW)


@query("nearest_metro", """select source_id, case when latitude is null then null when pow(latitude - 34.05, 2) + pow(longitude + 118.24, 2) <= pow(latitude - 33.68, 2) + pow(longitude + 117.83, 2) then 'la' else 'oc' end as nearest from {listings}""")
def _(l, spark, d):
    places = spark.createDataFrame([("la", 34.05, -118.24), ("oc", 33.68, -117.83)], "id string, latitude double, longitude double")
    return views.nearest(l, places).select("source_id", F.when(F.col("latitude").isNotNull(), F.col("nearest")).alias("nearest"))


@query("flagged", "select source_id, start_date from {listings} where not coalesce(image_url <> '', false) order by start_date, ord limit 10")
def _(l, spark, d):
    from listwright.schema import present

    return l.filter(~present("image_url")).orderBy("start_date", "ord").limit(10).select("source_id", "start_date")


@query("first_per_source", "select source, arg_min(source_id, ord) as source_id from {listings} group by source")
def _(l, spark, d):
    return first_by(l, "source").select("source", "source_id")
