"""Queries of change data capture, store records and enrichment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators import changes, enrich
from listwright.queries.registry import query
from listwright.sources import sinks

_HASH = "substr(sha256(concat_ws('|', title, description, start_date, coalesce(end_date, ''), category, coalesce(location_name, ''), city)), 1, 16)"
_BASE = "select * from {listings} where ord % 10 <> 0"
_CURRENT = "select * replace (case when ord % 7 = 0 then concat(title, ' (updated)') else title end as title, case when ord % 4 = 1 then null else latitude end as latitude) from {listings} where ord % 10 <> 1"
_CHANGES = f"""with b as ({_BASE}), c as ({_CURRENT}), j as (select coalesce(c.source_id, b.source_id) as source_id, coalesce(c.ord, b.ord) as ord, coalesce(c.source, b.source) as source,
  case when b.source_id is null then 'new' when c.source_id is null then 'removed' when c.h = b.h then 'unchanged' else 'changed' end as change_type, b.latitude as b_lat, c.latitude as c_lat, b.longitude as b_lon,
  b.image_url as b_img, c.image_url as c_img from (select *, {_HASH} as h from c) c full join (select *, {_HASH} as h from b) b on c.source_id = b.source_id)"""


def _pair(l: DataFrame) -> tuple[DataFrame, DataFrame]:
    title = F.when(F.col("ord") % 7 == 0, F.concat("title", F.lit(" (updated)"))).otherwise(F.col("title"))
    lat = F.when(F.col("ord") % 4 == 1, None).otherwise(F.col("latitude"))
    return l.filter("ord % 10 <> 1").withColumn("title", title).withColumn("latitude", lat), l.filter("ord % 10 <> 0")


@query("diff", f"""{_CHANGES} select source_id, change_type, case when change_type = 'new' then c_lat when change_type = 'changed' then case when b_lat <> 0 and b_lon <> 0 then b_lat else c_lat end else b_lat end as latitude,
  case when change_type = 'new' then c_img when change_type = 'changed' then case when b_img <> '' and not contains(b_img, 'unsplash.com') then b_img else c_img end else b_img end as image_url from j""")
def _(l, spark, d):
    return changes.diff(*_pair(l)).select("source_id", "change_type", "latitude", "image_url")


@query("diff_counts", f"{_CHANGES} select change_type, count(*) as n from j group by 1")
def _(l, spark, d):
    return changes.diff(*_pair(l)).groupBy("change_type").agg(F.count("*").alias("n"))


@query("merge", "select source_id, case when ord % 3 = 0 then 'update' else 'base' end as side from {listings} where ord % 2 = 0 or ord % 3 = 0")
def _(l, spark, d):
    rows = l.select("source_id", "ord")
    base, update = rows.filter("ord % 2 = 0").withColumn("side", F.lit("base")), rows.filter("ord % 3 = 0").withColumn("side", F.lit("update"))
    return changes.merge(base, update).select("source_id", "side")


@query("upserts", f"{_CHANGES} select source_id, change_type from j where change_type in ('new', 'changed') and not (change_type = 'changed' and ord % 4 = 0)")
def _(l, spark, d):
    edited = l.filter("ord % 4 = 0").select(changes.record_name(F.col("source_id")).alias("record_name"))
    return changes.upserts(changes.diff(*_pair(l)), edited).select("source_id", "change_type")


@query("deletes", f"{_CHANGES} select source_id, regexp_replace(source_id, '[^a-zA-Z0-9_-]', '_', 'g') as record_name from j where change_type = 'removed' and source not in ('src1', 'src3') order by ord, source_id limit 200")
def _(l, spark, d):
    removed = changes.diff(*_pair(l)).filter("change_type = 'removed'")
    return changes.deletes(removed, l.filter("source not in ('src1', 'src3')"))


@query("store_records", """select regexp_replace(source_id, '[^a-zA-Z0-9_-]', '_', 'g') as record_name, epoch_ms(cast(start_date as timestamp)) as start_ms, epoch_ms(cast(end_date as timestamp)) as end_ms,
  is_all_day::int as all_day, coalesce(image_url, '') as image_url, nullif(price, '') as price, coalesce(status, 'published') as status from {listings}""")
def _(l, spark, d):
    r = sinks.records(l.withColumns({c: F.lit(None).cast("string") for c in ("age_range", "phone", "contact_email")}))
    return r.select("record_name", F.col("fields.start_date").alias("start_ms"), F.col("fields.end_date").alias("end_ms"), F.col("fields.is_all_day").alias("all_day"), "fields.image_url", "fields.price", "fields.status")


@query("calendar_export", """select source_id, cast(start_date as timestamp) as begin, coalesce(cast(end_date as timestamp), cast(start_date as timestamp) + interval 1 hour) as finish, concat_ws(', ', nullif(location_name, ''), nullif(address, ''), nullif(city, '')) as place from {listings}""")
def _(l, spark, d):
    out = sinks.calendar_rows(l)
    return out.select("source_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("finish").cast("timestamp_ntz").alias("finish"), "place")


@query("reminders", "select source_id, cast(start_date as timestamp) - interval 1 hour as remind_at from {listings} where cast(start_date as timestamp) - interval 1 hour > timestamp '2024-01-20'")
def _(l, spark, d):
    return sinks.reminders(l, datetime(2024, 1, 20)).select("source_id", F.col("remind_at").cast("timestamp_ntz").alias("remind_at"))


@query("status_update", "select source_id, case when ord % 7 = 0 then 'published' else status end as status from {listings}")
def _(l, spark, d):
    return sinks.apply_status(l, l.filter("ord % 7 = 0"), "published").select("source_id", "status")


@query("verify", """with l as (select * from {listings}), g as (select l.*, b.doc_id is not null and b.toxic = 1 as bad from l left join (select doc_id, max(toxic) as toxic from labels group by 1) b on b.doc_id = l.ord),
  k as (select *, case when source in ('src1', 'src2') then 'source' when external_url like 'https://%' and not contains(external_url, 'google.com/search') and not contains(external_url, 'venue3.example') then 'link'
  when contains(lower(concat_ws(' ', title, location_name, description)), 'hall 4') then 'venue' else 'verdict' end as layer from g)
select source_id, layer, case when layer = 'verdict' and coalesce(bad, false) then 'draft' else 'published' end as status from k""")
def _(l, spark, d):
    verdicts = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    verdicts = l.join(verdicts, l.ord == verdicts.doc_id).select("source_id", (F.col("toxic") != 1).alias("plausible"))
    return enrich.verify(l, ["src1", "src2"], ["venue3.example"], ["Hall 4"], verdicts).select("source_id", "layer", "status")


@query("image_rotation", """with l as (select * from {listings}), need as (select source_id, category, row_number() over (partition by category order by ord) - 1 as i from l where not coalesce(image_url <> '', false))
select l.source_id, case when n.source_id is not null and l.category in ('Music', 'Craft') then concat(l.category, '-', cast(n.i % 3 as varchar)) else l.image_url end as image_url from l left join need n on l.source_id = n.source_id""")
def _(l, spark, d):
    images = spark.createDataFrame([(c, i, f"{c}-{i}") for c in ("Music", "Craft") for i in range(3)], "category string, place int, url string")
    return enrich.rotate_images(l, images).select("source_id", "image_url")


@query("contradictions", r"""with l as (select * from {listings}), t as (select source_id, category, price, case when ord % 16 = 0 then concat('$7 ', title) when ord % 24 = 8 then concat(title, ' ($12.50)') else title end as title from l),
 p as (select *, coalesce(nullif(regexp_extract(title, '\(\$(\d+(?:\.\d{2})?)\)', 1), ''), nullif(regexp_extract(title, '^\$(\d+)', 1), '')) as told from t)
select source_id, case when category = 'Free Movie' and ((coalesce(price <> '', false) and lower(price) <> 'free' and price <> 'Included with admission') or regexp_matches(trim(title), '^\$\d')) then 'Other' else category end as category,
  case when lower(price) = 'free' and told is not null then concat('$', told) else price end as price from p""")
def _(l, spark, d):
    title = F.when(F.col("ord") % 16 == 0, F.concat(F.lit("$7 "), "title")).when(F.col("ord") % 24 == 8, F.concat("title", F.lit(" ($12.50)"))).otherwise(F.col("title"))
    return enrich.contradictions(l.withColumn("title", title)).select("source_id", "category", "price")


@query("venue_lookup", """with v(place, name, url) as (values (0, 'hall 3', 'u3'), (1, 'hall', 'u0'), (2, 'big hall 5 east', 'u5')), l as (select * from {listings})
select source_id, (select url from v where contains(lower(location_name), v.name) or contains(v.name, lower(location_name)) order by case when lower(location_name) = v.name then 0 else 2 end, place limit 1) as venue_url from l""")
def _(l, spark, d):
    venues = spark.createDataFrame([(0, "Hall 3", "u3"), (1, "Hall", "u0"), (2, "Big Hall 5 East", "u5")], "place int, name string, url string")
    return enrich.venue_lookup(l, venues).select("source_id", "venue_url")


@query("geocode", """with l as (select * from {listings}), ok as (select *, coalesce((latitude <> 0 or longitude <> 0) and latitude between 24 and 50 and longitude between -130 and -65, false) as fine from l)
select source_id, case when fine then latitude when location_name = 'Hall 2' and city = 'en' then 33.5 when city = 'en' then 34.0 end as latitude from ok""")
def _(l, spark, d):
    gazetteer = spark.createDataFrame([("hall 2, en", 33.5, -117.5), ("en", 34.0, -118.0), ("de", 52.5, 13.4)], "query string, latitude double, longitude double")
    bounds = spark.createDataFrame([(m, 33.0, 35.0, -119.0, -117.0) for m in ("los-angeles", "orange-county")], "metro string, min_lat double, max_lat double, min_lon double, max_lon double")
    return enrich.geocode(l, gazetteer, bounds).select("source_id", "latitude")


@query("fresh_cache", """with e as (select user_id as key, ts as cached_at, event_id as ord from events), f as (select *, row_number() over (partition by key order by cached_at desc, ord) as n from e where cached_at >= timestamp '2024-01-20')
select key, cached_at, ord from f where n = 1""")
def _(l, spark, d):
    cache = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at"), F.col("event_id").alias("ord"))
    return enrich.fresh(cache, datetime(2024, 2, 19), 30)


@query("batches", "select source_id, metro, ((row_number() over (partition by metro order by ord) - 1) // 200)::bigint as batch from {listings}")
def _(l, spark, d):
    place = F.row_number().over(Window.partitionBy("metro").orderBy("ord"))
    return l.select("source_id", "metro", F.floor((place - 1) / 200).alias("batch"))


@query("location_groups", "select lower(concat_ws(', ', nullif(location_name, ''), city)) as place, count(*) as n, min(ord) as first_ord from {listings} where location_name <> '' group by 1")
def _(l, spark, d):
    return l.filter("location_name <> ''").groupBy(F.element_at(enrich.location_queries(), 1).alias("place")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("first_pages", """with f as (select external_url, min(ord) as seen from {listings} where external_url <> '' group by 1 order by seen, external_url limit 5)
select l.source_id, f.seen from {listings} left join f on l.external_url = f.external_url""")
def _(l, spark, d):
    facts = l.filter("external_url <> ''").groupBy("external_url").agg(F.min("ord").alias("seen"))
    return enrich.page_facts(l, facts, 5).select("source_id", "seen")
