"""Queries that read captured API answers: payloads are made of the listings, one for each, and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright import rules
from listwright.functions.text import record_name
from listwright.operators import changes
from listwright.queries.registry import query
from listwright.sources import apis

NOW = datetime(2024, 1, 13, 9, 30)
_SOON = "timestamp '2024-01-13' and timestamp '2024-03-13 09:30:00'"
_ANY_SERVICE = "|".join(f"(?:{p})" for p in rules.RELIGIOUS).replace("'", "''")


def _plain(x: str) -> str:
    for entity, c in (("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "' '")):
        x = f"replace({x}, '{entity}', {c})"
    return x


def _clean(x: str) -> str:
    return f"substr(trim(regexp_replace({_plain(f"regexp_replace({x}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')), 1, 500)"


def _stripped(x: str) -> str:
    broken = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10), 'g')"
    inner = f"regexp_replace({broken}, '<[^>]+>', '', 'g')"
    return f"trim(regexp_replace({_plain(inner)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), concat(' ', chr(10), chr(9), chr(13)))"


_TEXT, _BODY = _clean("coalesce(description, '')"), _clean(_stripped("coalesce(description, '')"))
_SERVICE = f"regexp_matches(concat_ws(' ', name, {_stripped("coalesce(description, '')")}), '(?i){_ANY_SERVICE}')"


def _payloads(l: DataFrame, item, *keep: str, under: str | None = "events") -> DataFrame:
    many = F.array(item)
    return l.select("ord", *keep, F.to_json(F.struct(many.alias(under)) if under else many).alias("payload"))


@query("review_events", f"""select concat('yelp:', ord) as source_id, title, {_TEXT} as description, start_date, end_date, city, case ord % 3 when 0 then '1 Oak St' when 1 then 'Line 1, Line 2' else '' end as address,
  case when ord % 5 = 0 then 'Free' when ord % 4 = 0 then '$7.50-$12.00' when ord % 4 = 1 then '$7.50' when ord % 4 = 2 then '$20.00' end as price, concat(category, case when ord % 5 = 0 then ',free' else ',paid' end) as tags from {{listings}} where ord % 7 <> 0""")  # fmt: skip
def _(l, spark, d):
    o = F.col("ord")
    address = F.struct("city", F.when(o % 3 == 0, "1 Oak St").when(o % 3 == 1, "").alias("address1"), F.when(o % 3 == 1, F.array(F.lit("Line 1"), F.lit("Line 2"))).otherwise(F.array().cast("array<string>")).alias("display_address"))
    event = F.struct(
        o.cast("string").alias("id"), F.col("title").alias("name"), "description", "category", (o % 7 == 0).alias("is_canceled"), (o % 5 == 0).alias("is_free"),
        F.when(o % 4 < 2, 7.5).when(o % 4 == 2, 20.0).otherwise(0.0).alias("cost"), F.when(o % 4 == 0, 12.0).when(o % 4 == 1, 7.5).alias("cost_max"),
        F.col("start_date").alias("time_start"), F.col("end_date").alias("time_end"), address.alias("location"),
    )
    return apis.review_events(_payloads(l, event)).select("source_id", "title", "description", "start_date", "end_date", "city", "address", "price", F.array_join("tags", ",").alias("tags"))


@query("sale_events", f"""select concat('eventbrite:', ord) as source_id, title, {_TEXT} as description, start_date, location_name, latitude, longitude,
  case ord % 3 when 0 then 'https://i.example.org/whole.png' when 1 then 'https://i.example.org/logo.png' end as image_url,
  case when ord % 5 = 0 then 'Free' when ord % 4 = 0 then '$5.00-$9.00' when ord % 4 = 1 then '$5.00' when ord % 4 = 2 then '$9.00' end as price, concat(category, ',tag') as tags
  from {{listings}} where ord % 7 not in (0, 1) and ord % 11 <> 2 and ord % 13 <> 3""")  # fmt: skip
def _(l, spark, d):
    o = F.col("ord")
    amount = lambda c: F.struct(c.alias("major_value"))
    address = F.struct(F.col("address").alias("address_1"), "city", F.col("latitude").cast("string").alias("latitude"), F.col("longitude").cast("string").alias("longitude"))
    low, high = F.when(o % 4 < 2, "5.00").when(o % 4 == 2, "9.00").otherwise(""), F.when(o % 4 == 0, "9.00").when(o % 4 == 1, "5.00")
    event = F.struct(
        o.cast("string").alias("id"), F.struct(F.col("title").alias("text")).alias("name"), F.struct(F.col("description").alias("text")).alias("description"),
        F.when(o % 7 == 0, "cancelled").when(o % 7 == 1, "draft").otherwise("live").alias("status"), (o % 11 == 2).alias("online_event"), (o % 5 == 0).alias("is_free"),
        F.struct(F.col("start_date").alias("local")).alias("start"), F.struct(amount(low).alias("minimum_ticket_price"), amount(high).alias("maximum_ticket_price")).alias("ticket_availability"),
        F.struct(F.when(o % 3 < 2, "https://i.example.org/logo.png").alias("url"), F.struct(F.when(o % 3 == 0, "https://i.example.org/whole.png").alias("url")).alias("original")).alias("logo"),
        F.array(F.struct(F.col("category").alias("display_name"), F.lit("x").alias("tag")), F.struct(F.lit("").alias("display_name"), F.lit("tag").alias("tag")), F.struct(F.lit("").alias("display_name"), F.lit("").alias("tag"))).alias("tags"),
        F.when(o % 13 != 3, F.struct(F.col("location_name").alias("name"), address.alias("address"))).alias("venue"),
    )
    return apis.sale_events(_payloads(l, event)).select("source_id", "title", "description", "start_date", "location_name", "latitude", "longitude", "image_url", "price", F.array_join("tags", ",").alias("tags"))


_LIBRARY = apis.Library("Orange", {"main": "Santa Ana", "el modena": "El Modena"}, {2: "Brea"})
_WORDS = ("", " - job search", " (cancelled)", " Storytime")


@query("library_events", f"""with t as (select *, ord // 2 as id, concat(title, case ord % 4 {' '.join(f"when {i} then '{t}'" for i, t in enumerate(_WORDS))} end) as t from {{listings}}),
k as (select * from t where not regexp_matches(lower(t), '{'|'.join(rules.LIBRARY_ADULT)}') qualify row_number() over (partition by id order by ord) = 1)
select concat('libcal:', id) as source_id, trim(t) as title, {_BODY} as description, start_date,
  case ord % 6 when 0 then 'Santa Ana' when 1 then 'Santa Ana' when 2 then 'El Modena' when 3 then 'Brea' when 4 then 'Orange' else 'Santa Ana' end as city,
  case ord % 6 when 0 then 'Main Library' when 1 then 'The Main Branch Library' when 2 then 'Modena Library' when 3 then 'Hall Library' when 4 then 'Hall Library' else '' end as location_name,
  case ord % 5 when 0 then '$3' else 'Free' end as price from k""")  # fmt: skip
def _(l, spark, d):
    o = F.col("ord")
    place = F.when(o % 6 == 0, "Main").when(o % 6 == 1, "The Main Branch").when(o % 6 == 2, "Modena").when(o % 6 < 5, "Hall")
    event = F.struct(
        F.floor(o / 2).alias("id"), F.concat("title", F.element_at(F.array(*map(F.lit, _WORDS)), (o % 4 + 1).cast("int"))).alias("title"), F.replace("start_date", F.lit("T"), F.lit(" ")).alias("startdt"),
        place.alias("location"), "description", F.when(o % 5 == 0, " $3 ").when(o % 5 == 1, "$0.00").when(o % 5 == 2, "").alias("registration_cost"),
    )
    p = _payloads(l.withColumn("calendar_id", F.when(o % 6 == 3, 2).otherwise(1)), event, "calendar_id")
    return apis.library_events(p, _LIBRARY).select("source_id", "title", "description", "start_date", "city", "location_name", "price")


_PARK = "case when ord % 2 = 0 then 'aaaaaaaa' else 'bbbbbbbb' end"


@query("park_schedule", f"""with t as (select *, {_PARK} as park, substr(start_date, 1, 10) as day, case ord % 3 when 0 then 'ticketed' else 'extra' end as kind from {{listings}} where ord % 4 <> 3),
k as (select * from t where day >= '2024-01-13' qualify row_number() over (partition by park, day, kind order by ord) = 1)
select concat('themeparks:', park, ':', kind, ':', day) as source_id, case kind when 'extra' then 'Park Extra Hours' else 'Park Special Ticketed Event' end as title, ord % 5 = 0 as is_all_day,
  case when ord % 5 = 0 then concat(day, 'T00:00:00') else concat(day, 'T18:00:00-08:00') end as start_date,
  case when kind = 'extra' then concat('Extended hours at Park. ', case when ord % 5 <> 0 then 'Hours: 6:00 PM - 11:30 PM. ' else '' end, 'Extra time to enjoy the park with fewer crowds.')
    when ord % 9 = 0 then concat('Night. ', case when ord % 5 <> 0 then 'Hours: 6:00 PM - 11:30 PM. ' else '' end, 'Special ticketed event at Park — separate admission required.')
    else concat('Special ticketed event at Park. ', case when ord % 5 <> 0 then 'Hours: 6:00 PM - 11:30 PM. ' else '' end, 'Separate admission required.') end as description from k""")  # fmt: skip
def _(l, spark, d):
    o, day = F.col("ord"), F.substring("start_date", 1, 10)
    hours = lambda t: F.when(o % 5 != 0, F.concat(day, F.lit(t)))
    entry = F.struct(
        day.alias("date"), F.when(o % 4 == 3, "OPERATING").when(o % 3 == 0, "TICKETED_EVENT").otherwise("EXTRA_HOURS").alias("type"), F.when(o % 9 == 0, "Night").alias("description"),
        hours("T18:00:00-08:00").alias("openingTime"), hours("T23:30:00-08:00").alias("closingTime"),
    )
    parks = l.withColumns({"park_id": F.concat(F.when(o % 2 == 0, "aaaaaaaa").otherwise("bbbbbbbb"), F.lit("-rest")), "name": F.lit("Park"), "url": F.lit("https://park.example.org")})
    read = apis.park_schedule(_payloads(parks, entry, "park_id", "name", "city", "address", "latitude", "longitude", "metro", "url", under="schedule"), NOW)
    return read.select("source_id", "title", "is_all_day", "start_date", "description")


@query("dated_programs", f"""with t as (select *, concat(title, case ord % 4 when 0 then ' bible study' else '' end) as name from {{listings}}), u as (select *, unnest([start_date, '2024-02-01T10:00:00', '2025-01-01T10:00:00']) as day from t)
select concat('programs:', ord, '-', substr(day, 1, 10)) as source_id, name as title, day as start_date, {_BODY} as description, concat_ws(' - ', city, nullif(location_name, '')) as location_name from u
where ord % 6 <> 1 and ord % 5 <> 2 and not {_SERVICE} and cast(day as timestamp) between {_SOON}""")  # fmt: skip
def _(l, spark, d):
    o = F.col("ord")
    who = F.when(o % 5 == 2, F.array(F.struct(F.lit("Men").alias("Value")))).when(o % 5 == 3, F.array(F.struct(F.lit("Men").alias("Value")), F.struct(F.lit("Kids").alias("Value"))))
    dates = F.array(*[F.struct(x.alias("StartDateTime")) for x in (F.col("start_date"), F.lit("2024-02-01T10:00:00"), F.lit("2025-01-01T10:00:00"))])
    item = F.struct(
        o.alias("EventItemOccurrenceId"), F.concat("title", F.when(o % 4 == 0, " bible study").otherwise("")).alias("Name"), F.col("description").alias("Description"),
        F.when(o % 6 == 1, "Online").otherwise(F.col("city")).alias("Campus"), F.col("location_name").alias("LocationDescription"), who.alias("Audiences"), dates.alias("EventDates"),
    )
    read = apis.dated_programs(_payloads(l, item, under=None), "programs", ["kids", "families"], NOW)
    return read.select("source_id", "title", "start_date", "description", "location_name")


@query("day_groups", f"""with t as (select *, ord // 3 as id, title as name from {{listings}}),
k as (select * from t where ord % 5 <> 1 and ord % 7 <> 2 and ord % 11 <> 3 and title <> '' and not {_SERVICE} and cast(start_date as timestamp) >= timestamp '2024-01-13' qualify row_number() over (partition by id, substr(start_date, 1, 10) order by ord) = 1)
select concat('days:', id, '-', substr(start_date, 1, 10)) as source_id, title, start_date, {_BODY} as description, case when ord % 2 = 0 then 'Brea' else coalesce(city, 'Lake Forest') end as city,
  case when ord % 2 = 0 then 'Brea, CA 92821' end as address, case ord % 4 when 0 then '$12' when 1 then null else 'Free' end as price from k""")  # fmt: skip
def _(l, spark, d):
    o = F.col("ord")
    at = F.when(o % 2 == 0, F.struct(F.lit("").alias("address1"), F.lit("Brea").alias("city"), F.lit("CA").alias("region"), F.lit("92821").alias("postalCode")))
    event = F.struct(
        F.floor(o / 3).alias("id"), F.when(o % 3 == 0, F.col("title")).alias("publicName"), F.col("title").alias("name"), "description", F.when(o % 5 == 1, 9).when(o % 5 == 2, 7).alias("categoryId"),
        (o % 7 == 2).alias("isVirtual"), F.when(o % 11 == 3, "on Zoom").alias("location"), F.col("city").alias("campusName"), (o % 4 < 2).alias("isPaid"), F.when(o % 4 == 0, "12").alias("cost"),
        F.struct(F.when(o % 2 == 0, F.col("start_date")).alias("localStartDateTime"), F.when(o % 2 == 1, F.col("start_date")).alias("date")).alias("occurrence"), at.alias("locationDetail"),
    )
    group = F.struct(F.lit("2024-01-20").alias("date"), F.array(event).alias("events"))
    read = apis.day_groups(_payloads(l, group, under=None), "days", [7, 6, 1], ["hong kong", "berlin"], NOW)
    return read.select("source_id", "title", "start_date", "description", "city", "address", "price")


@query("ongoing_search", f"""select concat('search:', ord) as source_id, trim(title) as title, {_BODY} as description, case when start_date < '2024-01-13' and end_date > '2024-01-13' then '2024-01-13T00:00:00' else start_date end as start_date, end_date,
  city, case when city in ('de', 'fr') then 'inside' else 'outside' end as metro, coalesce(nullif(latitude, 0), 1.5) as latitude, coalesce('https://more.example.org/' || case when ord % 3 = 0 then ord end, 'https://tickets.example.org') as external_url
  from {{listings}} where trim(title) <> '' and (end_date is null or end_date >= '2024-01-13')""")  # fmt: skip
def _(l, spark, d):
    o = F.col("ord")
    found = F.struct(F.struct(
        o.cast("string").alias("id"), F.col("title").alias("name"), "description", F.col("start_date").alias("starttime"),
        F.col("end_date").alias("endtime"), F.when(o % 3 == 0, F.concat(F.lit("https://more.example.org/"), o.cast("string"))).otherwise("").alias("moreinfo"), F.lit("https://tickets.example.org").alias("ticketurl"),
        F.struct("city", F.lit(1.5).alias("latitude")).alias("venue"), F.array("longitude", "latitude").alias("geo"),
    ).alias("_source"))
    read = apis.ongoing_search(_payloads(l, found), "search", ["DE", "fr"], "inside", "outside", NOW)
    return read.select("source_id", "title", "description", "start_date", "end_date", "city", "metro", "latitude", "external_url")


@query("read_records", """select source_id, title, start_date, end_date, is_all_day, is_featured, nullif(price, '') as price, coalesce(status, 'published') as status, website_url from {listings} where ord % 9 <> 4""")
def _(l, spark, d):
    """Store records of the listings, read back; some without a title."""
    from listwright.schema import conform

    made = conform(l).select(record_name(F.col("source_id")).alias("record_name"), changes.record()["fields"].alias("f"), (F.substring_index("source_id", ":", -1).cast("long") % 9 == 4).alias("untitled"))
    records = made.select("record_name", F.col("f").withField("title", F.when(~F.col("untitled"), F.col("f.title"))).alias("fields"))
    return apis.read_records(records).select("source_id", "title", "start_date", "end_date", "is_all_day", "is_featured", "price", "status", "website_url")
