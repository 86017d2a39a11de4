"""Queries of places, wording and upkeep."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listwright import rules
from listwright.functions import places
from listwright.operators import app, clean, filters
from listwright.queries.registry import query

NOW = datetime(2024, 1, 13, 9, 30)
_LAST = "coalesce(cast(end_date as timestamp), cast(start_date as timestamp))"


def _venue(text: str) -> str:
    bounded, at, dash = (f"trim(regexp_extract({text}, '{p.replace(chr(39), chr(39) * 2)}', 1))" for p in (places.AT_UP_TO, places.AT, places.DASH))
    names = ", ".join(f"'{n}'" for n in places.NOT_VENUES)
    return "coalesce(" + ", ".join(f"case when length({x}) >= 3 and {x} not in ({names}) then {x} end" for x in (bounded, at)) + f", case when length({dash}) >= 3 then {dash} end)"


_TITLES = ("", " at Lido Hall on Friday", " - Town Green", " @ the Old Mill")


@query("venue_of", f"""with t as (select source_id, location_name, description, concat(title, case ord % 4 {' '.join(f"when {i} then '{t}'" for i, t in enumerate(_TITLES))} end) as title from {{listings}})
select source_id, coalesce(nullif(location_name, ''), {_venue('title')}, {_venue('substr(description, 1, 200)')}) as venue from t""")
def _(l, spark, d):
    title = F.concat("title", F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("ord") % 4 + 1).cast("int")))
    return l.select("source_id", places.venue_of(F.col("location_name"), title, F.col("description")).alias("venue"))


@query("city_in_title", r"""with t as (select source_id, case ord % 4 when 0 then concat('Long Beach ', title) when 1 then concat(title, ' in  dana point') when 2 then concat(title, ' - Irvine') else title end as t from {listings})
select source_id, case when regexp_matches(lower(t), '^dana\s+point|(\bat\b|\bin\b|\s[-–]\s)\s*dana\s+point') then 'Dana Point' when regexp_matches(lower(t), '^long\s+beach|(\bat\b|\bin\b|\s[-–]\s)\s*long\s+beach') then 'Long Beach'
  when regexp_matches(lower(t), '^irvine|(\bat\b|\bin\b|\s[-–]\s)\s*irvine') then 'Irvine' end as place from t""")
def _(l, spark, d):
    o = F.col("ord") % 4
    title = F.when(o == 0, F.concat(F.lit("Long Beach "), "title")).when(o == 1, F.concat("title", F.lit(" in  dana point"))).when(o == 2, F.concat("title", F.lit(" - Irvine"))).otherwise(F.col("title"))
    return l.select("source_id", places.city_in(title, ["Dana Point", "Long Beach", "Irvine"]).alias("place"))


_ADULT = (" - 21+ night", " (adults only)", " Wine Tasting", " Senior Center lunch", " story time", "", " 12 things to do")
_ANY_TITLE, _ANY_TEXT = ("|".join(f"(?:{p})" for p in x) for x in (rules.ADULT_TITLES, rules.ADULT_TEXTS))


@query("filter_adult", f"""select source_id from {{listings}} where not regexp_matches(concat(title, case ord % 7 {' '.join(f"when {i} then '{t}'" for i, t in enumerate(_ADULT))} end), '(?i){_ANY_TITLE}') and not regexp_matches(coalesce(description, ''), '(?i){_ANY_TEXT}')
  and not (source = 'src1' and ord % 5 = 1)""")
def _(l, spark, d):
    """The rule tables on whole titles, each with a phrase at its end; listings of one source stand in for those of comedy clubs."""
    title = F.concat("title", F.element_at(F.array(*map(F.lit, _ADULT)), (F.col("ord") % 7 + 1).cast("int")))
    club = F.when(F.col("ord") % 5 == 1, "The Laugh Factory Stage").otherwise(F.col("location_name"))
    source = F.when(F.col("source") == "src1", "yelp").otherwise(F.col("source"))
    return filters.family_friendly(l.withColumns({"title": title, "location_name": club, "source": source}).withColumn("description", F.coalesce("description", F.lit("")))).select("source_id")


@query("display_city", "select source_id, case when ord % 2 = 0 and address is not null then 'Irvine' when ord % 2 = 0 then 'OC' else city end as place, concat_ws(', ', nullif(location_name, ''), nullif(address, ''), nullif(city, '')) as directions from {listings}")
def _(l, spark, d):
    city = F.when(F.col("ord") % 2 == 0, "OC").otherwise(F.col("city"))
    return l.select("source_id", places.display_city(city, F.col("address")).alias("place"), places.directions(F.col("location_name"), F.col("address"), F.col("city")).alias("directions"))


@query("other_metro", """select source_id, contains(lower(concat_ws(' ', city, location_name, address, description)), 'hall 5') or contains(lower(concat_ws(' ', city, location_name, address, description)), 'irvine')
  or coalesce(latitude <> 0 and longitude <> 0 and pow(latitude - 33.6846, 2) + pow(longitude + 117.8265, 2) < pow(latitude - 34.0522, 2) + pow(longitude + 118.2437, 2) and longitude > -118.1 and longitude < -117.3, false) as moves from {listings}""")
def _(l, spark, d):
    return l.select("source_id", places.other_metro(["hall 5", "irvine"], (34.0522, -118.2437), (33.6846, -117.8265), -118.1, -117.3).alias("moves"))


@query("image_query", """select source_id, case when regexp_matches(category, '(?i)movie|film') then 'outdoor movie night' when category = 'Music' then 'live music' else concat(category, ' day kids family') end as q from {listings}""")
def _(l, spark, d):
    title = F.concat("category", F.lit(" day 2026 ($5)"))
    return l.select("source_id", places.image_query(title, F.col("category"), [("movie|film", "outdoor movie night")], {"Music": "live music"}).alias("q"))


@query("age_text", """with a as (select source_id, (ord % 200)::int as m from {listings}) select source_id, case when m < 12 then concat(m, ' mo') when m < 24 then concat('1 yr ', m - 12, ' mo') else concat(m // 12, ' yrs') end as age from a""")
def _(l, spark, d):
    today = F.lit("2024-01-01").cast("date")
    return l.select("source_id", places.age_text(F.add_months(today, -(F.col("ord") % 200).cast("int")), today).alias("age"))


@query("clean_titles", r"""select source_id, case when source in ('src0', 'src3') then trim(title) else concat(title, ' (Member coupon!) - free for members only') end as title from {listings}""")
def _(l, spark, d):
    noisy = l.withColumn("title", F.concat("title", F.lit(" (Member coupon!) - free for members only")))
    return clean.clean(noisy, ["src0", "src3"], ["nowhere.example"], [], ["coupon", "members"]).select("source_id", "title")


@query("clean_texts", r"""select source_id, case when source = 'src0' then 'Fun for all. Bring food!' else '  Fun for all .  Find more on nowhere.example today! Bring food!' end as description from {listings}""")
def _(l, spark, d):
    noisy = l.withColumn("description", F.lit("  Fun for all .  Find more on nowhere.example today! Bring food!"))
    split = noisy.withColumn("description", F.when(F.col("source") == "src0", "Fun for all. Find more on nowhere,example today! Bring  food!").otherwise(F.col("description")))
    return clean.clean(split, ["src0"], ["nowhere,example"], [], ["coupon"]).select("source_id", "description")


@query("brief_texts", """with h as (select *, abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(source_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 3 as i from {listings})
select source_id, case i when 0 then concat('See ', category, ' in ', city) when 1 then concat(city, ': ', category) else concat(category, '!') end as text from h""")
def _(l, spark, d):
    return l.select("source_id", clean.brief(["See {label} in {city}", "{city}: {label}", "{label}!"], F.col("category")).alias("text"))


@query("favourites_toggle", "select source_id from {listings} where (ord % 2 = 0) <> (ord % 3 = 0)")
def _(l, spark, d):
    return app.toggle(l.filter("ord % 2 = 0").select("source_id"), l.filter("ord % 3 = 0").select("source_id"))


@query("favourite_listings", "select source_id, title from {listings} where ord % 7 = 0")
def _(l, spark, d):
    return app.favourite_listings(l, l.filter("ord % 7 = 0").select("source_id")).select("source_id", "title")


@query("pending_suggestions", """with s as (select ord as id, start_date as created_at, nullif(city, 'fr') as city, status from {listings} order by start_date desc, ord limit 100)
select id from s where city is not null and (status is null or status not in ('rejected', 'approved'))""")
def _(l, spark, d):
    s = l.select(F.col("ord").alias("id"), F.col("start_date").alias("created_at"), "title", "description", F.when(F.col("city") != "fr", F.col("city")).alias("city"), "start_date", "status")
    return app.pending(s).select("id")


@query("approve_suggestions", "select concat('suggestion:', cast(ord as varchar)) as source_id, case when category in ('Music', 'Craft') then category else 'Other' end as category from {listings} where ord % 5 = 1")
def _(l, spark, d):
    s = l.drop("source_id", "source").withColumnRenamed("ord", "id")
    made, _reviewed = app.approve(s, s.filter("id % 5 = 1"), ["Music", "Craft"], NOW)
    return made.select("source_id", "category")


@query("access", """select user_id, arg_min(event_type, event_id) filter (event_type in ('purchase', 'click')) as product, count(*) filter (event_type in ('purchase', 'click')) > 0 or cast(user_id as varchar) = '3' as has_access from events group by 1""")
def _(l, spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_type").alias("product"), F.col("event_id").alias("ord"))
    return app.access(e, ["purchase", "click"], ["3"])


@query("expired_go", f"select source_id from {{listings}} where not ({_LAST} < timestamp '2024-01-13')")
def _(l, spark, d):
    return app.without_expired(l, NOW).select("source_id")


@query("locked", "select source_id, cast(start_date as date) > date '2024-01-14' as locked from {listings}")
def _(l, spark, d):
    return l.select("source_id", app.locked(F.col("start_date"), NOW).alias("locked"))


@query("form_rows", "select source_id, case when ord % 2 = 0 then 'a,b' else '' end as tags, case when ord % 3 = 0 then null else 33.5::double end as latitude from {listings}")
def _(l, spark, d):
    tags = F.when(F.col("ord") % 2 == 0, " a, ,b ").otherwise(F.lit(""))
    f = app.from_form(F.col("title"), tags, F.when(F.col("ord") % 3 == 0, "x").otherwise(F.lit(" 33.5 ")), F.lit(""))
    return l.select("source_id", F.array_join(f["tags"], ",").alias("tags"), f["latitude"].alias("latitude"))
