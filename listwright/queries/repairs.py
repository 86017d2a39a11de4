"""Queries of repairs, rule filters and what administrators see."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright import rules
from listwright.operators import filters, repair, views
from listwright.queries.registry import query

_SERVICE = "|".join(f"(?:{p})" for p in rules.RELIGIOUS).replace("'", "''")
_MEETUP = "|".join(f"(?:{p})" for p in rules.MEETUPS)
_PHRASES = ("", " Sunday  service", " men's breakfast", " Bible studies", " picnic")
_MEETS = ("", " UYE brunch", " uye brunch", " Yelp big Lunch", " lunch with Ada", " Nextdoor meetup")


def _said(phrases: tuple[str, ...]):
    return F.concat("title", F.element_at(F.array(*map(F.lit, phrases)), (F.col("ord") % len(phrases) + 1).cast("int")))


def _says(phrases: tuple[str, ...]) -> str:
    cases = " ".join("when {} then '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(phrases))
    return f"concat(title, case ord % {len(phrases)} {cases} end)"


@query("filter_religious", f"select source_id from {{listings}} where not regexp_matches(concat_ws(' ', {_says(_PHRASES)}, description), '(?i){_SERVICE}')")
def _(l, spark, d):
    return l.filter(~filters.religious(_said(_PHRASES), F.col("description"))).select("source_id")


@query("filter_meetups", f"select source_id from {{listings}} where not regexp_matches({_says(_MEETS)}, '{_MEETUP.replace('(?:(?i)', '(?i:')}')")
def _(l, spark, d):
    return l.filter(~filters.meetup(_said(_MEETS))).select("source_id")


_HOST = "lower(regexp_extract(image_url, '^https?://([^/:?#]+)', 1))"
_OWN = "coalesce(website_url, '') <> '' and " + " and ".join(f"not contains(website_url, '{h}')" for h in rules.NO_EVENT_PAGES)
_WEAK = "(" + " or ".join(f"contains(image_url, '{h}')" for h in rules.PLACE_PHOTOS) + " or source in ('mommypoppins'))"
_REPROCESS = "(select * replace (case ord % 3 when 0 then 'yelp' when 1 then 'mommypoppins' else source end as source, case when ord % 6 = 5 then 'https://lh3.googleusercontent.com/places/x' else image_url end as image_url, case ord % 4 when 0 then 'https://own.example.org/e' when 1 then 'https://www.google.com/search?q=x' else website_url end as website_url) from {listings})"


@query("reprocess", f"""select source_id, case when source = 'yelp' then nullif(latitude, 0) end as latitude, case when coalesce(image_url, '') <> '' and not ({' or '.join(f"contains({_HOST}, '{h}')" for h in rules.BORROWED_PICTURES)})
  and not ({_WEAK} and {_OWN}) then image_url end as image_url from {_REPROCESS}""")
def _(l, spark, d):
    o = F.col("ord")
    seen = l.withColumns({
        "source": F.when(o % 3 == 0, "yelp").when(o % 3 == 1, "mommypoppins").otherwise(F.col("source")), "image_url": F.when(o % 6 == 5, "https://lh3.googleusercontent.com/places/x").otherwise(F.col("image_url")),
        "website_url": F.when(o % 4 == 0, "https://own.example.org/e").when(o % 4 == 1, "https://www.google.com/search?q=x").otherwise(F.col("website_url")),
    })
    return repair.reprocess(seen).select("source_id", "latitude", "image_url")


@query("clear_invalid", "select source_id, case when latitude between 24 and 50 and longitude between -130 and -65 then latitude end as latitude from {listings}")
def _(l, spark, d):
    return repair.clear_invalid(l).select("source_id", "latitude")


@query("same_link", """with f as (select external_url, min_by(price, ord) as found from {listings} where external_url <> '' and price is not null group by 1)
select l.source_id, coalesce(l.price, f.found) as price from {listings} left join f on f.external_url = l.external_url""")
def _(l, spark, d):
    return repair.same_link(l, "price").select("source_id", "price")


@query("patch_pictures", "select source_id, case when ord % 3 = 0 then concat('https://new.example.org/', ord) else image_url end as image_url from {listings}")
def _(l, spark, d):
    patch = l.filter("ord % 3 = 0").select("source_id", F.concat(F.lit("https://new.example.org/"), F.col("ord").cast("string")).alias("image_url"))
    return repair.patch_pictures(l, patch.unionByName(patch)).select("source_id", "image_url")


@query("missing_cities", "select distinct city from {listings} where city <> '' and (latitude is null or (latitude = 0 and longitude = 0))")
def _(l, spark, d):
    return repair.missing_cities(l)


@query("on_map", """with c as (select city, min(latitude) as lat, min(longitude) as lon from {listings} where latitude <> 0 and city in ('en', 'de') group by 1)
select l.source_id, case when l.latitude <> 0 then l.latitude else c.lat end as latitude, case when l.latitude <> 0 then l.longitude else c.lon end as longitude from {listings} left join c on c.city = l.city where l.latitude <> 0 or c.city is not null""")
def _(l, spark, d):
    cities = l.filter("latitude <> 0 and city in ('en', 'de')").groupBy("city").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    return repair.on_map(l, cities).select("source_id", "latitude", "longitude")


@query("merged_run", "select source_id, case when ord % 5 = 0 then concat('New ', title) else title end as title, case when ord % 5 = 0 or ord % 3 = 1 then '$1' else price end as price from {listings} where ord % 4 <> 0")
def _(l, spark, d):
    """Three quarters of the listings again: a fifth with new titles, a third unknown to the baseline, all with another price, which alone changes nothing."""
    current = l.filter("ord % 4 <> 0").withColumns({"title": F.when(F.col("ord") % 5 == 0, F.concat(F.lit("New "), "title")).otherwise(F.col("title")), "price": F.lit("$1")})
    return repair.merged_run(current, l.filter("ord % 3 <> 1")).select("source_id", "title", "price")


@query("classify_other", "select source_id, case when category = 'Other' and ord % 2 = 1 then 'Music' else category end as category from {listings}")
def _(l, spark, d):
    answers = l.select("source_id", F.when(F.col("ord") % 2 == 1, "Music").otherwise("Nothing").alias("category"))
    return repair.classify_other(l, answers, ["Music", "Craft"]).select("source_id", "category")


@query("admin_list", "select source_id, start_date from {listings} where metro = 'orange-county' and source = 'src1' and (contains(lower(title), 'the') or contains(lower(city), 'the') or contains(lower(description), 'the')) order by start_date desc, ord")
def _(l, spark, d):
    return views.admin_list(l, "orange-county", "src1", "The").select("source_id", "start_date")


_CLOCK = "strftime(cast({} as timestamp), '%-I:%M %p')"


@query("date_texts", f"""select source_id, case when is_all_day then strftime(cast(start_date as timestamp), '%b %-d, %Y') else strftime(cast(start_date as timestamp), '%b %-d, %Y at %-I:%M %p') end as day,
  case when is_all_day then 'All Day' else concat_ws(' - ', {_CLOCK.format('start_date')}, {_CLOCK.format('end_date')}) end as hours from {{listings}}""")
def _(l, spark, d):
    return l.select("source_id", views.date_text().alias("day"), views.time_text().alias("hours"))


@query("month_steps", "select source_id, cast(cast(end_date as date) - interval 1 month as date) as before, cast(cast(end_date as date) + interval 1 month as date) as after from {listings}")
def _(l, spark, d):
    return l.select("source_id", views.month_steps(F.to_date("end_date")).alias("m")).select("source_id", "m.before", "m.after")
