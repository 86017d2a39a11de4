"""Queries of text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import price, text, urls
from listwright.operators.categorize import categorize
from listwright.queries.registry import LISTINGS, query, table

_CITY = "|".join(text.LEADING_CITIES)
NORM = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{c}}), '\s*\([^)]*\)', '', 'g'), '\s+(?:in|at)\s+[\w\s]+$', ''),
  '^(?:{_CITY})\s+', ''), '\s+20\d{{{{2}}}}$', ''), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"""

# Rules made of words that these tables hold.
RULES = [("Alpha", ["tion", "the "]), ("Beta", ["und ", "keit"]), ("Gamma", [" de ", "aux"]), ("Delta", ["ción", "mente"])]


def _points(words: list[str]) -> str:
    return " + ".join(f"case when contains(lower(title), '{w}') then 3 when contains(lower(description), '{w}') then 1 else 0 end" for w in words)


@query("categorize", "with s as (select source_id, " + ", ".join(f"({_points(w)}) as s{i}" for i, (_, w) in enumerate(RULES)) + " from {listings}) select source_id, case when greatest(s0, s1, s2, s3) = 0 then 'Other' when s0 >= greatest(s1, s2, s3) then 'Alpha' when s1 >= greatest(s2, s3) then 'Beta' when s2 >= s3 then 'Gamma' else 'Delta' end as category from s")
def _(l, spark, d):
    return l.select("source_id", categorize(F.col("title"), F.col("description"), RULES).alias("category"))


@query("normal_title", f"select source_id, {NORM.format(c='title')} as norm from {{listings}}")
def _(l, spark, d):
    return l.select("source_id", text.normal_title(F.col("title")).alias("norm"))


@query("dedup_key", f"select source_id, concat(substr(start_date, 1, 10), ':', regexp_replace(lower(city), '\\s+', '', 'g'), ':', {NORM.format(c='title')}) as key from {{listings}}")
def _(l, spark, d):
    return l.select("source_id", text.dedup_key(F.col("title"), F.col("start_date"), F.col("city")).alias("key"))


@query("clean_description", r"""select page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g')), 1, 500) as description from pages""")
def _(l, spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_description(F.col("html")).alias("description"))


@query("record_name", "select source_id, regexp_replace(source_id, '[^a-zA-Z0-9_-]', '_', 'g') as record_name from {listings}")
def _(l, spark, d):
    return l.select("source_id", text.record_name(F.col("source_id")).alias("record_name"))


@query("slug", "select source_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) as slug from {listings}")
def _(l, spark, d):
    return l.select("source_id", text.slug(F.col("title")).alias("slug"))


@query("text_hash", """select source_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(source_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as hash from {listings}""")
def _(l, spark, d):
    return l.select("source_id", text.text_hash(F.col("source_id")).alias("hash"))


@query("city_of_address", "select source_id, case when address is not null then 'Irvine' end as place from {listings}")
def _(l, spark, d):
    return l.select("source_id", text.city_of_address(F.col("address")).alias("place"))


_NOTES = ("Tickets $12.50 - $20", "Free parking, entry $5", "It is FREE for all", "suggested  donation", "no charge", "")


@query("extract_price", rf"""with t as (select source_id, concat(description, ' ', case ord % 6 {' '.join(f"when {i} then '{n}'" for i, n in enumerate(_NOTES))} end) as note from {{listings}})
select source_id, case when note = '' then null when (regexp_matches(note, '{price.FREE}') and not regexp_matches(note, '{price.NOT_FREE}')) or regexp_matches(note, '{price.FREE_TOO}') then 'Free'
  when regexp_matches(note, '{price.INCLUDED}') then 'Included with admission'
  when regexp_extract(note, '{price.DOLLARS}', 2) <> '' then concat('$', regexp_extract(note, '{price.DOLLARS}', 1), ' - $', regexp_extract(note, '{price.DOLLARS}', 2))
  when regexp_extract(note, '{price.DOLLARS}', 1) <> '' then concat('$', regexp_extract(note, '{price.DOLLARS}', 1))
  when regexp_matches(note, '{price.SUGGESTED}') then 'Suggested donation' when regexp_matches(note, '{price.DONATION}') then 'Donation' end as price from t""")
def _(l, spark, d):
    """Prices in whole descriptions, each with a note at its end."""
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("ord") % 6 + 1).cast("int"))
    return l.select("source_id", price.extract(F.concat(F.coalesce("description", F.lit("")), F.lit(" "), note)).alias("price"))


@query("page_image", """select page_id, case page_id % 3 when 0 then concat('https://i.example.org/', cast(page_id as varchar), '.png') when 1 then 'https://t.example.org/t.png'
  else nullif(regexp_extract(html, '(?i)<meta[^>]*og:image"[^>]*content="([^"]+)"', 1), '') end as image from pages""")
def _(l, spark, d):
    own = F.concat(F.lit('<meta content="https://i.example.org/'), F.col("page_id").cast("string"), F.lit('.png" property="og:image">'))
    head = F.when(F.col("page_id") % 3 == 0, own).when(F.col("page_id") % 3 == 1, "<META property='twitter:image' data-x='1' content='https://t.example.org/t.png'/>").otherwise("")
    return table(spark, d, "pages").select("page_id", urls.page_image(F.concat(head, F.col("html"))).alias("image"))


@query("url_predicates", """select source_id, coalesce(contains(image_url, 'unsplash.com') and image_url like 'https://%', false) as stock, coalesce(contains(external_url, 'google.com/search'), false) as search,
  nullif(regexp_extract(external_url, '^https?://([^/]+)', 1), '') as host from {listings}""")
def _(l, spark, d):
    return l.select("source_id", urls.host_contains(F.col("image_url"), urls.STOCK).alias("stock"), urls.is_search(F.col("external_url")).alias("search"), urls.host(F.col("external_url")).alias("host"))


@query("parse_times", """select source_id, lpad(((ord % 12) + case when ord % 24 >= 12 then 12 else 0 end)::varchar, 2, '0') || ':' || lpad((ord % 60)::varchar, 2, '0') as clock from {listings}""")
def _(l, spark, d):
    o = F.col("ord")
    hour = F.when(o % 12 == 0, 12).otherwise(o % 12)
    note = F.concat(F.lit("from "), hour.cast("string"), F.lit(":"), F.lpad((o % 60).cast("string"), 2, "0"), F.when(o % 24 >= 12, " PM").otherwise("a"))
    return l.select("source_id", text.parse_time(note).alias("clock"))


@query("clean_tags", "select source_id, lower(category) as tags from {listings}")
def _(l, spark, d):
    return l.select("source_id", F.array_join(text.clean_tags(F.col("tags"), ["Family", "scraped"]), ",").alias("tags"))


@query("content_hash", "select source_id, substr(sha256(concat_ws('|', title, description, start_date, coalesce(end_date, ''), category, coalesce(location_name, ''), city)), 1, 16) as hash from {listings}")
def _(l, spark, d):
    from listwright.operators.changes import content_hash

    return l.select("source_id", content_hash().alias("hash"))


__all__ = ["LISTINGS", "NORM"]
