"""Queries over captured pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.functions.text import strip_html
from listwright.functions import urls
from listwright.queries.registry import query, table
from listwright.sources import payloads


@query("page_links", r"""select distinct page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href=["'']([^"''#]+)["'']', 1)) as href from pages""")
def _(l, spark, d):
    return payloads.links(table(spark, d, "pages"))


@query("page_headings", r"""with h as (select page_id, regexp_extract_all(html, '(?is)(<h[1-4][^>]*>.*?</h[1-4]>)', 1) as a from pages), u as (select page_id, unnest(a) as h, generate_subscripts(a, 1) - 1 as pos from h)
select page_id, pos::int as pos, regexp_extract(h, '<h([1-4])', 1)::int as level, trim(replace(regexp_replace(h, '<[^>]+>', '', 'g'), '&amp;', '&')) as heading from u""")
def _(l, spark, d):
    return payloads.headings(table(spark, d, "pages"))


@query("page_text", r"""select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10), 'g'), '<[^>]+>', '', 'g'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\n{3,}', chr(10) || chr(10), 'g'), concat(' ', chr(10), chr(9)))) as digest from pages""")
def _(l, spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(strip_html(F.col("html")), 256).alias("digest"))


@query("page_hosts", "select regexp_extract(url, '^https?://([^/:]+)', 1) as host, count(*) as n from pages group by 1")
def _(l, spark, d):
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("carry_forward", """select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as asked from conversations""")
def _(l, spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


@query("look_ahead", "select conv_id, turn, lead(role, 1) over w as next_role, lead(length(text), 2) over w as later_length from conversations window w as (partition by conv_id order by turn)")
def _(l, spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("role", 1).over(w).alias("next_role"), F.lead(F.length("text").cast("long"), 2).over(w).alias("later_length"))


@query("seat_events", """select concat('seatgeek:', ord) as source_id, title, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(description, ''), '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '\\s+', ' ', 'g')), 1, 500) as description,
  start_date, city, location_name, latitude, longitude, case ord % 3 when 0 then 'https://i.example.org/huge.png' when 1 then 'https://i.example.org/large.png' end as image_url,
  case ord % 4 when 0 then '$12.5-$30' when 1 then '$12.5' when 2 then '$20' end as price, concat(category, ',live') as tags from {listings}""")
def _(l, spark, d):
    """Payloads made of the listings, one for each, and read back."""
    o, none = F.col("ord"), F.lit(None)
    picture = F.struct(F.when(o % 3 == 0, "https://i.example.org/huge.png").when(o % 3 == 2, "").alias("huge"), F.when(o % 3 < 2, "https://i.example.org/large.png").alias("large"))
    low, high = F.when(o % 4 < 2, 12.5).when(o % 4 == 2, 20.0).otherwise(0.0), F.when(o % 4 == 0, 30.0).when(o % 4 == 1, 12.5).otherwise(none.cast("double"))
    event = F.struct(
        o.cast("string").alias("id"), "title", "description", F.lit("https://seats.example.org").alias("url"), F.col("start_date").alias("datetime_local"), F.array(*[F.struct(x.alias("name")) for x in (F.col("category"), F.lit("live"))]).alias("taxonomies"),
        F.array(F.struct(picture.alias("images"))).alias("performers"), F.struct(low.alias("lowest_price"), high.alias("highest_price")).alias("stats"),
        F.struct(F.col("location_name").alias("name"), "city", "address", F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("location")).alias("venue"),
    )
    read = payloads.seat_events(l.select("ord", F.to_json(F.struct(F.array(event).alias("events"))).alias("payload")))
    return read.select("source_id", "title", "description", "start_date", "city", "location_name", "latitude", "longitude", "image_url", "price", F.array_join("tags", ",").alias("tags"))
