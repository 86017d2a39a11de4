"""Enrichment from tables: venues, gazetteer, pages, pictures, verdicts, caches.

External services stand behind tables: what a service would answer is a row keyed by what it was
asked, so that runs give equal results.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import geo, urls
from listwright.functions.text import search_url
from listwright.schema import or_else, present


def venue_lookup(df: DataFrame, venues: DataFrame, word: str = "library") -> DataFrame:
    """df with venue_url, the first match of: equal name; the word and a name within the venue's; either name in the other.

    venues (place, name, url) is a dimension.  Each distinct venue name of df is looked up once.
    """
    names = df.filter(present("location_name")).select(F.lower(F.trim("location_name")).alias("v")).distinct()
    table = venues.select("place", F.lower("name").alias("name"), "url")
    either = F.col("v").contains(F.col("name")) | F.col("name").contains(F.col("v"))
    stage = F.when(F.col("v") == F.col("name"), 0).when(F.col("v").contains(word) & F.col("v").contains(F.col("name")), 1).otherwise(2)
    best = names.join(table, either).groupBy("v").agg(F.min_by("url", F.struct(stage, F.col("place"))).alias("venue_url"))
    return df.withColumn("v", F.lower(F.trim("location_name"))).join(best, "v", "left").drop("v")


def page_facts(df: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """df with the facts of its pages; of the distinct URLs, the first `most` in order of appearance are used."""
    first = df.filter(present("external_url")).groupBy("external_url").agg(F.min("ord").alias("seen")).orderBy("seen", "external_url").limit(most)
    return df.join(pages.join(first.select("external_url"), "external_url", "left_semi"), "external_url", "left")


def link_cascade(df: DataFrame, scraper_hosts: tuple[str, ...]) -> DataFrame:
    """external_url repaired: no links to scrapers, then the website, the venue's, a search."""
    website = F.when(~urls.host_contains(F.col("website_url"), scraper_hosts), F.nullif(F.col("website_url"), F.lit("")))
    own = F.when(~urls.host_contains(F.col("external_url"), scraper_hosts), F.nullif(F.col("external_url"), F.lit("")))
    found = F.coalesce(own, website, F.col("venue_url"), search_url(F.col("title"), F.col("location_name"), F.col("city")))
    return df.withColumns({"website_url": website, "external_url": found})


def location_queries() -> Column:
    """What to ask a gazetteer, best first."""
    q = lambda *c: F.when(present(c[0]), F.lower(F.concat_ws(", ", *[F.nullif(F.col(x), F.lit("")) for x in c])))
    return F.array_distinct(F.array_compact(F.array(q("location_name", "city"), q("address", "city"), q("location_name"), q("city"))))


def geocode(df: DataFrame, gazetteer: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """df with coordinates, where it has none, from the first query that the gazetteer (query, latitude, longitude) answers.

    Answers outside the metro's box (metro, min_lat, max_lat, min_lon, max_lon), widened by half a degree, don't count.
    """
    missing = df.filter(~geo.in_country(F.col("latitude"), F.col("longitude")))
    asked = missing.select("ord", "metro", F.posexplode(location_queries()).alias("pos", "query"))
    hits = asked.join(gazetteer.toDF("query", "g_lat", "g_lon"), "query")
    if bounds is not None:
        hits = hits.join(bounds, "metro").filter("g_lat between min_lat - 0.5 and max_lat + 0.5 and g_lon between min_lon - 0.5 and max_lon + 0.5")
    best = hits.groupBy("ord").agg(F.min_by(F.struct("g_lat", "g_lon"), "pos").alias("g"))
    ok = geo.in_country(F.col("latitude"), F.col("longitude"))
    placed = df.join(best, "ord", "left")
    return placed.withColumns({"latitude": F.when(ok, F.col("latitude")).otherwise(F.col("g.g_lat")), "longitude": F.when(ok, F.col("longitude")).otherwise(F.col("g.g_lon"))}).drop("g")


def rotate_images(df: DataFrame, images: DataFrame) -> DataFrame:
    """Listings without a picture get those of their category (category, place, url) in turn."""
    need = df.filter(~present("image_url")).select("ord", "category", (F.row_number().over(Window.partitionBy("category").orderBy("ord")) - 1).alias("i"))
    many = images.groupBy("category").agg(F.count("*").alias("n"))
    chosen = need.join(many, "category").withColumn("place", F.col("i") % F.col("n")).join(images, ["category", "place"]).select("ord", F.col("url").alias("_picture"))
    return df.join(chosen, "ord", "left").withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), F.col("_picture"), F.col("image_url"))).drop("_picture")


def verify(df: DataFrame, trusted: list[str], hosts: list[str], venues: list[str], verdicts: DataFrame) -> DataFrame:
    """df with status and layer: trusted source, proper link, known venue, or the verdict (plausible where there is none)."""
    link = present("external_url") & F.col("external_url").rlike("^https?://") & ~urls.is_search(F.col("external_url")) & ~urls.host_contains(F.col("external_url"), hosts)
    place = F.lower(F.concat_ws(" ", "title", "location_name", "description"))
    known = F.lit(False)
    for v in venues:
        known = known | place.contains(v.lower())
    judged = df.join(verdicts.select("source_id", "plausible"), "source_id", "left")
    layer = F.when(F.col("source").isin(trusted), "source").when(F.coalesce(link, F.lit(False)), "link").when(known, "venue").otherwise("verdict")
    status = F.when((F.col("layer") == "verdict") & ~F.coalesce("plausible", F.lit(True)), "draft").otherwise("published")
    return judged.withColumn("layer", layer).withColumn("status", status).drop("plausible")


def contradictions(df: DataFrame) -> DataFrame:
    """A priced `Free Movie` becomes `Other`; a free listing whose title names a price gets that price."""
    priced = present("price") & ~F.lower("price").isin("free") & (F.col("price") != "Included with admission")
    movie = (F.col("category") == "Free Movie") & (priced | F.trim("title").rlike(r"^\$\d"))
    in_title = F.coalesce(F.nullif(F.regexp_extract("title", r"\(\$(\d+(?:\.\d{2})?)\)", 1), F.lit("")), F.nullif(F.regexp_extract("title", r"^\$(\d+)", 1), F.lit("")))
    fixed = (F.lower("price") == "free") & in_title.isNotNull()
    return df.withColumns({"category": F.when(movie, "Other").otherwise(F.col("category")), "price": F.when(fixed, F.concat(F.lit("$"), in_title)).otherwise(F.col("price"))})


def fresh(cache: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """The newest entry of each key (key, cached_at, ord, ...) that isn't older than some days; of equally new ones, the first."""
    w = Window.partitionBy("key").orderBy(F.desc("cached_at"), "ord")
    live = cache.filter(F.col("cached_at") >= F.lit(now - timedelta(days=days)))
    return live.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def apply_cached(df: DataFrame, cache: DataFrame, categories: list[str], aggregators: list[str]) -> DataFrame:
    """What a model said of a listing (key = source_id): texts replace an aggregator's or missing ones, a category only a valid one."""
    c = cache.select(F.col("key").alias("source_id"), F.col("description").alias("m_description"), F.col("category").alias("m_category"), F.col("price").alias("m_price"))
    j = df.join(c, "source_id", "left")
    takes = F.col("source").isin(aggregators) | ~present("description")
    return j.withColumns({
        "description": F.when(takes & present("m_description"), F.col("m_description")).otherwise(F.col("description")),
        "category": F.when(F.col("m_category").isin(categories), F.col("m_category")).otherwise(F.col("category")), "price": or_else("price", "m_price"),
    }).drop("m_description", "m_category", "m_price")
