"""Coordinates for listings without them, by a cascade of questions to answer tables.

Two services stand behind tables: places (query, latitude, longitude, address, photo_url), which knows businesses,
and streets (query, latitude, longitude), which knows addresses; of equal queries, compared in lower case, one row is used.
Listings that say the same of their place are asked for once, in the words of the first of them.  All questions
of a place are ranked; each meets the answers in one join, and of those that are acceptable the
best ranked counts.  So the work is one shuffle of the distinct places' questions, at most eleven for each.

Strategies, best first: 0 places (name and address, name, venue in the title, title; then the name in the
metro's city), 1 address, 2 name in the metro's city, 3 address in the text, 4 venue in the title, 5 venue in the text, 6 city.
An answer is acceptable within the metro's box, widened by half a degree (any place, for a metro without a box);
one of places must also name the city, where that is known.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import rules
from listwright.functions import geo
from listwright.functions.text import trimmed
from listwright.schema import present

SLACK = 0.5
#: The rest of a place that a cascade finds.
FOUND = ("strategy", "asked")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(trimmed(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _some(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _joined(*parts: Column) -> Column:
    """Null if one is missing."""
    return F.concat(*[x for p in parts for x in (p, F.lit(", "))][:-1])


def _of_metro(table: dict[str, str], metro: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[metro]


def venue_in_title(title: Column) -> Column:
    """After `at`, after a word and a colon, or after a dash where it ends like a venue."""
    return F.coalesce(_found(title, rules.VENUE_AT), _found(title, rules.VENUE_COLON), _found(title, rules.VENUE_DASH))


def address_in_text(text: Column) -> Column:
    """The first street address, else the first city with state and ZIP code."""
    return F.coalesce(_found(text, rules.STREET_IN_TEXT), _found(text, rules.ZIP_IN_TEXT))


def is_generic(city: Column) -> Column:
    return F.coalesce(F.lower(F.trim(city)).isin(rules.GENERIC_CITIES), F.lit(False))


def city_in_title(title: Column) -> Column:
    """The first of the known cities that begins the title, or follows the start, at, in or a dash."""

    def stands(city: str) -> Column:
        name = r"\s+".join(map(re.escape, city.lower().split()))
        return F.lower(title).rlike(rf"(?:^|\bat\b|\bin\b|\s[-–]\s)\s*{name}")

    return F.coalesce(*[F.when(stands(c), F.lit(c)) for c in rules.TITLE_CITIES])


def city_of_answer(address: Column) -> Column:
    """The first part of an answer's address, of three or more, that is no street, ZIP code, state or country."""
    parts = F.filter(F.transform(F.split(address, ", "), lambda p: F.trim(p)), lambda p: p != "")
    other = lambda p: p.rlike(r"^\d") | p.rlike(r"^[A-Z]{2}(\s+\d{5}|$)") | F.lower(p).isin(rules.STATE_NAMES) | p.isin("USA", "United States")
    return F.when(F.size(parts) >= 3, F.get(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~other(p)), F.lit(0)))


def _question(strategy: int, service: str, query: Column, city: Column | None = None, address: Column | None = None) -> Column:
    """A question, and what an answer must name; null for a query that misses a part."""
    none = F.lit(None).cast("string")
    return F.when(query.isNotNull(), F.struct(
        F.lit(strategy).alias("strategy"), F.lit(service).alias("service"), query.alias("query"), (none if city is None else city).alias("city"), (none if address is None else address).alias("address"),
    ))


def questions(df: DataFrame) -> DataFrame:
    """df with questions, an array of what to ask for a listing, best first."""
    city, name, title = _some("city"), _some("location_name"), F.col("title")
    df = df.withColumns({
        "_city": F.when(city.isNull() | is_generic(city), F.coalesce(city_in_title(title), city)).otherwise(city), "_metro": F.coalesce(_of_metro(rules.METRO_CITIES, F.col("metro")), F.col("city")),
        "_title": venue_in_title(title), "_street": address_in_text(F.coalesce("description", F.lit(""))), "_text": _found(F.coalesce("description", F.lit("")), rules.VENUE_IN_TEXT),
    })
    own, metro_city, in_title, street = F.col("_city"), F.col("_metro"), F.col("_title"), F.col("_street")
    df = df.withColumn("_at", F.coalesce(F.concat(own, F.lit(", CA")), metro_city))
    specific, named, elsewhere = F.col("_at"), F.when(~is_generic(own), own), F.coalesce(F.col("_at") != metro_city, F.lit(False))
    places = lambda q: _question(0, "places", q, F.when(F.coalesce(elsewhere & q.endswith(metro_city), F.lit(False)), None).otherwise(named))
    with_city = lambda a: F.when(a.isNotNull(), F.concat_ws(", ", a, city))
    ranked = F.array_compact(F.array(
        places(_joined(name, _some("address"), specific)), places(_joined(name, specific)), places(F.when(in_title.isNotNull() & ~in_title.eqNullSafe(name), _joined(in_title, specific))),
        places(_joined(title, specific)), places(F.when(elsewhere, _joined(name, metro_city))),
        _question(1, "streets", with_city(F.when(F.length("address") > 5, F.col("address")))), _question(2, "streets", _joined(F.when(F.length(name) > 2, name), metro_city)),
        _question(3, "streets", with_city(street), address=street), _question(4, "streets", _joined(in_title, metro_city)), _question(5, "streets", _joined(F.col("_text"), metro_city)),
        _question(6, "streets", F.when(F.length(city) > 2, F.concat_ws(", ", city, _of_metro(rules.METRO_STATES, F.col("metro"))))),
    ))
    return df.withColumn("questions", ranked).drop("_city", "_metro", "_title", "_street", "_text", "_at")


def within(metro: Column, lat: Column, lon: Column, boxes: dict[str, tuple[float, float, float, float]] = rules.METRO_BOXES) -> Column:
    """In the metro's box, widened; true for a metro without one."""
    inside = [F.when(metro == m, lat.between(a - SLACK, b + SLACK) & lon.between(c - SLACK, d + SLACK)) for m, (a, b, c, d) in boxes.items()]
    return F.coalesce(*inside, F.lit(True))


def _best(asked: DataFrame, answers: DataFrame, key: str, acceptable: Column) -> DataFrame:
    """(key, g): the best ranked acceptable answer; asked: (key, metro, pos, q)."""
    wanted = asked.select(key, "metro", "pos", "q", F.col("q.service").alias("service"), F.lower("q.query").alias("query"))
    hits = wanted.join(answers, ["service", "query"]).filter(acceptable)
    answer = F.struct("latitude", "longitude", F.coalesce("q.address", "found_address").alias("address"), "photo_url", F.col("q.strategy").alias("strategy"), F.col("q.query").alias("asked"))
    return hits.groupBy(key).agg(F.min_by(answer, "pos").alias("g"))


def _answers(places: DataFrame | None, streets: DataFrame) -> DataFrame:
    """(service, query, latitude, longitude, found_address, photo_url), one for each service and query."""
    none = F.lit(None).cast("string")
    rows = streets.select(F.lit("streets").alias("service"), F.lower("query").alias("query"), "latitude", "longitude", none.alias("found_address"), none.alias("photo_url"))
    if places is not None:
        rows = rows.unionByName(places.select(F.lit("places").alias("service"), F.lower("query").alias("query"), "latitude", "longitude", F.col("address").alias("found_address"), "photo_url"))
    values = F.struct("latitude", "longitude", "found_address", "photo_url")
    return rows.filter("latitude is not null and longitude is not null").groupBy("service", "query").agg(F.min(values).alias("a")).select("service", "query", "a.*")


def cascade(df: DataFrame, places: DataFrame | None, streets: DataFrame) -> DataFrame:
    """(at, latitude, longitude, address, photo_url, strategy, asked) for each place of listings without coordinates that an answer was found for."""
    facts = ("title", "description", "location_name", "address", "city", "metro")
    missing = df.filter(~geo.in_country(F.col("latitude"), F.col("longitude"))).withColumn("at", place_key())
    firsts = missing.groupBy("at").agg(F.min_by(F.struct(*facts), "ord").alias("f")).select("at", "f.*")
    asked = questions(firsts).select("at", "metro", F.posexplode("questions").alias("pos", "q"))
    if places is None:
        asked = asked.filter(F.col("q.service") == "streets")
    right_city = F.col("q.city").isNull() | ~present("found_address") | F.lower("found_address").contains(F.lower("q.city"))
    ok = F.coalesce(right_city, F.lit(True)) & within(F.col("metro"), F.col("latitude"), F.col("longitude"))
    return _best(asked, _answers(places, streets), "at", ok).select("at", "g.*")


def place_key() -> Column:
    """What a listing says of its place."""
    return F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("location_name", "address", "city", "metro")]))


def locate(df: DataFrame, places: DataFrame | None, streets: DataFrame) -> DataFrame:
    """df with what the cascade found for listings without coordinates, and strategy and asked.

    All listings of a place get its coordinates.  An address is filled where there is none; a generic city becomes that
    of the answer's address; the place's photo is taken where there is neither a picture nor a page of the event.
    Coordinates that are wrong and weren't replaced go.
    """
    found = cascade(df, places, streets).select("at", F.struct("latitude", "longitude", "address", "photo_url").alias("g"), *FOUND)
    ok = geo.in_country(F.col("latitude"), F.col("longitude"))
    out = df.withColumn("at", F.when(~ok, place_key())).join(found, "at", "left").drop("at")
    hit, g = F.col("g").isNotNull(), lambda n: F.col(f"g.{n}")
    page = present("website_url")
    for name in rules.NO_EVENT_PAGES:
        page = page & ~F.col("website_url").contains(name)
    city = F.coalesce(F.when(is_generic(F.coalesce("city", F.lit(""))), city_of_answer(g("address"))), F.col("city"))
    photo = F.when(~present("image_url") & ~F.coalesce(page, F.lit(False)), g("photo_url"))
    own = lambda n: F.when(hit, g(n)).when(ok | F.col("latitude").isNull() | F.col("longitude").isNull(), F.col(n))
    return out.withColumns({
        "latitude": own("latitude"), "longitude": own("longitude"), "city": F.when(hit, city).otherwise(F.col("city")),
        "address": F.when(present("address"), F.col("address")).otherwise(F.coalesce(g("address"), F.col("address"))), "image_url": F.coalesce(photo, F.col("image_url")),
    }).drop("g")


def venue_search(df: DataFrame, streets: DataFrame) -> DataFrame:
    """df (ord, location_name, description, metro) with found_latitude, found_longitude, found_address and strategy of a venue.

    Asked for are 1 an address in the text, 2 the name in the metro's city, 3 a venue in the text.  Any answer is acceptable.
    """
    text, name = F.coalesce("description", F.lit("")), _some("location_name")
    metro_city = F.coalesce(_of_metro(rules.METRO_CITIES, F.col("metro")), F.col("metro"))
    street = address_in_text(text)
    ranked = F.array_compact(F.array(
        _question(1, "streets", street, address=street), _question(2, "streets", _joined(F.when(F.length(name) > 2, name), metro_city)), _question(3, "streets", _joined(_found(text, rules.VENUE_HINT), metro_city)),
    ))
    asked = df.select("ord", "metro", F.posexplode(ranked).alias("pos", "q"))
    best = _best(asked, _answers(None, streets), "ord", F.lit(True))
    found = best.select("ord", F.col("g.latitude").alias("found_latitude"), F.col("g.longitude").alias("found_longitude"), F.col("g.address").alias("found_address"), F.col("g.strategy").alias("strategy"))
    return df.join(found, "ord", "left")
