"""Places named in titles and addresses, and labels made of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions import geo
from listwright.functions.text import trimmed
from listwright.schema import present

# Regions that are no city.
REGIONS = ("orange county", "los angeles", "los angeles county", "la", "oc", "southern california", "socal", "greater los angeles", "los angeles metro")
NOT_VENUES = ("Home", "No", "An", "Any", "This", "That", "Our", "Your", "All", "Each")
# How titles and texts name a place: after `at` up to a stop word or mark, after `at`, after a dash.
AT_UP_TO = r"(?:\bat|@)\s+(?:the\s+)?([A-Z][A-Za-z'’\-&. ]{2,50}?)(?:\s+(?:on|from|every|this|starting|for|with)\b|[,.!?]|$)"
AT = r"(?:\bat|@)\s+(?:the\s+)?([A-Z][A-Za-z'’\-&. ]{2,50})"
DASH = r"[–—\-]\s*([A-Z][A-Za-z'’\-&. ]{2,50})"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(trimmed(F.regexp_extract(text, pattern, 1)), F.lit(""))


def venue_in(text: Column) -> Column:
    """A place after `at` (up to a stop word or mark if there is one), else after a dash; null if none."""
    ok = lambda v: F.when((F.length(v) >= 3) & ~v.isin(*NOT_VENUES), v)
    dash = _found(text, DASH)
    return F.coalesce(ok(_found(text, AT_UP_TO)), ok(_found(text, AT)), F.when(F.length(dash) >= 3, dash))


def venue_of(location_name: Column, title: Column, description: Column) -> Column:
    """The place that is given, else named in the title, else in the first 200 characters of the text."""
    return F.coalesce(F.nullif(location_name, F.lit("")), venue_in(title), venue_in(F.substring(description, 1, 200)))


def city_in(title: Column, cities: list[str]) -> Column:
    """The first of the cities that begins the title, or stands after at, in or a dash."""
    def stands(c: str) -> Column:
        name = r"\s+".join(map(re.escape, c.lower().split()))
        return F.lower(title).rlike(rf"^{name}|(?:\bat\b|\bin\b|\s[-–]\s)\s*{name}")

    return F.coalesce(*[F.when(stands(c), F.lit(c)) for c in cities]) if cities else F.lit(None).cast("string")


def display_city(city: Column, address: Column) -> Column:
    """The city, or for a region the one that the address names."""
    parts = F.split(address, ", ")
    candidate = F.trim(F.get(parts, F.lit(1)))
    proper = (F.size(parts) >= 3) & (candidate != "") & ~candidate.isin("USA", "United States") & ~candidate.rlike(r"^[A-Z]{2}\s+\d{5}")
    return F.when(F.lower(city).isin(*REGIONS) & F.coalesce(proper, F.lit(False)), candidate).otherwise(city)


def directions(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def other_metro(names: list[str], here: tuple[float, float], there: tuple[float, float], west: float, east: float) -> Column:
    """Whether a listing belongs to the neighbouring metro: it names one of its places, or lies nearer to it in a band of longitudes."""
    text = F.lower(F.concat_ws(" ", "city", "location_name", "address", "description"))
    named = reduce(lambda a, b: a | b, (text.contains(n) for n in names), F.lit(False))
    lat, lon = F.col("latitude"), F.col("longitude")
    nearer = (lat != 0) & (lon != 0) & (geo.squared_degrees(lat, lon, *there) < geo.squared_degrees(lat, lon, *here)) & (lon > west) & (lon < east)
    return named | F.coalesce(nearer, F.lit(False))


def image_query(title: Column, category: Column, rules: list[tuple[str, str]], by_category: dict[str, str]) -> Column:
    """What to search pictures for: the first rule that the title meets, the category's words, or the bare title."""
    bare = title
    for p in (r"(?i)presents?:?\s*", r"\([^)]*\$[^)]*\)", r"\$\d+[\d.,]*", r"(?i)\b(the|a|an|at|in|on|for|and|of|with)\b", r"\b\d{4}\b"):
        bare = F.regexp_replace(bare, p, "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    choices = [F.when(title.rlike(f"(?i){p}"), F.lit(v)) for p, v in rules] + [F.when(category == c, F.lit(v)) for c, v in by_category.items()]
    return F.when(F.length(bare) >= 5, F.coalesce(*choices, F.substring(F.concat(bare, F.lit(" kids family")), 1, 60)))


def has_place(name: str = "location_name") -> Column:
    return present(name)


def age_text(birthday: Column, today: Column) -> Column:
    """Age as `n mo`, `1 yr n mo` or `n yrs`."""
    months = F.floor(F.months_between(today, birthday)).cast("int")
    years = F.floor(months / 12).cast("int")
    return F.when(months < 12, F.concat(months.cast("string"), F.lit(" mo"))).when(years == 1, F.concat(F.lit("1 yr "), (months - 12).cast("string"), F.lit(" mo"))).otherwise(F.concat(years.cast("string"), F.lit(" yrs")))
