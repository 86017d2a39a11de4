"""Predicates on URLs by their host; an invalid URL satisfies none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of stock pictures.
STOCK = ("unsplash.com", "images.pexels.com")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_contains(url: Column, names) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (host(url).contains(n) for n in names), F.lit(False)), F.lit(False))


def is_search(url: Column) -> Column:
    return F.coalesce(url.contains("google.com/search"), F.lit(False))


def resolve(url: Column, base: Column) -> Column:
    """An absolute URL for a link on the page `base`."""
    origin = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(url.rlike("^https?://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(origin, url)).otherwise(F.concat(F.regexp_extract(base, r"^(.*/)", 1), url))


#: Names under which a page declares its picture for sharing, best first.
PICTURES = ("og:image", "twitter:image")


def page_image(html: Column) -> Column:
    """The picture that a page declares for sharing: its meta tags by property or name, whatever the order of their attributes."""
    value = lambda tag, name: F.nullif(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]+>"), F.lit(0))
    named = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(value(t, "property"), value(t, "name"))).alias("name"), value(t, "content").alias("content")))

    def picture(name: str) -> Column:
        return F.get(F.filter(named, lambda m: (m["name"] == name) & m["content"].isNotNull()), F.lit(0))["content"]

    return F.coalesce(*map(picture, PICTURES))
