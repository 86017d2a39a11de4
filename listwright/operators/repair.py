"""Repairs of listings that exist already: processing anew, propagation by link, patches, places of cities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import rules
from listwright.functions import geo, urls
from listwright.operators import changes
from listwright.schema import or_else, present


def _holds(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c.contains(p), F.lit(False)) for p in parts))


def keeps_picture() -> Column:
    """Whether a listing's picture stays when it is processed anew: neither stock nor another site's, and, where the listing
    has a page of its own, no photo of the place and none that an aggregator found."""
    own_page = present("website_url") & ~_holds(F.col("website_url"), rules.NO_EVENT_PAGES)
    weak = _holds(F.col("image_url"), rules.PLACE_PHOTOS) | F.col("source").isin(rules.AGGREGATORS)
    return present("image_url") & ~urls.host_contains(F.col("image_url"), rules.BORROWED_PICTURES) & ~(weak & own_page)


def reprocess(df: DataFrame) -> DataFrame:
    """Published listings as input of a new run: untrusted coordinates and pictures that may be bettered are dropped."""
    trusted = F.col("source").isin(rules.TRUSTED_PLACES)
    number = {c: F.when(trusted, F.nullif(F.col(c), F.lit(0.0))) for c in ("latitude", "longitude")}
    return df.withColumns({**number, "image_url": F.when(keeps_picture(), F.col("image_url"))})


def clear_invalid(df: DataFrame) -> DataFrame:
    """Without coordinates that are 0, 0 or outside the country."""
    valid = geo.in_country(F.col("latitude"), F.col("longitude"))
    return df.withColumns({c: F.when(valid, F.col(c)) for c in ("latitude", "longitude")})


def same_link(df: DataFrame, column: str, link: str = "external_url") -> DataFrame:
    """df with `column`, where it is missing, from the first row (by ord) of the same link that has it.

    The values are aggregated by link before the join, so that rows of one link need not meet in one task.
    """
    first = df.filter(present(link) & F.col(column).isNotNull()).groupBy(link).agg(F.min_by(column, "ord").alias("_found"))
    return df.join(first, link, "left").withColumn(column, F.coalesce(column, "_found")).select(*df.columns)


def patch_pictures(table: DataFrame, patch: DataFrame) -> DataFrame:
    """The table with the pictures of patch (source_id, image_url); the largest of several for one id, nothing else changes."""
    one = patch.filter(present("image_url")).groupBy("source_id").agg(F.max("image_url").alias("_new"))
    return table.join(one, "source_id", "left").withColumn("image_url", F.coalesce("_new", "image_url")).select(*table.columns)


def missing_cities(df: DataFrame) -> DataFrame:
    """The cities to look up for listings without coordinates."""
    return df.filter(~geo.has_coordinates(F.col("latitude"), F.col("longitude")) & present("city")).select("city").distinct()


def on_map(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Listings with a place on the map: their own, else that of their city (city, latitude, longitude: a dimension); others go."""
    own = geo.has_coordinates(F.col("latitude"), F.col("longitude"))
    places = cities.groupBy("city").agg(F.min(F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("_at"))
    out = df.join(places, "city", "left").filter(own | F.col("_at").isNotNull())
    return out.withColumns({"latitude": F.when(own, F.col("latitude")).otherwise(F.col("_at.lat")), "longitude": F.when(own, F.col("longitude")).otherwise(F.col("_at.lon"))}).select(*df.columns)


def merged_run(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """What a run that merges metros publishes: unchanged rows as they were, new and changed ones as they come."""
    kinds = changes.diff(current, baseline)
    todo = kinds.filter(F.col("change_type").isin("new", "changed")).select("source_id")
    return changes.merge(kinds.filter("change_type = 'unchanged'").drop("change_type"), current.join(todo, "source_id", "left_semi"))


def classify_other(df: DataFrame, answers: DataFrame, valid: list[str]) -> DataFrame:
    """df with the category that answers (source_id, category) give listings of category Other, if it is a valid one."""
    one = answers.filter(F.col("category").isin(valid)).groupBy("source_id").agg(F.max("category").alias("_named"))
    return df.join(one, "source_id", "left").withColumn("category", F.when(F.col("category") == "Other", or_else("_named", "category")).otherwise(F.col("category"))).select(*df.columns)
