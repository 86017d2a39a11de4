"""The batch run: sources to published table, in full or against the last run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright import rules as fixed
from listwright.functions.text import clean_tags, decode_entities
from listwright.operators import changes, dedup, enrich, filters, locate
from listwright.operators.categorize import RULES, categorize


@dataclass
class Tables:
    """Dimension and answer tables of a run; a missing one skips its step."""

    venues: DataFrame | None = None
    places: DataFrame | None = None
    streets: DataFrame | None = None
    images: DataFrame | None = None
    verdicts: DataFrame | None = None
    cache: DataFrame | None = None
    edited: DataFrame | None = None


@dataclass
class Rules:
    categories: list[tuple[str, list[str]]] = field(default_factory=lambda: list(RULES))
    keep: Callable[[DataFrame], DataFrame] = filters.family_listings
    aggregators: list[str] = field(default_factory=lambda: list(fixed.AGGREGATORS))
    trusted: list[str] = field(default_factory=list)
    scraper_hosts: tuple[str, ...] = ("scraper.invalid",)
    unwanted_tags: list[str] = field(default_factory=list)


def screen(raw: DataFrame, rules: Rules, now: datetime) -> DataFrame:
    """Family listings from today on, entities in titles and texts decoded, with a category."""
    kept = rules.keep(raw).filter(~filters.stale(F.col("start_date"), now))
    kept = kept.withColumns({"title": decode_entities(F.col("title")), "description": decode_entities(F.col("description"))})
    return kept.withColumn("category", F.when(F.col("category").isin("", "Other"), categorize(F.col("title"), F.col("description"), rules.categories)).otherwise(F.col("category")))


def select(raw: DataFrame, rules: Rules, now: datetime) -> DataFrame:
    """screen, resolved to one row for each entity."""
    return dedup.greedy(screen(raw, rules, now)).drop("place")


def improve(df: DataFrame, t: Tables, rules: Rules, now: datetime) -> DataFrame:
    """Enrichment, repair and verification of listings that are new or changed."""
    names = [c for c in df.columns]
    if t.cache is not None:
        valid = [c for c, _ in rules.categories]
        df = enrich.apply_cached(df, enrich.fresh(t.cache, now), valid, rules.aggregators)
    df = enrich.venue_lookup(df, t.venues) if t.venues is not None else df.withColumn("venue_url", F.lit(None).cast("string"))
    df = enrich.contradictions(enrich.link_cascade(df, rules.scraper_hosts)).drop("venue_url")
    df = df.withColumn("tags", clean_tags(F.col("tags"), rules.unwanted_tags)) if rules.unwanted_tags else df
    if t.streets is not None:
        df = locate.locate(df, t.places, t.streets).drop(*locate.FOUND)
    if t.images is not None:
        df = enrich.rotate_images(df, t.images)
    if t.verdicts is not None:
        df = enrich.verify(df, rules.trusted, list(rules.scraper_hosts), [], t.verdicts).drop("layer")
    return df.select(*names)


def full(raw: DataFrame, t: Tables, rules: Rules, now: datetime) -> DataFrame:
    return improve(select(raw, rules, now), t, rules, now)


def incremental(raw: DataFrame, baseline: DataFrame, t: Tables, rules: Rules, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(the new published table, the changes): only new and changed listings are improved."""
    found = changes.diff(select(raw, rules, now), baseline)
    todo = improve(found.filter(F.col("change_type").isin("new", "changed")).drop("change_type"), t, rules, now)
    same = found.filter(F.col("change_type") == "unchanged").drop("change_type")
    table = changes.merge(same, todo).filter(~filters.stale(F.col("start_date"), now))
    return table, found
