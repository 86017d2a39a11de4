"""Readers' and administrators' changes: favourites, suggestions, profiles, access, clean-up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.text import parse_timestamp
from listwright.operators.changes import merge
from listwright.schema import conform


def toggle(favourites: DataFrame, ids: DataFrame) -> DataFrame:
    """Favourites with each id added if it was missing, removed if it was there."""
    ids = ids.select("source_id").distinct()
    kept = favourites.select("source_id").distinct()
    return kept.join(ids, "source_id", "left_anti").unionByName(ids.join(kept, "source_id", "left_anti"))


def favourite_listings(df: DataFrame, favourites: DataFrame) -> DataFrame:
    return df.join(favourites.select("source_id").distinct(), "source_id", "left_semi").dropDuplicates(["source_id"])


def pending(suggestions: DataFrame, newest: int = 100) -> DataFrame:
    """Pending ones among the newest; those that lack a title, text, city or proper start are left out after the cut."""
    top = suggestions.orderBy(F.desc("created_at"), "id").limit(newest)
    whole = F.col("title").isNotNull() & F.col("description").isNotNull() & F.col("city").isNotNull() & parse_timestamp(F.col("start_date")).isNotNull()
    known = F.when(F.col("status").isin("pending", "approved", "rejected"), F.col("status")).otherwise("pending")
    return top.filter(whole).withColumn("status", known).filter("status = 'pending'")


def approve(suggestions: DataFrame, ids: DataFrame, categories: list[str], now: datetime) -> tuple[DataFrame, DataFrame]:
    """(new listings, suggestions with their new status)."""
    chosen = ids.select("id").distinct()
    rows = suggestions.join(chosen, "id", "left_semi")
    category = F.when(F.col("category").isin(categories), F.col("category")).otherwise("Other")
    listings = conform(rows.drop("status"), source_id=F.concat(F.lit("suggestion:"), F.col("id").cast("string")), source=F.lit("user-suggestion"), category=category, website_url=F.col("external_url"))
    return listings, reviewed(suggestions, chosen, "approved", now)


def reviewed(suggestions: DataFrame, ids: DataFrame, status: str, now: datetime, note: str | None = None) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = suggestions.join(hit, "id", "left").withColumns({"status": F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status")), "reviewed_at": F.when(F.col("_hit"), F.lit(now))})
    return (out.withColumn("review_note", F.when(F.col("_hit"), F.lit(note))) if note is not None else out).drop("_hit")


def profile_update(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """Profiles by user; updates replace or create."""
    return merge(profiles, updates, "user_id")


def access(entitlements: DataFrame, products: list[str], admins: list[str]) -> DataFrame:
    """(user_id, product, has_access): the first entitlement whose product counts; administrators have access anyway."""
    w = Window.partitionBy("user_id").orderBy("ord")
    valid = entitlements.filter(F.col("product").isin(products)).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    users = entitlements.select("user_id").distinct()
    return users.join(valid.select("user_id", "product"), "user_id", "left").withColumn("has_access", F.col("product").isNotNull() | F.col("user_id").cast("string").isin(admins))


def without_expired(df: DataFrame, now: datetime) -> DataFrame:
    last = F.coalesce(parse_timestamp(F.col("end_date")), parse_timestamp(F.col("start_date")))
    return df.filter(~F.coalesce(last < F.lit(now.replace(hour=0, minute=0, second=0, microsecond=0)), F.lit(False)))


def locked(start: Column, now: datetime) -> Column:
    """What readers without access can't open: starts after tomorrow."""
    return parse_timestamp(start).cast("date") > F.date_add(F.lit(now.date()), 1)


def from_form(title: Column, tags: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """Fields of an administrator's form: tags from text, blanks null, numbers parsed."""
    listed = F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")
    return {"title": F.nullif(F.trim(title), F.lit("")), "tags": listed, "latitude": F.trim(latitude).try_cast("double"), "longitude": F.trim(longitude).try_cast("double")}
