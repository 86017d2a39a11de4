"""Change data capture between two runs, and the guarded plan of what to write and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import urls
from listwright.functions.text import record_name
from listwright.schema import LISTING, present

DELETES = 200


def content_hash() -> Column:
    """Of the fields whose change asks for new processing."""
    fields = ["title", "description", "start_date", "end_date", "category", "location_name", "city"]
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in fields]), 256), 1, 16)


def location_hash() -> Column:
    return F.concat_ws("|", F.coalesce("location_name", F.lit("")), F.coalesce("city", F.lit("")), F.coalesce("address", F.lit("")))


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Listings with change_type new, changed, unchanged (the baseline's row) or removed (likewise).

    A changed listing keeps the baseline's coordinates where its place is the same, and the baseline's
    picture unless that is a stock picture.  Of baseline rows with one id, the last counts.
    """
    names = [f.name for f in LISTING.fields if f.name in current.columns]
    rest = [n for n in names if n != "source_id"]
    last = Window.partitionBy("source_id").orderBy(F.desc("ord"))
    old = baseline.withColumn("n", F.row_number().over(last)).filter("n = 1")
    pack = lambda df, x: df.select("source_id", F.struct(*rest, "ord", content_hash().alias("h"), location_hash().alias("at")).alias(x))
    both = pack(current, "c").join(pack(old, "b"), "source_id", "full")
    kind = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "removed").when(F.col("c.h") == F.col("b.h"), "unchanged").otherwise("changed")
    both = both.withColumn("change_type", kind)
    same_place = (F.col("c.at") == F.col("b.at")) & F.coalesce((F.col("b.latitude") != 0) & (F.col("b.longitude") != 0), F.lit(False))
    keeps_picture = present(F.col("b.image_url")) & ~urls.host_contains(F.col("b.image_url"), urls.STOCK)
    changed = F.col("change_type") == "changed"

    def value(n: str) -> Column:
        plain = F.when(F.col("change_type").isin("new", "changed"), F.col(f"c.{n}")).otherwise(F.col(f"b.{n}"))
        if n in ("latitude", "longitude"):
            return F.when(changed & same_place, F.col(f"b.{n}")).otherwise(plain)
        if n == "image_url":
            return F.when(changed & keeps_picture, F.col("b.image_url")).otherwise(plain)
        return plain

    return both.select("source_id", *[value(n).alias(n) for n in rest], value("ord").alias("ord"), "change_type")


def merge(base: DataFrame, update: DataFrame, key: str = "source_id") -> DataFrame:
    """Keyed union; rows of update win."""
    return base.join(update.select(key), key, "left_anti").unionByName(update, allowMissingColumns=True)


def first_by(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Of rows with equal keys, the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserts(changes: DataFrame, edited: DataFrame) -> DataFrame:
    """New and changed rows to write: not the changed ones that someone has edited (by record name), one for each name."""
    rows = changes.filter(F.col("change_type").isin("new", "changed")).withColumn("record_name", record_name(F.col("source_id")))
    names = edited.select("record_name").distinct()
    kept = rows.join(names.withColumn("edited", F.lit(True)), "record_name", "left").filter((F.col("change_type") == "new") | F.col("edited").isNull()).drop("edited")
    return first_by(kept, "record_name")


def deletes(removed: DataFrame, live: DataFrame, most: int = DELETES) -> DataFrame:
    """Ids to delete, in order: none of a source that has vanished as a whole, and at most `most`."""
    source = F.coalesce(F.nullif(F.substring_index("source_id", ":", 1), F.lit("")), F.lit("unknown"))
    alive = live.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("prefix"))
    return removed.select("source_id", "ord", source.alias("prefix")).join(alive, "prefix", "left_semi").orderBy("ord", "source_id").limit(most).select("source_id", record_name(F.col("source_id")).alias("record_name"))


def record(status: Column | None = None) -> Column:
    """A listing as a store record: times as milliseconds, flags as 0 or 1, missing texts empty."""
    millis = lambda c: F.unix_millis(F.try_to_timestamp(F.col(c)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = F.struct(
        "source_id", "source", "title", "description", millis("start_date").alias("start_date"), millis("end_date").alias("end_date"), F.col("is_all_day").cast("int").alias("is_all_day"),
        "category", "city", text("address").alias("address"), "latitude", "longitude", text("location_name").alias("location_name"), text("image_url").alias("image_url"),
        text("external_url").alias("external_url"), F.col("is_featured").cast("int").alias("is_featured"), F.col("is_recurring").cast("int").alias("is_recurring"), "tags", "metro",
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("price", "age_range", "website_url", "phone", "contact_email")],
        F.coalesce(status if status is not None else F.col("status"), F.lit("published")).alias("status"),
    )
    return F.struct(F.lit("Event").alias("record_type"), record_name(F.col("source_id")).alias("record_name"), fields.alias("fields"))
