"""Writers of the published table and of store records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import record_name
from listwright.operators.changes import deletes, first_by, record, upserts
from listwright.operators.views import summary


def publish(df: DataFrame, path: str, format: str = "parquet") -> None:
    """All listings by metro, and the summary beside them."""
    df.repartition("metro").write.mode("overwrite").partitionBy("metro").format(format).save(f"{path}/listings")
    summary(df).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def records(df: DataFrame) -> DataFrame:
    """Store records, one for each record name (the first)."""
    return first_by(df.withColumn("record_name", record_name(F.col("source_id"))), "record_name").select(record().alias("r")).select("r.*")


def incremental_plan(changes: DataFrame, live: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to write, ids to delete) of a run."""
    writes = upserts(changes, edited).select(record().alias("r")).select("r.*")
    return writes, deletes(changes.filter(F.col("change_type") == "removed"), live)


def calendar_rows(df: DataFrame) -> DataFrame:
    """Rows for a calendar: an end one hour after the start where none is given, and one place text."""
    start = F.try_to_timestamp("start_date")
    end = F.coalesce(F.try_to_timestamp("end_date"), start + F.expr("interval 1 hour"))
    return df.filter(start.isNotNull()).select("source_id", "title", start.alias("begin"), end.alias("finish"), F.concat_ws(", ", *[F.nullif(F.col(c), F.lit("")) for c in ("location_name", "address", "city")]).alias("place"), "is_all_day")


def reminders(df: DataFrame, now) -> DataFrame:
    """An hour before each start that is still to come."""
    at = F.try_to_timestamp("start_date") - F.expr("interval 1 hour")
    return df.select("source_id", "title", at.alias("remind_at")).filter(F.col("remind_at") > F.lit(now))


def apply_status(df: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Publishes or rejects a set of listings."""
    chosen = ids.select("source_id").distinct().withColumn("_chosen", F.lit(True))
    return df.join(chosen, "source_id", "left").withColumn("status", F.when(F.col("_chosen"), F.lit(status)).otherwise(F.col("status"))).drop("_chosen")
