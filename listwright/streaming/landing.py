"""Structured Streaming front end: files that land are resolved against the published table in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.operators.changes import first_by
from listwright.schema import LISTING


def landing(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Listings from JSON files that land in a folder, with the time of arrival."""
    rows = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", per_trigger).json(path)
    return rows.withColumn("arrived", F.current_timestamp())


def distinct_arrivals(rows: DataFrame, late: str = "12 hours") -> DataFrame:
    """Each listing once within the watermark, whatever file it came in."""
    return rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["source_id", "start_date"])


def arrivals_by_source(rows: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by source in windows of arrival time."""
    return rows.withWatermark("arrived", late).groupBy(F.window("arrived", width), "source").agg(F.count("*").alias("n"))


def upsert(rows: DataFrame, target: str, checkpoint: str, improve: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Keeps the newest version of each listing under `target`, in one folder for each batch.

    A batch's folder is overwritten when the batch runs again, so a repeated batch adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = batch.withColumn("ord", -F.unix_micros("arrived"))
        improve(first_by(order, "source_id")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of each listing of all batches."""
    rows = spark.read.parquet(target)
    return first_by(rows.withColumn("ord", -F.col("batch")), "source_id").drop("ord")
