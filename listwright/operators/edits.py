"""Records that a pipeline writes and people edit, replayed from a log of operations.

log: (seq, record_name, op, fields), with one op for a record and seq.
    upsert   the pipeline's version: takes the record's place, or makes it, unless people have edited it
    edit     a person's fields over what is there (or over nothing); marks the record as edited
    release  takes the mark away; the next upsert replaces the record
    delete   removes the record and its mark
Null values in fields change nothing.  Other ops don't count.  A record's state depends only on what follows its last reset
(a delete, or an upsert that took effect), so a replay is a window over each record's ops and an aggregation by field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = "map<string,string>"


def _following_reset(log: DataFrame) -> DataFrame:
    """log with `marked` (before the op), and without what precedes a record's last reset."""
    before = Window.partitionBy("record_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("record_name")
    mark = F.when(F.col("op") == "edit", True).when(F.col("op").isin("release", "delete"), False)
    rows = log.withColumn("marked", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))
    resets = (F.col("op") == "delete") | ((F.col("op") == "upsert") & ~F.col("marked"))
    rows = rows.withColumn("_reset", F.max(F.when(resets, F.col("seq"))).over(whole))
    return rows.filter("_reset is null or seq >= _reset").withColumn("resets", resets).drop("_reset")


def replay(log: DataFrame) -> DataFrame:
    """(record_name, fields, edited) of the records that are there after the log."""
    rows = _following_reset(log)
    counts = rows.filter((F.col("op") == "edit") | ((F.col("op") == "upsert") & F.col("resets")))
    there = counts.groupBy("record_name").agg(F.lit(1).alias("one")).select("record_name")
    values = counts.select("record_name", "seq", F.explode("fields").alias("field", "value")).filter("value is not null")
    last = values.groupBy("record_name", "field").agg(F.max_by("value", "seq").alias("value"))
    fields = last.groupBy("record_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    mark = F.when(F.col("op") == "edit", True).when(F.col("op").isin("release", "delete"), False)
    edited = rows.groupBy("record_name").agg(F.max_by(mark, F.when(mark.isNotNull(), F.col("seq"))).alias("edited"))
    out = there.join(fields, "record_name", "left").join(edited, "record_name", "left")
    return out.select("record_name", F.coalesce("fields", F.create_map().cast(FIELDS)).alias("fields"), F.coalesce("edited", F.lit(False)).alias("edited"))


def as_log(state: DataFrame, seq: int) -> DataFrame:
    """A state as ops of two numbers, seq and seq + 1, so that a log can be replayed from there on."""
    upserts = state.select(F.lit(seq).cast("long").alias("seq"), "record_name", F.lit("upsert").alias("op"), "fields")
    marks = state.filter("edited").select(F.lit(seq + 1).cast("long").alias("seq"), "record_name", F.lit("edit").alias("op"), F.create_map().cast(FIELDS).alias("fields"))
    return upserts.unionByName(marks)


def protected(state: DataFrame) -> DataFrame:
    """The names of records that upserts must leave alone."""
    return state.filter("edited").select("record_name")


def upserts_to_log(rows: DataFrame, seq: int, names: list[str], record_name: str = "record_name") -> DataFrame:
    """Ops of the pipeline's rows, with these columns as fields."""
    entries = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names]))
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.col(record_name).alias("record_name"), F.lit("upsert").alias("op"), entries.alias("fields"))
