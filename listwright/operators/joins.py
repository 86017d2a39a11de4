"""Joins on nearness: an equality on time buckets bounds what is compared."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(t: Column, width: timedelta) -> Column:
    return F.floor(F.unix_micros(t) / int(width.total_seconds() * 1_000_000))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, width: timedelta) -> DataFrame:
    """Pairs with equal keys whose times differ by less than `width`; columns left_* and right_*.

    The left row looks into its own and both neighbouring buckets of that width, so that each pair meets once.
    """
    a = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns]).withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: _bucket(F.col(f"left_{time}"), width) + i)))
    b = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withColumn("b", _bucket(F.col(f"right_{time}"), width))
    near = F.abs(F.unix_micros(f"left_{time}") - F.unix_micros(f"right_{time}")) < int(width.total_seconds() * 1_000_000)
    on = near & (a["b"] == b["b"])
    for k in keys:
        on = on & (F.col(f"left_{k}") == F.col(f"right_{k}"))
    return a.join(b, on).drop("b")


def range_join(ranges: DataFrame, points: DataFrame, begin: str, until: str, at: str, width: timedelta) -> DataFrame:
    """Points inside half-open ranges, by buckets about as wide as the ranges."""
    spread = F.explode(F.sequence(_bucket(F.col(begin), width), _bucket(F.col(until), width)))
    r = ranges.filter(F.col(begin) <= F.col(until)).withColumn("_b", spread)
    p = points.withColumn("_b", _bucket(F.col(at), width))
    return r.join(p, "_b").filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(until))).drop("_b")


def count_in_ranges(ranges: DataFrame, points: DataFrame, begin: str, until: str, at: str, width: timedelta) -> DataFrame:
    """ranges (begin, until, not null) with n, the number of points inside, for those that hold some; no pair of both is made.

    Equal times are one row with a count.  In a bucket of that width, a running sum tells how many points lie before a time;
    a range is the sum at its end less that at its begin, and the totals of the buckets from its first to the one before its last.
    """
    counted = points.groupBy(F.col(at).alias("t")).agg(F.count("*").alias("n")).filter("t is not null")
    spans = ranges.select(F.col(begin).alias("u"), F.col(until).alias("v")).filter("u < v").distinct()
    marks = spans.select("u", "v", F.explode(F.array(F.struct(F.col("v").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("u").alias("t"), F.lit(-1).alias("sign")))).alias("m")).select("u", "v", "m.*")
    times = marks.select("t").distinct().withColumn("n", F.lit(0).cast("long"))
    so_far = Window.partitionBy("b").orderBy("t")
    all_times = counted.unionByName(times).groupBy("t").agg(F.sum("n").alias("n")).withColumn("b", _bucket(F.col("t"), width))
    before = all_times.select("t", (F.sum("n").over(so_far) - F.col("n")).alias("before"))
    ends = marks.join(before, "t").select("u", "v", (F.col("sign") * F.col("before")).alias("n"))
    totals = counted.groupBy(_bucket(F.col("t"), width).alias("b")).agg(F.sum("n").alias("n"))
    first, last = _bucket(F.col("u"), width), _bucket(F.col("v"), width)
    between = spans.filter(first < last).select("u", "v", F.explode(F.sequence(first, last - 1)).alias("b")).join(totals, "b").select("u", "v", "n")
    inside = ends.unionByName(between).groupBy("u", "v").agg(F.sum("n").alias("n")).filter("n > 0")
    return ranges.join(inside, (F.col(begin) == F.col("u")) & (F.col(until) == F.col("v"))).drop("u", "v")
