"""What readers and administrators ask of the published table: feeds, calendars, maps, reports."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import geo
from listwright.functions.text import parse_timestamp
from listwright.operators.filters import visible
from listwright.schema import present


def starts() -> Column:
    return parse_timestamp(F.col("start_date"))


def upcoming(df: DataFrame, now: datetime, metro: str, months: int = 2, default_metro: str = "los-angeles") -> DataFrame:
    """Visible listings of a metro from today on for some months, by start."""
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    until = F.add_months(F.lit(today.date()), months)
    t = starts()
    ok = (t >= F.lit(today)) & (t <= until.cast("timestamp")) & (F.coalesce("metro", F.lit(default_metro)) == metro) & visible(F.col("status"))
    return df.filter(F.coalesce(ok, F.lit(False))).orderBy("start_date", "ord")


def popular(df: DataFrame, favourites: DataFrame, k: int) -> DataFrame:
    """The k most popular: favourites, then featured, then with a picture, then by start."""
    marked = df.join(favourites.select("source_id").distinct().withColumn("favourite", F.lit(1)), "source_id", "left")
    return marked.orderBy(F.desc(F.coalesce("favourite", F.lit(0))), F.desc(F.col("is_featured").cast("int")), F.desc(present("image_url").cast("int")), "start_date", "ord").limit(k)


def recommended(df: DataFrame, interests: list[str], favourites: DataFrame, now: datetime, k: int = 10) -> DataFrame:
    """The k future listings with the best positive scores; none without interests or favourites.

    +3 category of interest, +2 a tag naming one, +1 category of a favourite, +1 within 7 days,
    +1 a picture, -1 a favourite already.
    """
    liked = df.join(favourites.select("source_id").distinct(), "source_id", "left_semi").select(F.col("category").alias("liked")).distinct()
    own = favourites.select("source_id").distinct().withColumn("own", F.lit(True))
    rows = df.join(liked, F.col("category") == F.col("liked"), "left").join(own, "source_id", "left")
    names = F.array(*[F.lit(i.lower()) for i in interests]) if interests else F.array().cast("array<string>")
    tagged = F.exists("tags", lambda t: F.exists(names, lambda n: F.lower(t).contains(n)))
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = one(F.col("category").isin(interests) if interests else F.lit(False), 3) + one(F.coalesce(tagged, F.lit(False)), 2) + one(F.col("liked").isNotNull(), 1)
    score = score + one(starts() <= F.lit(now + timedelta(days=7)), 1) + one(present("image_url"), 1) - one(F.col("own"), 1)
    signal = F.lit(True) if interests else F.lit(not liked.isEmpty())
    return rows.filter(signal & (starts() >= F.lit(now))).withColumn("score", score).filter("score > 0").drop("liked", "own").orderBy(F.desc("score"), "start_date", "ord").limit(k)


def by_day(df: DataFrame, top: int | None = None) -> DataFrame:
    """(day, n, ids): listings of each day in order of start; with `top`, only the first ids, and `more`, how many others."""
    w = Window.partitionBy("day").orderBy("start_date", "ord")
    rows = df.withColumn("day", starts().cast("date")).withColumn("place", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= (top or 2**31 - 1), F.struct("place", "source_id"))))
    out = rows.groupBy("day").agg(F.count("*").alias("n"), F.transform(listed, lambda s: s["source_id"]).alias("ids"))
    return out.withColumn("more", F.greatest(F.col("n") - top, F.lit(0))) if top else out


def month_grid(df: DataFrame, month: date) -> DataFrame:
    """(day, blanks, n) for each day of a month, empty ones too; blanks: cells before the first day, weeks begin on Sunday."""
    spark = df.sparkSession
    first = F.lit(month.replace(day=1)).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"), (F.dayofweek(first) - 1).alias("blanks"))
    counts = df.groupBy(starts().cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", "blanks", F.coalesce("n", F.lit(0)).alias("n"))


def clusters(df: DataFrame, digits: int = 4) -> DataFrame:
    """Listings at one place of the map; the cluster stands where its first member does."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = df.filter(geo.has_coordinates(lat, lon))
    first = lambda c: F.min_by(c, "ord")
    return rows.groupBy(F.round(lat, digits).alias("lat_key"), F.round(lon, digits).alias("lon_key")).agg(F.count("*").alias("n"), first("latitude").alias("latitude"), first("longitude").alias("longitude"), F.min("ord").alias("first_ord"))


def summary(df: DataFrame) -> DataFrame:
    """(kind, value, n): the total and the counts by metro, source and category, in one pass."""
    sets = df.groupingSets([[], ["metro"], ["source"], ["category"]], "metro", "source", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "metro").when(F.col("g") == 5, "source").otherwise("category")
    value = F.when(F.col("g") == 3, F.col("metro")).when(F.col("g") == 5, F.col("source")).when(F.col("g") == 6, F.col("category"))
    return sets.select(kind.alias("kind"), F.coalesce(value, F.lit("")).alias("value"), "n")


def dashboard(df: DataFrame, now: datetime) -> DataFrame:
    """One row of counts: all, active, expired, featured, without picture, without coordinates."""
    last = F.coalesce(parse_timestamp(F.col("end_date")), starts())
    today = F.lit(now.replace(hour=0, minute=0, second=0, microsecond=0))
    located = geo.has_coordinates(F.col("latitude"), F.col("longitude"))
    return df.agg(
        F.count("*").alias("total"), F.count_if(last >= today).alias("active"), F.count_if(last < today).alias("expired"), F.count_if("is_featured").alias("featured"),
        F.count_if(~present("image_url")).alias("no_image"), F.count_if(~located & (last >= today)).alias("no_place"), F.avg(located.cast("double")).alias("located_share"),
    )


def nearest(df: DataFrame, places: DataFrame) -> DataFrame:
    """df with the id of the nearest place (squared degrees, ties to the smaller id).

    `places` is a dimension of at most 1000 rows: it is collected into one expression, so that no join is needed.
    """
    rows = places.select("id", "latitude", "longitude").orderBy("id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("nearest() takes at most 1000 places")
    options = [F.struct(geo.squared_degrees(F.col("latitude"), F.col("longitude"), r.latitude, r.longitude).alias("d"), F.lit(r.id).alias("id")) for r in rows]
    return df.withColumn("nearest", F.array_min(F.array(*options))["id"] if options else F.lit(None).cast("string"))


def admin_list(df: DataFrame, metro: str | None = None, source: str | None = None, text: str = "") -> DataFrame:
    """All listings of a metro and a source whose title, city or description holds the text, latest first."""
    q = text.lower()
    found = F.lit(True)
    for c, v in (("metro", metro), ("source", source)):
        found = found & (F.coalesce(F.col(c) == v, F.lit(False)) if v is not None else F.lit(True))
    if q:
        found = found & F.coalesce(F.greatest(*[F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in ("title", "city", "description")]), F.lit(False))
    return df.filter(found).orderBy(F.desc("start_date"), "ord")


def date_text() -> Column:
    """The start as text, with the time unless it is an all-day listing."""
    t = starts()
    return F.when(F.col("is_all_day"), F.date_format(t, "MMM d, yyyy")).otherwise(F.date_format(t, "MMM d, yyyy 'at' h:mm a"))


def time_text() -> Column:
    """The time of day as text: `All Day`, a span, or the start."""
    clock = lambda c: F.date_format(parse_timestamp(F.col(c)), "h:mm a")
    return F.when(F.col("is_all_day"), "All Day").otherwise(F.concat_ws(" - ", clock("start_date"), clock("end_date")))


def month_steps(day: Column) -> Column:
    """The same day in the month before and after; the last day where that month is shorter."""
    return F.struct(F.add_months(day, -1).alias("before"), F.add_months(day, 1).alias("after"))
