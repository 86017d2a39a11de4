"""Listings of day pages: cards in markup united with the page's linked data, and budgets for what comes after.

Pages are (ord, url, day, html).  A card is a block that a pattern finds, with what stands shortly before and after it.  A page that is
null or of another shape gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.text import clean_description, trimmed
from listwright.operators.categorize import categorize
from listwright.schema import LISTING, conform, numbered, present
from listwright.sources.payloads import json_ld

# Blocks of titles, what they hold, and how far around them times and pictures are.
BLOCK = r'(?is)<div class="views-field views-field-title">.*?</div>\s*</div>'
_LINK, _TITLE = r'(?is)<a[^>]*href="(/[^"]+)"[^>]*>\s*<span>.*?</span>', r'(?is)<a[^>]*href="/[^"]+"[^>]*>\s*<span>(.*?)</span>'
_VENUE, _TAG = r"(?is)<p>(.*?)</p>", r"(?is)<li>(.*?)</li>"
_TIME, _LABEL = r'(?is)<time\s+datetime="([^"]+)"[^>]*>.*?</time>', r'(?is)<time\s+datetime="[^"]+"[^>]*>(.*?)</time>'
_UNTIL = r'(?is)<time\s+datetime="[^"]+"[^>]*>.*?</time>\s*[-–]\s*<time\s+datetime="([^"]+)"[^>]*>.*?</time>'
_PICTURE = r'(?i)src="([^"]*(?:\.jpg|\.jpeg|\.png|\.webp)[^"]*)"'
_NO_TITLE = r"(?i)^(login|sign up|register|subscribe|menu|home|search)$"
AFTER, BEFORE = 1200, 800


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _plain(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "<[^>]*>", ""))


def blocks(html: Column, pattern: str = BLOCK, before: int = BEFORE, after: int = AFTER) -> Column:
    """Array of (block, before, after): the matches of a pattern and the characters around each."""
    found, gaps = F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.split(html, pattern, -1)
    size = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + F.length(x))
    start = lambda i: size(F.slice(gaps, F.lit(1), i + 1)) + size(F.slice(found, F.lit(1), i))

    def around(b: Column, i: Column) -> Column:
        return F.get(F.transform(F.array(start(i)), lambda s: F.struct(
            b.alias("block"), F.substr(html, F.greatest(s - before, F.lit(0)) + 1, F.least(s, F.lit(before))).alias("before"), F.substr(html, s + F.length(b) + 1, F.lit(after)).alias("after"),
        )), 0)

    return F.transform(found, around)


def card_events(pages: DataFrame, source: str, base: str, place: str) -> DataFrame:
    """A listing for each card of a page: on the page's day, at the time that follows it, or all day where that is `various` or midnight.  Of one link on one day, the first."""
    rows = pages.select("ord", "day", F.posexplode(blocks(F.col("html"))).alias("pos", "b")).select("ord", "day", "pos", "b.*")
    rows = rows.withColumns({
        "path": _group(F.col("block"), _LINK), "title": _plain(_group(F.col("block"), _TITLE)), "venue": F.nullif(_plain(_group(F.col("block"), _VENUE)), F.lit("")), "at": _group(F.col("after"), _TIME),
        "label": F.regexp_extract("after", _LABEL, 1), "until": _group(F.col("after"), _UNTIL), "picture": F.try_element_at(F.regexp_extract_all("before", F.lit(_PICTURE), F.lit(1)), F.lit(-1)),
        "kinds": F.filter(F.transform(F.regexp_extract_all("block", F.lit(_TAG), F.lit(1)), _plain), lambda t: (t != "") & (F.lower(t) != "pick")),
    })
    rows = rows.filter(F.col("path").isNotNull() & F.length("title").between(3, 200) & ~F.col("title").rlike(_NO_TITLE))
    first = Window.partitionBy("path", "day").orderBy("ord", "pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    clock = lambda c: F.regexp_replace(F.substring_index(F.col(c), "T", -1), "Z", "")
    timed = F.coalesce(~F.col("label").rlike("(?i)various") & ~F.col("at").contains("T00:00:00") & F.col("at").contains("T"), F.lit(False))
    ends = timed & F.coalesce(F.col("until").contains("T") & (clock("until") != "00:00:00"), F.lit(False))
    on = lambda c: F.concat("day", F.lit("T"), c)
    picture = F.when(F.col("picture").startswith("/"), F.concat(F.lit(base), "picture")).otherwise(F.col("picture"))
    return conform(
        rows, source_id=F.concat_ws(":", F.lit(source), "path", "day"), source=F.lit(source), start_date=on(F.when(timed, clock("at")).otherwise("00:00:00")), end_date=F.when(ends, on(clock("until"))), is_all_day=~timed,
        category=categorize(F.col("title"), F.array_join("kinds", " ")), city=F.coalesce("venue", F.lit(place)), location_name=F.col("venue"), image_url=picture, external_url=F.concat(F.lit(base), "path"),
        tags=F.concat(F.array(F.lit(source)), "kinds"), ord=numbered("ord", "pos"),
    )


def united(first: DataFrame, second: DataFrame, fill: list[str] | None = None) -> DataFrame:
    """Listings of two extractions as one: those of a link, or else of a title on a day, are the same; then each empty field takes the other's value.

    first's listings keep their place and what they say; second's that first doesn't have come too.  Links and titles are compared without
    case and white space at the ends.  Of several listings with one key, each takes the values of the first one of the other side.
    """
    names = [f.name for f in LISTING.fields]
    fill = fill or [n for n in names if n not in ("source_id", "source", "is_all_day", "is_featured", "is_recurring")]
    link = F.nullif(F.lower(F.trim("external_url")), F.lit(""))
    title = F.concat_ws("|", F.lower(trimmed(F.col("title"))), F.substring("start_date", 1, 10))
    values = F.struct(*[F.col(n).alias(n) for n in fill], F.col("source_id").alias("id"))
    one = lambda key: second.select(key.alias("_key"), values.alias("v"), "ord").filter("_key is not null").groupBy("_key").agg(F.min_by("v", F.struct("ord", "v.id")).alias("v"))
    rows = first.withColumns({"_link": link, "_title": title})
    rows = rows.join(one(link).toDF("_link", "_a"), "_link", "left").join(one(title).toDF("_title", "_b"), "_title", "left").withColumn("_v", F.coalesce("_a", "_b"))
    type_of = {f.name: f.dataType.simpleString() for f in LISTING.fields}
    empty = lambda n: F.coalesce(F.size(n) == 0, F.lit(True)) if type_of[n].startswith("array") else ~present(n) if type_of[n] == "string" else F.col(n).isNull()
    filled = rows.withColumns({n: F.when(empty(n), F.coalesce(F.col(f"_v.{n}"), F.col(n))).otherwise(F.col(n)) for n in fill})
    known = first.select(link.alias("_k")).filter("_k is not null").distinct(), first.select(title.alias("_k")).distinct()
    new = second.withColumns({"_l": link, "_t": title})
    new = new.join(known[0].withColumnRenamed("_k", "_l"), "_l", "left_anti").join(known[1].withColumnRenamed("_k", "_t"), "_t", "left_anti")
    return filled.select(*names, "ord").unionByName(new.select(*names, "ord"))


def day_listings(pages: DataFrame, source: str, base: str, place: str) -> DataFrame:
    """Cards of day pages, with what the pages' linked data says of them; events that only the linked data has come too."""
    cards = card_events(pages, source, base, place)
    data = json_ld(pages, source)
    return united(cards, data.withColumn("is_all_day", ~F.col("start_date").contains("T")))


def data_or_cards(pages: DataFrame, source: str, base: str, place: str) -> DataFrame:
    """Of each page the events of its linked data; of pages without any, the cards."""
    data = json_ld(pages, source)
    told = data.select(F.shiftright("ord", 32).alias("ord")).distinct()
    return data.unionByName(card_events(pages.join(told, "ord", "left_anti"), source, base, place))


def within_budget(df: DataFrame, most: int, wanted: Column, by: str = "metro") -> DataFrame:
    """df with `spent`: whether a wanted row is among the first `most` of its metro, in order; places are reduced in each partition before rows move."""
    order = Window.partitionBy(by).orderBy("ord", "source_id")
    chosen = df.filter(wanted).select(by, "ord", "source_id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    marks = chosen.select("ord", "source_id", F.lit(True).alias("spent")).distinct()
    return df.join(marks, ["ord", "source_id"], "left").withColumn("spent", F.coalesce("spent", F.lit(False)))


def enriched(df: DataFrame, details: DataFrame, most: int) -> DataFrame:
    """df with texts and addresses of detail pages (url, description, address, location_name) for the first `most` of each metro that lack a text."""
    marked = within_budget(df, most, ~present("description"))
    facts = details.groupBy("url").agg(F.min(F.struct("description", "address", "location_name")).alias("_d"))
    rows = marked.join(facts, F.col("spent") & (marked.external_url == facts.url), "left")
    value = lambda n: F.when(present(n), F.col(n)).otherwise(F.coalesce(F.col(f"_d.{n}"), F.col(n)))
    return rows.withColumns({"description": clean_description(value("description")), "address": value("address"), "location_name": value("location_name")}).drop("_d", "url", "spent")
