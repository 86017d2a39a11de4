"""Elements of markup with balanced tags, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elements(pages: DataFrame, tags: list[str], key: str = "ord", html: str = "html") -> DataFrame:
    """(key, tag, pos, start, length, depth, opening, inner) for each element of these tags that is closed, nested ones too.

    pages: one row for a key.  Tags that are never closed, and closing ones without a partner, make no element.
    depth counts elements of the same tag around it.  An opening tag and the next closing one of its tag and depth belong
    together, so partners are found by two windows over a page's tags, without recursion.
    """
    any_tag = rf"(?is)<(?:{'|'.join(tags)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</(?:{'|'.join(tags)})\s*>"
    text = F.coalesce(F.col(html), F.lit(""))
    parts = pages.select(key, F.regexp_extract_all(text, F.lit(any_tag), F.lit(0)).alias("tokens"), F.split(text, any_tag, -1).alias("gaps"))
    rows = parts.select(key, F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("tokens")).alias("gap"), F.col("tokens").alias("token"))).alias("pos", "t")).select(key, "pos", "t.gap", "t.token")
    page = Window.partitionBy(key).orderBy("pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("gap") + F.length("token")).over(so_far)
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z0-9-]+)", 1))
    opens = ~F.col("token").startswith("</") & ~F.col("token").endswith("/>")
    closes = F.col("token").startswith("</")
    rows = rows.withColumns({"end": end, "tag": tag, "opens": opens}).filter(F.col("opens") | closes)
    of_tag = Window.partitionBy(key, "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(of_tag)
    rows = rows.withColumn("depth", level + F.when(F.col("opens"), -1).otherwise(0))
    partner = Window.partitionBy(key, "tag", "depth").orderBy("pos")
    until = F.when(~F.lead("opens").over(partner), F.lead("end").over(partner) - F.length(F.lead("token").over(partner)))
    found = rows.withColumn("until", until).filter(F.col("opens") & F.col("until").isNotNull())
    found = found.select(key, "tag", "pos", F.col("end").alias("start"), (F.col("until") - F.col("end")).alias("length"), F.col("depth").cast("int").alias("depth"), F.col("token").alias("opening"))
    return found.join(pages.select(key, F.col(html).alias("_html")), key).withColumn("inner", F.substr("_html", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))).drop("_html")


def first_strategy(found: DataFrame, strategies: list[tuple[str, str]], key: str = "ord") -> DataFrame:
    """Of elements, those of the first strategy (tag, pattern of its class; empty: any) that has some on a page; with `strategy`, its place in the list."""
    class_ = F.coalesce(F.regexp_extract("opening", r"(?is)\sclass=[\"']([^\"']*)[\"']", 1), F.lit(""))
    meets = [F.when((F.col("tag") == tag) & (class_.rlike(pattern) if pattern else F.lit(True)), i) for i, (tag, pattern) in enumerate(strategies)]
    rows = found.withColumn("strategy", F.coalesce(*meets)).filter("strategy is not null")
    return rows.withColumn("_first", F.min("strategy").over(Window.partitionBy(key))).filter("strategy = _first").drop("_first")
