"""Entity resolution of listings.

Two listings are the same if their keys (day, city, normal title) are equal, or if they share
the day and their titles are similar, also after removal of a shared venue's name.  Listings are
taken in order; the more complete one of two stays.  A match never leaves the group of listings
that possible matches connect, so groups are resolved apart from each other, with the result of one pass over all.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions import geo, urls
from listwright.functions.text import dedup_key, normal_title
from listwright.operators.similar import COMPARED, EDITS, LONGER, SHARE, alike_pairs, groups
from listwright.plans.shared import kept_table
from listwright.schema import present

# Trust in sources; 0 for all others.
PRIORITY = {
    "ticketmaster": 5, "seatgeek": 5, "eventbrite": 5, "libcal": 4, "kidsguide": 3, "yelp": 3, "venue-kidspace": 4, "venue-southcoastplaza": 4,
    "venue-academy": 4, "venue-nhm": 4, "venue-skirball": 4, "venue-discoverycube": 4, "venue-underwood": 4, "venue-autry": 4, "themeparks": 4,
    "venue-expopark": 4, "pretend-city": 4, "la-parent": 3, "church-mariners": 4, "church-saddleback": 4, "church-rockharbor": 4, "church-oceans": 4,
    "church-mosaic": 4, "church-realityla": 4, "mommypoppins": 1,
}
SHORTEST = 10
#: Listings of one group that are paired in one cell.
TOGETHER = 1000


def completeness(priority: dict[str, int] = PRIORITY) -> Column:
    """How much a listing tells, and how far its source is trusted."""
    link = lambda c: present(c) & ~urls.is_search(F.col(c))
    lat, lon = F.coalesce(F.col("latitude"), F.lit(0.0)), F.coalesce(F.col("longitude"), F.lit(0.0))
    parts = [
        (F.coalesce(F.length("description"), F.lit(0)) > 10, 2), (present("image_url"), 3), ((lat != 0) & (lon != 0), 2), (present("address"), 1),
        (present("location_name"), 1), (link("external_url"), 2), (link("website_url"), 2),
    ]
    total = sum((F.when(ok, n).otherwise(0) for ok, n in parts), F.lit(0))
    trust = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    return total + F.coalesce(F.try_element_at(trust, F.col("source")), F.lit(0))


def with_key(df: DataFrame) -> DataFrame:
    """df with day, key, norm (normal title) and score."""
    return df.withColumns({"day": F.substring("start_date", 1, 10), "key": dedup_key(F.col("title"), F.col("start_date"), F.col("city")), "norm": normal_title(F.col("title")), "score": completeness()})


def exact(df: DataFrame) -> DataFrame:
    """One row for each key: the highest score, the first of equals."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "ord")
    return with_key(df).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def candidate_pairs(df: DataFrame) -> DataFrame:
    """(ord_a, ord_b, day), without the greedy choice: listings of one day with similar titles.

    Equal titles of a day are one class, for which the first listing stands: each other one pairs with it,
    and alike classes pair by their first listings.
    """
    rows = kept_table(with_key(df).select(F.col("ord").alias("id"), F.col("day").alias("block"), F.col("norm").alias("text")), "titles").filter(F.length("text") >= SHORTEST)
    classes, pairs = alike_pairs(rows)
    same = rows.join(classes.withColumnRenamed("id", "a"), ["block", "text"]).filter("a <> id").select("block", "a", F.col("id").alias("b"))
    return pairs.unionByName(same).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"), F.col("block").alias("day"))


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger; only the band that can matter is computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def alike(a: str, b: str, compared: int | None = COMPARED) -> bool:
    """Whether alike_pairs() of listwright.operators.similar pairs two texts, in plain Python; tests compare with it."""
    short, long_ = sorted((len(a), len(b)))
    if a == b or (short > 0.5 * long_ and (a in b or b in a)):
        return True
    most = min(EDITS, int(short * SHARE))
    return long_ - short < LONGER and edit_distance(a[:compared], b[:compared], most) <= most


def _resolve(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """(place, ord) of the listings of a group that stay; rows: (first, ord, score, title, rest; -1: none), links: (a, b) of titles, or of rests, that are alike.

    Of the entities whose present listing is alike, a listing joins the one that appeared first; only its links are looked at.
    """
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(links["a"].tolist(), links["b"].tolist()):
        near[a].append(b)
        near[b].append(a)
    entities: list[tuple] = []  # (place, ord, score, nodes of the present listing)
    founded: dict[int, int] = {}
    standing: dict[int, list[int]] = defaultdict(list)  # node -> heap of entities that stand or stood there
    rows = rows.sort_values("ord")
    nodes = [[n for n in pair if n >= 0] for pair in zip(rows["title"].tolist(), rows["rest"].tolist())]
    for first, ord_, score, own in zip(rows["first"].tolist(), rows["ord"].tolist(), rows["score"].tolist(), nodes):
        at = founded.get(first)
        if at is None:
            for node in chain(own, *(near.get(n, ()) for n in own)):
                heap = standing.get(node)
                while heap and node not in entities[heap[0]][3]:
                    heappop(heap)
                if heap and (at is None or heap[0] < at):
                    at = heap[0]
        if at is None:
            at = founded[first] = len(entities)
            entities.append((ord_, ord_, score, own))
        elif score > entities[at][2]:
            entities[at] = (entities[at][0], ord_, score, own)
        else:
            continue
        for node in own:
            heappush(standing[node], at)
    return pd.DataFrame([e[:2] for e in entities], columns=["place", "ord"])


def _possible_links(variants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of variants of keys (day, key, norm, venue, ord, first), whose titles are long enough: the variants with the classes of their titles and of
    what is left of these without the venue (title, rest); alike classes (kind, a, b), by edits in whole texts; and (a, b) of first listings of keys that may match."""
    rest = F.when(F.length("venue") > 3, F.trim(F.regexp_replace(F.col("norm"), F.regexp_replace("venue", r"\s+", r"\\s*"), F.lit(""))))
    place = F.when(F.length("venue") > 3, F.concat_ws("\n", "day", "venue"))
    titles = kept_table(variants.filter(F.length("norm") >= SHORTEST).withColumns({"left": rest, "place": place}), "variants")
    by_title, alike_titles = alike_pairs(titles.select(F.col("first").alias("id"), F.col("day").alias("block"), F.col("norm").alias("text")), None)
    at_venue, alike_rests = alike_pairs(titles.filter("place is not null").select(F.col("ord").alias("id"), F.col("place").alias("block"), F.col("left").alias("text")), None)
    tagged = titles.join(by_title.toDF("day", "norm", "title"), ["day", "norm"]).join(at_venue.toDF("place", "left", "rest"), ["place", "left"], "left")
    tagged = kept_table(tagged.select("key", "venue", "first", "ord", "title", "rest"), "classes")
    met = kept_table(alike_titles.select(F.lit("title").alias("kind"), "a", "b").unionByName(alike_rests.select(F.lit("rest").alias("kind"), "a", "b")), "alike")
    by_ord = lambda c: tagged.select(F.col("ord").alias(c), F.col("first").alias(f"first_{c}"))
    rests = met.filter("kind = 'rest'").select("a", "b").unionByName(tagged.filter("rest <> ord").select(F.col("rest").alias("a"), F.col("ord").alias("b")))
    rests = rests.join(by_ord("a"), "a").join(by_ord("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    links = met.filter("kind = 'title'").select("a", "b").unionByName(tagged.filter("title <> first").select(F.col("title").alias("a"), F.col("first").alias("b")))
    return tagged, met, links.unionByName(rests).filter("a <> b").distinct()


def greedy(df: DataFrame) -> DataFrame:
    """The listings that stay, with `place`, the order in which their entities first appeared.

    Spark finds what is alike; only numbers go to Python, and only of groups with several keys. The rows are joined back by ord, which must
    be unique and not negative.  The first key of a group is an entity in any case, so of its rows only those count that have the highest score so far:
    copies of one listing are counted by (key, score) and never gathered.
    """
    venue = F.trim(F.regexp_replace(F.lower(F.coalesce("location_name", F.lit(""))), r"[^a-z0-9\s]", ""))
    rows = kept_table(with_key(df).select("ord", "day", "key", "norm", "score", venue.alias("venue")), "keys")
    heads = rows.groupBy("key").agg(F.min("ord").alias("first"))
    # A key may stand with several venues: each is a row of its own here, linked by the key's first listing.
    variants = rows.groupBy("day", "key", "norm", "venue").agg(F.min("ord").alias("ord")).join(heads, "key")
    tagged, met, links = _possible_links(variants)
    roots = groups(links)
    by_key = kept_table(heads.join(roots, F.col("first") == F.col("id"), "left").select("key", "first", F.coalesce("root", "first").alias("root")), "roots")
    several = by_key.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    placed = rows.join(kept_table(by_key.join(several.withColumn("many", F.lit(True)), "root", "left"), "groups"), "key")
    scores = placed.filter("root = first").groupBy("key", "root", "many", "score").agg(F.min("ord").alias("ord"))
    above = F.min("ord").over(Window.partitionBy("key").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    records = scores.withColumn("above", above).filter(F.col("above").isNull() | (F.col("ord") < F.col("above")))
    alone = records.filter("many is null").groupBy("root").agg(F.max_by("ord", "score").alias("ord")).select(F.col("root").alias("place"), "ord")
    leading = placed.join(records.filter("many").select("ord"), "ord", "left_semi")
    open_ = leading.unionByName(placed.filter("many and root <> first"))
    # Classes of titles are numbered evenly, those of rests oddly.
    even, odd = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    open_ = open_.join(tagged.select("key", "venue", even("title").alias("title"), odd("rest").alias("rest")), ["key", "venue"], "left")
    of_first, of_ord = by_key.select(F.col("first").alias("a"), "root"), tagged.select(F.col("ord").alias("a"), "key").join(by_key, "key").select("a", "root")
    known = [met.filter(F.col("kind") == kind).join(of, "a").select("root", n("a").alias("a"), n("b").alias("b")) for kind, of, n in (("title", of_first, even), ("rest", of_ord, odd))]
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("ord", T.LongType())])
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("title", "rest")]  # no nulls, which would turn whole numbers into floats
    rows_of = open_.select("root", "first", "ord", "score", *numbers).groupBy("root")
    chosen = rows_of.cogroup(known[0].unionByName(known[1]).groupBy("root")).applyInPandas(_resolve, schema)
    return df.join(alone.unionByName(chosen), "ord")


def duplicate_pairs(df: DataFrame, limit: int | None = None, together: int = TOGETHER) -> DataFrame:
    """(ord_a, ord_b) of listings with the same title and day, in order.

    A group of more than about `together` listings is dealt into parts of that size; each two parts, and each part with itself, meet
    in a cell of their own, so that no task pairs a whole group.
    """
    rows = kept_table(df.select("ord", F.lower("title").alias("t"), F.substring("start_date", 1, 10).alias("d")), "titles")
    rows = rows.filter("t is not null and d is not null").withColumn("same", F.xxhash64("t", "d"))
    large = rows.groupBy("same").agg(F.ceil(F.count("*") / together).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(F.broadcast(large), "same", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int"))
    a = rows.select(F.col("ord").alias("a"), "t", "d", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    b = rows.select(F.col("ord").alias("b"), "t", "d", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    met = a.join(b, ["t", "d", "i", "j"]).filter("i < j or a < b")
    pairs = met.select(F.least("a", "b").alias("ord_a"), F.greatest("a", "b").alias("ord_b"))
    return pairs.orderBy("ord_a", "ord_b").limit(limit) if limit else pairs
