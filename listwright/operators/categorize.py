"""Categories by keywords: 3 points for a keyword in the title, else 1 for one in the text; the best category wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule table: (category, keywords) in order of precedence.  Load one's own from JSON; this is a start.
RULES: list[tuple[str, list[str]]] = [
    ("Storytime", ["storytime", "story time", "story hour", "read aloud", "picture book", "bilingual storytime"]),
    ("Farmers Market", ["farmers market", "farm market", "flea market", "swap meet"]),
    ("Free Movie", ["movie night", "film screening", "outdoor movie", "drive-in", "free movie"]),
    ("Craft", ["craft", "art class", "painting", "pottery", "origami", "tie-dye"]),
    ("Music", ["concert", "live music", "sing-along", "orchestra", "symphony", "recital"]),
    ("Museum", ["museum", "science center", "aquarium", "planetarium"]),
    ("Outdoor", ["outdoor", "hiking", "hike", "nature walk", "camping", "stargazing"]),
    ("Sports", ["soccer", "baseball", "basketball", "swimming", "gymnastics", "fun run"]),
    ("Education", ["stem", "science class", "coding class", "robotics"]),
]
OTHER = "Other"


def category_scores(title: Column, text: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Array of (score, -place, category) of a title and a text in lower case."""
    points = lambda w: F.when(title.contains(w.lower()), 3).when(text.contains(w.lower()), 1).otherwise(0)
    return F.array(*[F.struct(reduce(lambda a, b: a + b, (points(w) for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules)])


def categorize(title: Column, text: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    # Title and text are bound first: each keyword would compute them anew.
    read = F.array(F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("title"), F.lower(F.coalesce(text, F.lit(""))).alias("text")))
    best = F.transform(read, lambda r: F.array_max(category_scores(r["title"], r["text"], rules)))
    return F.get(F.transform(best, lambda b: F.when(b["score"] > 0, b["name"]).otherwise(F.lit(OTHER))), F.lit(0))
