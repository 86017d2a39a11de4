"""Row filters of listings.  The clock is a parameter wherever one is needed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import rules
from listwright.functions import geo, price
from listwright.functions.text import parse_timestamp


def stale(start: Column, now: datetime) -> Column:
    """Whether a listing lies before today.  Starts are compared as texts with midnight in UTC, so that
    dates without `.000Z` of today count as stale; that is the published behaviour."""
    return start < F.lit(now.strftime("%Y-%m-%dT00:00:00.000Z"))


def in_window(start: Column, now: datetime, days: int = 60) -> Column:
    t = parse_timestamp(start)
    return F.coalesce(t.between(F.lit(now), F.lit(now + timedelta(days=days))), F.lit(False))


def any_keyword(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words, in any case."""
    if not words:
        return F.lit(False)
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(False))


def by_first_letter(patterns: list[str]) -> str:
    """One pattern that matches where one of these does.

    Those that begin with a word boundary and letters, or with a choice of such, share one boundary and stand by first letter: at
    most places of a text, one comparison then answers for all of them.
    """
    words: dict[str, dict[str, list[str]]] = {}
    others = []
    for p in patterns:
        flag = "i" if p.startswith("(?i)") else ""
        begin, choice = r"(?:\(\?i\))?\\b", r"[A-Za-z0-9](?![?*{+|])[^()|\[\]]*"
        rest = r"((?![?*{+])(?:[^()|]|\((?:[^()])*\))*)"
        if re.search(r"\\[()|]|\[", p):
            others.append(f"(?:{p})")
            continue
        if m := re.fullmatch(rf"{begin}\((?:\?:)?({choice}(?:\|{choice})*)\){rest}", p):
            found = [f"{c}{m[2]}" for c in m[1].split("|")]
        elif m := re.fullmatch(rf"{begin}([A-Za-z0-9]){rest}", p):
            found = [m[1] + m[2]]
        else:
            others.append(f"(?:{p})")
            continue
        for f in found:
            words.setdefault(flag, {}).setdefault(f[0].lower() if flag else f[0], []).append(f[1:])
    begun = [rf"(?{flag}:\b(?:" + "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in sorted(by.items())) + "))" for flag, by in words.items()]
    return "|".join(begun + others)


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike(by_first_letter(patterns)), F.lit(False)) if patterns else F.lit(False)


_TITLES, _TEXTS = ([f"(?i){p}" for p in x] for x in (rules.ADULT_TITLES, rules.ADULT_TEXTS))


def family_friendly(
    df: DataFrame, title_patterns: list[str] = _TITLES, text_patterns: list[str] = _TEXTS, venues: list[str] = rules.COMEDY_VENUES, api_sources: list[str] = rules.API_SOURCES
) -> DataFrame:
    """Without listings whose title or text matches, or that an API source has at one of the venues."""
    bad = any_pattern(F.col("title"), title_patterns) | any_pattern(F.col("description"), text_patterns)
    bad = bad | (F.col("source").isin(api_sources) & any_keyword(F.col("location_name"), venues))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def religious(title: Column, text: Column) -> Column:
    """Whether title or text speak of a religious service."""
    return any_pattern(F.concat_ws(" ", title, text), [f"(?i){p}" for p in rules.RELIGIOUS])


def meetup(title: Column) -> Column:
    """Whether a title is that of a meetup for the members of a platform."""
    return any_pattern(title, rules.MEETUPS)


def guide_article(title: Column, text: Column, places: list[str], least: int = 3) -> Column:
    """Whether a listing is an article about many places: `in A, B, C, and D`, or at least `least` places named."""
    named = reduce(lambda a, b: a + b, (F.coalesce(text.contains(p), F.lit(False)).cast("int") for p in places), F.lit(0))
    return F.coalesce(title.rlike(r"\bin [A-Z][\w ]+(?:, [A-Z][\w ]+){2,},? and [A-Z]"), F.lit(False)) | (named >= least)


def names_several_places(title: Column, places: list[str] = rules.ORANGE_COUNTY, least: int = 3) -> Column:
    """Whether a title is that of an article: `in A, B, C and D`, or at least `least` of the places, as whole words."""
    named = reduce(lambda a, b: a + b, (title.rlike(rf"(?i)\b{re.escape(p)}\b").cast("int") for p in places), F.lit(0))
    some = any_pattern(title, [rf"(?i)\b{re.escape(p)}\b" for p in places]) if least > 0 else F.lit(True)
    return F.coalesce(title.rlike(rules.SEVERAL_PLACES) | (some & (named >= least)), F.lit(False))


def family_listings(df: DataFrame) -> DataFrame:
    """What a run keeps by default: nothing for adults only, no meetup of a platform's members, no article about several places."""
    return family_friendly(df).filter(~meetup(F.col("title")) & ~names_several_places(F.col("title")))


def overlaps(start: Column, end: Column, begin, until) -> Column:
    """Starts before `until` and ends (or starts, where it has no end) at or after `begin`; both may be None."""
    last = F.coalesce(end, start)
    ok = F.lit(True)
    if until is not None:
        ok = ok & (start < F.lit(until))
    if begin is not None:
        ok = ok & (last >= F.lit(begin))
    return ok


def visible(status: Column) -> Column:
    return F.coalesce(~status.isin("draft", "rejected"), F.lit(True))


def search(df: DataFrame, text: str, columns: list[str], tags: str | None = None, empty_matches: bool = False) -> DataFrame:
    """Rows with the text in one of the columns, or in a tag, in any case."""
    if not text:
        return df if empty_matches else df.filter("false")
    wanted = text.lower()
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in columns), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(wanted)), F.lit(False))
    return df.filter(hit)


def day_bounds(day: datetime) -> tuple[datetime, datetime]:
    begin = day.replace(hour=0, minute=0, second=0, microsecond=0)
    return begin, begin + timedelta(days=1)


def range_bounds(name: str, now: datetime, week_start: int = 6, custom: tuple[datetime | None, datetime | None] = (None, None)) -> tuple[datetime | None, datetime | None]:
    """(begin, until) of a named date range; week_start counts from Monday = 0.  On a Sunday the weekend began yesterday."""
    today, tomorrow = day_bounds(now)
    if name == "today":
        return today, tomorrow
    if name == "week":
        begin = today - timedelta(days=(today.weekday() - week_start) % 7)
        return begin, begin + timedelta(days=7)
    if name == "weekend":
        if today.weekday() == 6:
            return today - timedelta(days=1), tomorrow
        saturday = today + timedelta(days=5 - today.weekday())
        return saturday, saturday + timedelta(days=2)
    if name == "month":
        begin = today.replace(day=1)
        return begin, (begin + timedelta(days=32)).replace(day=1)
    if name == "custom":
        begin, end = custom
        return begin and day_bounds(begin)[0], end and day_bounds(end)[1]
    return None, None


@dataclass
class ListingFilter:
    """What a reader has chosen.  apply() gives the rows; the rest describes and changes the choice."""

    categories: set[str] = field(default_factory=set)
    price: str = "all"  # all, free, paid
    dates: str = "all"  # all, today, week, weekend, month, custom
    custom: tuple[datetime | None, datetime | None] = (None, None)
    miles: float | None = None
    origin: str = "current"  # or home, which falls back to current
    sort: str = "date"  # date, distance, price

    def origin_of(self, current: tuple[float, float] | None, home: tuple[float, float] | None) -> tuple[float, float] | None:
        return (home or current) if self.origin == "home" else current

    def predicate(self, now: datetime, current: tuple[float, float] | None = None, home: tuple[float, float] | None = None) -> Column:
        ok = F.lit(True)
        if self.categories:
            ok = ok & F.col("category").isin(sorted(self.categories))
        if self.price == "free":
            ok = ok & price.is_free(F.col("price"))
        elif self.price == "paid":
            ok = ok & price.is_paid(F.col("price"))
        begin, until = range_bounds(self.dates, now, custom=self.custom)
        if begin is not None or until is not None:
            ok = ok & F.coalesce(overlaps(parse_timestamp(F.col("start_date")), parse_timestamp(F.col("end_date")), begin, until), F.lit(False))
        at = self.origin_of(current, home)
        if self.miles is not None and at:
            ok = ok & geo.within_miles(F.col("latitude"), F.col("longitude"), at, self.miles)
        return ok

    def order(self, current: tuple[float, float] | None = None, home: tuple[float, float] | None = None) -> list[Column]:
        at = self.origin_of(current, home)
        if self.sort == "distance" and at:
            away = geo.metres(F.col("latitude"), F.col("longitude"), *at)
            return [F.asc_nulls_last(away), F.asc("ord")]
        if self.sort == "price":
            return [F.asc(F.coalesce(price.tier(F.col("price")), F.lit(99))), F.asc("start_date"), F.asc("ord")]
        return [F.asc("start_date"), F.asc("ord")]

    def apply(self, df: DataFrame, now: datetime, current: tuple[float, float] | None = None, home: tuple[float, float] | None = None) -> DataFrame:
        return df.filter(self.predicate(now, current, home)).orderBy(*self.order(current, home))

    def active(self) -> list[str]:
        """Names of what is set."""
        return [n for n, on in (("category", self.categories), ("price", self.price != "all"), ("date", self.dates != "all"), ("distance", self.miles is not None), ("sort", self.sort != "date")) if on]

    def chips(self) -> list[tuple[str, str]]:
        """(name, text) of each filter that is set."""
        text = {"category": ", ".join(sorted(self.categories)), "price": self.price, "date": self.dates, "distance": f"{self.miles} mi", "sort": self.sort}
        return [(n, text[n]) for n in self.active()]

    def without(self, name: str) -> ListingFilter:
        reset = {"category": {"categories": set()}, "price": {"price": "all"}, "date": {"dates": "all", "custom": (None, None)}, "distance": {"miles": None}, "sort": {"sort": "date"}}
        return replace(self, **reset.get(name, {}))

    def toggled(self, category: str) -> ListingFilter:
        return replace(self, categories=self.categories ^ {category})
