"""Dates in prose: single days, lists, ranges, with or without a year.

    item  = month days [","] [year]  |  month day [","] [year] dash month day [","] [year]
    days  = day [dash day] { ("," | "and" | "&" | ", and") day [dash day] }

A month is an English name or its first three letters; a day is one or two digits, with or without an ordinal
ending, that are no clock time.  A day beyond the month's end runs on into the next month, one beyond 31
is none.  Without a year, a date is this year's, or next year's if it has begun by now.  An end without a year
follows its start; a start takes the year of its end, or the year before where it would come after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, and how dates are written.
MONTH = r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b\.?"
DAY = r"\d{1,2}(?!\d|:|/|\s*[ap]\.?m\b)(?:st|nd|rd|th)?\b"
YEAR = r"(?:,?\s*\d{4}\b)"
DASH = r"\s*[–—-]\s*"
COMMA = r"(?:\s*,\s*(?:and\s+|&\s*)?|\s+and\s+|\s*&\s*)"
_DAYS = rf"{DAY}(?:{DASH}{DAY})?(?:{COMMA}{DAY}(?:{DASH}{DAY})?)*"
_ACROSS = rf"{MONTH}\s+{DAY}{YEAR}?{DASH}{MONTH}\s+{DAY}{YEAR}?"
ITEM = rf"(?i)(?:{_ACROSS}|{MONTH}\s+{_DAYS}{YEAR}?)"
# A day with its year, by any word that begins like a month, and two of them as a range.
FULL = r"\w+ \d{1,2}, \d{4}"
_FULL_RANGE = rf"({FULL})\s*[–—-]\s*({FULL})"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

SPAN = "struct<first:date,last:date>"


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters; null for other words."""
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when((F.length(name) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The day, running on beyond the month's end; null for days beyond 31 and for no month."""
    return F.when(day.between(1, 31), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def _part(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, pattern: str, group: int = 0) -> Column:
    return _part(text, pattern, group).try_cast("int")


def _here(month: Column, day: Column, now: datetime) -> Column:
    """This year's day, or next year's."""
    this = date_of(F.lit(now.year), month, day)
    return F.when(this.cast("timestamp") < F.lit(now), date_of(F.lit(now.year + 1), month, day)).otherwise(this)


def _spans(item: Column, now: datetime) -> Column:
    """The spans of one item."""
    year = r"(\d{4})\b"
    ends = rf"(?i)^({MONTH})\s+({DAY})({YEAR}?){DASH}({MONTH})\s+({DAY})({YEAR}?)$"
    m1, d1, m2, d2 = month_number(_part(item, ends, 1)), _number(_part(item, ends, 2), r"\d+"), month_number(_part(item, ends, 4)), _number(_part(item, ends, 5), r"\d+")
    y1, y2 = _number(_part(item, ends, 3), year, 1), _number(_part(item, ends, 6), year, 1)
    later = F.struct(m2.alias("m"), d2.alias("d")) < F.struct(m1.alias("m"), d1.alias("d"))
    start = F.when(y1.isNotNull(), date_of(y1, m1, d1)).when(y2.isNotNull(), date_of(y2 - later.cast("int"), m1, d1)).otherwise(_here(m1, d1, now))
    end = date_of(F.coalesce(y2, F.year(start) + later.cast("int")), m2, d2)
    across = F.array(F.struct(start.alias("first"), end.alias("last")))

    month, given = month_number(F.regexp_extract(item, r"^([A-Za-z]+)", 1)), _number(item, r"[^\d]\s*(\d{4})$", 1)
    days = F.regexp_extract_all(F.regexp_replace(item, rf"{YEAR}$", ""), F.lit(rf"(?i){DAY}(?:{DASH}{DAY})?"), F.lit(0))
    on = lambda day: F.when(given.isNotNull(), date_of(given, month, day)).otherwise(_here(month, day, now))

    def span(d: Column) -> Column:
        first, last = _number(d, r"^(\d+)", 1), _number(d, r"[–—-]\s*(\d+)", 1)
        return _bound(on(first), lambda s: F.struct(s.alias("first"), F.coalesce(date_of(F.year(s), month, last), s).alias("last")))

    return F.when(item.rlike(ends), across).otherwise(F.transform(days, span))


def spans_in(text: Column, now: datetime) -> Column:
    """Array of (first, last) day of all dates in a text, in its order; a range that ends before it begins is none."""
    items = F.regexp_extract_all(text, F.lit(ITEM), F.lit(0))
    found = F.flatten(F.transform(items, lambda i: _spans(i, now)))
    return F.coalesce(F.filter(found, lambda s: s["first"] <= s["last"]), F.array().cast(f"array<{SPAN}>"))


def first_day(text: Column, now: datetime) -> Column:
    """The first day that a text names; null if none."""
    return F.get(spans_in(text, now), F.lit(0))["first"]


def _full_date(text: Column) -> Column:
    pattern = r"(\w+) (\d{1,2}), (\d{4})"
    return date_of(_number(text, pattern, 3), month_number(_part(text, pattern, 1)), _number(text, pattern, 2))


def full_dates(text: Column) -> Column:
    """Array of all days with year, in order, repeated ones too; ranges are their two ends."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(FULL), F.lit(0)), _full_date))


def full_range(text: Column) -> Column:
    """(first, last) of the first range of two days with years, else of the first day with a year (last is null); a range counts before days that precede it."""
    found = F.array(F.coalesce(_part(text, _FULL_RANGE, 1), _part(text, FULL)), _part(text, _FULL_RANGE, 2))
    return _bound(F.transform(found, _full_date), lambda days: F.struct(F.get(days, F.lit(0)).alias("first"), F.get(days, F.lit(1)).alias("last")))


def days_in_window(spans: Column, now: datetime, days: int) -> Column:
    """Array of the days of spans from today through so many days from now; repeated days once, in order."""
    begin, end = F.lit(now.date()), F.date_add(F.lit(now.date()), days)
    inside = F.filter(spans, lambda s: (s["first"] <= end) & (s["last"] >= begin))
    each = F.transform(inside, lambda s: F.sequence(F.greatest(s["first"], begin), F.least(s["last"], end), F.expr("interval 1 day")))
    return F.array_sort(F.array_distinct(F.flatten(each)))
