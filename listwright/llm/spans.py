"""Places of pattern matches in texts, with built-in functions only.

Starts and ends count code points; ends are exclusive.  Patterns must not match the empty string.
Work grows with the length of a text and the number of its matches, not with their product: arrays
are bound once before a lambda reads them, running values are made in blocks of blocks, and parts
of long texts are cut from blocks of characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that one fold takes, and characters of a block of a long text.
_FOLD, _CHARACTERS = 512, 4096
NONE = "array<struct<start:int,number:int,end:int,kind:string,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each number and all before it; numbers: an array of int, none of which is null or negative."""
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    none = F.array().cast("array<int>")
    fold = lambda part: F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def blocks(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(x) + 1, F.lit(_FOLD)), lambda i: i <= F.size(x))
        return F.aggregate(starts, none, lambda acc, i: F.concat(acc, F.transform(fold(F.slice(x, i, F.lit(_FOLD))), lambda v: op(last(acc), v))))

    return bound(numbers, blocks)


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches that don't overlap; null for none."""

    def placed(found: Column) -> Column:
        # What ends with match i: all gaps up to it and all matches up to it.
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)))


def kept(found: Column, kind: str, number: int, valid) -> Column:
    """Valid places as (start, number, end, kind, value), none for null."""
    rows = F.transform(
        F.filter(found, lambda m: valid(m["value"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("number"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")),
    )
    return F.coalesce(rows, F.array().cast(NONE))


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(rows: DataFrame, text: str, spans: str, label: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with column `text` rewritten: spans (sorted by start) that overlap are one, for which label(kind of the first, length) stands.

    A step a projection, as each reads the one before more than once.  Names that begin with an underscore are taken.
    """
    t, s = F.col(text), F.col(spans)
    after = lambda i: F.coalesce(F.get("_ends", i - 1), F.lit(0))  # noqa: E731  where the spans before i end

    def cut(a: Column, b: Column) -> Column:
        i, j, size = F.floor(a / _CHARACTERS).cast("int"), F.floor((b - 1) / _CHARACTERS).cast("int"), F.lit(_CHARACTERS)
        whole = F.array_join(F.slice("_blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        far = F.concat(F.substr(F.get("_blocks", i), a - i * size + 1, size), whole, F.substr(F.get("_blocks", j), F.lit(1), b - j * size))
        return F.when(b <= a, "").when(i == j, F.substr(F.get("_blocks", i), a - i * size + 1, b - a)).otherwise(far)

    some = F.coalesce(F.size(s), F.lit(0)) > 0
    rows = rows.withColumns({"_ends": running(F.transform(s, lambda x: x["end"]), F.greatest), "_blocks": F.when(some, F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{_CHARACTERS}}}"), F.lit(0)))})
    # Groups of overlapping spans: the kind of the first, and where the group begins and ends.
    heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] >= after(i))
    rows = rows.withColumn("_heads", F.when(some, heads))
    group = lambda i, k: F.struct(F.get(s, i)["kind"].alias("kind"), after(i).alias("gap"), F.get(s, i)["start"].alias("start"), after(F.coalesce(F.get("_heads", k + 1), F.size(s))).alias("end"))
    rows = rows.withColumn("_groups", F.transform("_heads", group))
    parts = F.transform("_groups", lambda g: F.concat(cut(g["gap"], g["start"]), label(g["kind"], g["end"] - g["start"])))
    new = F.when(some, F.concat(F.array_join(parts, ""), cut(F.element_at("_ends", -1), F.length(t)))).otherwise(t)
    return rows.withColumn(text, new).drop("_ends", "_blocks", "_heads", "_groups")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substr(number, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0
