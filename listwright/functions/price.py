"""Prices that are display texts: predicates, tiers, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_free(price: Column) -> Column:
    p = F.lower(F.trim(price))
    return F.coalesce((p == "free") | (p == "$0") | (p == "0") | p.contains("free"), F.lit(False))


def is_paid(price: Column) -> Column:
    return F.coalesce(F.trim(price) != "", F.lit(False)) & ~is_free(price)


def amounts(price: Column) -> Column:
    """Amounts with a dollar sign; only if there are none, plain numbers."""
    dollars = F.regexp_extract_all(price, F.lit(r"\$\s*(\d+(?:\.\d{1,2})?)"), F.lit(1))
    numbers = F.regexp_extract_all(price, F.lit(r"(\d+(?:\.\d{1,2})?)"), F.lit(1))
    return F.transform(F.when(F.size(dollars) > 0, dollars).otherwise(numbers), lambda a: a.cast("double"))


def tier(price: Column) -> Column:
    """0 (free) to 5; null if unknown.  The tiers are ranges of whole numbers, so that 10.5 lies in none and counts as 5."""
    top = F.array_max(amounts(price))
    graded = F.when(top == 0, 0).when(top.between(1, 10), 1).when(top.between(11, 25), 2).when(top.between(26, 50), 3).when(top.between(51, 100), 4).otherwise(5)
    return F.when(F.coalesce(F.trim(price), F.lit("")) == "", F.lit(None)).when(is_free(price), 0).when(top.isNull(), 1).otherwise(graded).cast("int")


def display(price: Column) -> Column:
    return F.when(tier(price) == 0, "FREE").when(tier(price) > 0, "$")


# How prose tells a price; the first that holds counts.
FREE, NOT_FREE, FREE_TOO = r"(?i)\bfree\b", r"(?i)free\s*(?:parking|wifi|with)", r"(?i)no charge|complimentary"
INCLUDED, DOLLARS = r"(?i)included with (?:park |museum )?admission", r"\$(\d+(?:\.\d{2})?)\s*(?:[-–]\s*\$(\d+(?:\.\d{2})?))?"
SUGGESTED, DONATION = r"(?i)suggested\s+donation", r"(?i)\bdonation\b"


def extract(text: Column) -> Column:
    """A price told in prose; `free` wins unless it is parking, wifi or `free with`."""
    low, high = F.regexp_extract(text, DOLLARS, 1), F.regexp_extract(text, DOLLARS, 2)
    amount = F.when(low != "", F.concat(F.lit("$"), low, F.when(high != "", F.concat(F.lit(" - $"), high)).otherwise("")))
    free = (text.rlike(FREE) & ~text.rlike(NOT_FREE)) | text.rlike(FREE_TOO)
    told = F.when(free, "Free").when(text.rlike(INCLUDED), "Included with admission").when(amount.isNotNull(), amount).when(text.rlike(SUGGESTED), "Suggested donation").when(text.rlike(DONATION), "Donation")
    return F.when(text != "", told)
