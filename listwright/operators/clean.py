"""Cleaning and rewording of texts that aggregators supply.  All word lists are parameters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from listwright.functions.text import text_hash, trimmed


def clean_text(text: Column, sites: list[str], promotions: list[str]) -> Column:
    """Without sentences that name a site and without promotional patterns; punctuation repaired."""
    names = "|".join(re.escape(s) for s in sites)
    out = F.regexp_replace(text, rf"(?i)[^.!?\n]*\b(?:{names})\b[^.!?\n]*[.!?\n]?", "") if sites else text
    for p in promotions:
        out = F.regexp_replace(out, p, "")
    for p, r in ((r"\s{2,}", " "), (r"\.\s*\.", "."), (r"^\s*[.!?]\s*", ""), (r"\s+([.!?,])", "$1")):
        out = F.regexp_replace(out, p, r)
    return trimmed(out)


def clean_title(title: Column, words: list[str]) -> Column:
    """Without parentheses that hold one of the words, and without what follows a dash and one of them."""
    any_ = "|".join(re.escape(w) for w in words)
    out = F.regexp_replace(title, rf"(?i)\s*\([^)]*(?:{any_})[^)]*\)", "")
    return F.trim(F.regexp_replace(out, rf"(?is)\s*[-–—]\s*(?:free\s+(?:for|with)\s+)?(?:{any_}).*$", ""))


def clean(df: DataFrame, aggregators: list[str], sites: list[str], promotions: list[str], words: list[str]) -> DataFrame:
    own = F.col("source").isin(aggregators)
    return df.withColumns({"description": F.when(own, clean_text(F.col("description"), sites, promotions)).otherwise(F.col("description")), "title": F.when(own, clean_title(F.col("title"), words)).otherwise(F.col("title"))})


def chosen(options: list[str], seed: Column) -> Column:
    """The option that a hash picks."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.abs(seed) % len(options) + 1).cast("int"))


def filled(template: Column, **fields: Column) -> Column:
    """{name} in a template by its value."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def brief(templates: list[str], label: Column) -> Column:
    return filled(chosen(templates, text_hash(F.col("source_id"))), title=F.col("title"), city=F.col("city"), label=label)


def swap_phrases(swaps: list[tuple[str, list[str]]]):
    """A function of (text, seed): each hit of a pattern takes the next of its replacements, counted on from the seed.

    Hits depend on those before them, which no built-in function can follow; texts go through in Arrow batches.
    """
    compiled = [(re.compile(p, re.I), r) for p, r in swaps]

    @F.pandas_udf(StringType())
    def run(text: pd.Series, seed: pd.Series) -> pd.Series:
        def one(t: str | None, n: int) -> str | None:
            if t is None:
                return None
            for pattern, words in compiled:
                def next_word(m: re.Match) -> str:
                    nonlocal n
                    word, n = words[abs(n) % len(words)], n + 1
                    return word[0].upper() + word[1:] if m[0][:1].isupper() else word

                t = pattern.sub(next_word, t)
            return t

        return pd.Series([one(t, int(n)) for t, n in zip(text, seed)], dtype=object)

    return run


def reword(df: DataFrame, aggregators: list[str], swaps: list[tuple[str, list[str]]], openers: str, starters: list[str], intros: list[str], templates: list[str], label: Column, shortest: int = 20, short: int = 100) -> DataFrame:
    """New wording for aggregators' descriptions: swapped phrases, another opener, an intro for short ones, a brief text for those too short."""
    seed = text_hash(F.col("source_id"))
    text = swap_phrases(swaps)(F.col("description"), seed)
    several = F.size(F.split(text, r"(?<=[.!?])\s+")) >= 2
    text = F.when(several, F.regexp_replace(text, rf"(?i)^(?:{openers})\b", chosen(starters, seed))).otherwise(text)
    text = F.when(F.length(text) < short, F.concat(filled(chosen(intros, seed), city=F.col("city")), text)).otherwise(text)
    text = F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))
    new = F.when(F.length(F.coalesce("description", F.lit(""))) < shortest, brief(templates, label)).otherwise(text)
    return df.withColumn("description", F.when(F.col("source").isin(aggregators), new).otherwise(F.col("description")))
