"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import dedup
from listwright.queries.projections import NORM
from listwright.queries.registry import listings, query

_KEY = f"concat(substr(start_date, 1, 10), ':', regexp_replace(lower(city), '\\s+', '', 'g'), ':', {NORM.format(c='title')})"
_SCORE = """(case when length(description) > 10 then 2 else 0 end + case when image_url <> '' then 3 else 0 end + case when latitude <> 0 and longitude <> 0 then 2 else 0 end
  + case when address <> '' then 1 else 0 end + case when location_name <> '' then 1 else 0 end + case when external_url <> '' and not contains(external_url, 'google.com/search') then 2 else 0 end
  + case when website_url <> '' and not contains(website_url, 'google.com/search') then 2 else 0 end)"""
# Days by the first letter, so that near copies share a day.
_DAYS = "concat('2024-01-', lpad(cast(1 + ascii(title) % 28 as varchar), 2, '0'), 'T00:00:00')"


@query("completeness", f"select source_id, {_SCORE}::int as score from {{listings}}")
def _(l, spark, d):
    return l.select("source_id", dedup.completeness().alias("score"))


@query("dedup_exact", f"with l as (select *, {_KEY} as key, {_SCORE} as score from {{listings}}) select arg_min(source_id, (-score, ord)) as source_id, key from l group by key")
def _(l, spark, d):
    return dedup.exact(l).select("source_id", "key")


def _by_letter(l):
    return l.withColumn("start_date", F.concat(F.lit("2024-01-"), F.lpad((1 + F.ascii("title") % 28).cast("string"), 2, "0"), F.lit("T00:00:00")))


@query("dedup_pairs", f"""with l as (select ord, {NORM.format(c='title')} as n, substr({_DAYS}, 1, 10) as day from {{listings}}), k as (select * from l where length(n) >= 10),
c as (select day, n, min(ord) as ord from k group by day, n)
select a.ord as ord_a, b.ord as ord_b, a.day from c a join c b on a.day = b.day and a.ord < b.ord and (
  (least(length(a.n), length(b.n)) / greatest(length(a.n), length(b.n)) > 0.5 and (contains(a.n, b.n) or contains(b.n, a.n)))
  or (abs(length(a.n) - length(b.n)) < 10 and levenshtein(substr(a.n, 1, 200), substr(b.n, 1, 200)) <= least(6, floor(least(length(a.n), length(b.n)) * 0.15))))
union all select c.ord, k.ord, k.day from k join c on k.day = c.day and k.n = c.n and k.ord <> c.ord""")
def _(l, spark, d):
    return dedup.candidate_pairs(_by_letter(l))


@query("duplicate_pairs", "with l as (select ord, lower(title) as t, substr(start_date, 1, 10) as d from {listings}) select a.ord as ord_a, b.ord as ord_b from l a join l b on a.t = b.t and a.d = b.d and a.ord < b.ord")
def _(l, spark, d):
    return dedup.duplicate_pairs(l)


# The choice depends on the order of rows, which SQL can't follow; tests hold it against a plain loop.
@query("dedup_greedy")
def _(l, spark, d):
    return dedup.greedy(_by_letter(l)).select("place", "ord", "source_id", "title", "start_date")


__all__ = ["listings"]
