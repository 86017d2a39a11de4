"""Queries of what runs keep: screened listings, cached answers, records that people edit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listwright import rules
from listwright.operators import edits
from listwright.operators.categorize import RULES
from listwright.plans import run
from listwright.queries.registry import query, table
from listwright.sources import cache

NOW = datetime(2024, 1, 13, 9, 30)
_PHRASES = ("", " 21+ night", " Wine tasting", " UYE brunch", " in Brea, Irvine, Tustin and Orange", " Story time", " from Anaheim by Tustin to Brea", " outdoor concert", " happy hour & craft")


def _any(patterns: list[str]) -> str:
    return "'" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "'"


def _scores() -> str:
    points = lambda w: f"case when contains(lower(name), '{w}') then 3 when contains(lower(description), '{w}') then 1 else 0 end"
    return ", ".join(f"{' + '.join(points(w.replace("'", "''")) for w in words)} as s{i}" for i, (_, words) in enumerate(RULES))


_BEST = " ".join(f"when s{i} > 0 and s{i} = greatest({', '.join(f's{k}' for k in range(len(RULES)))}) then '{name}'" for i, (name, _) in enumerate(RULES))
_MEETS = [p if p.startswith(r"\bUYE") else f"(?i:{p.removeprefix('(?i)')})" for p in rules.MEETUPS]
_PLACES = " + ".join(f"regexp_matches(name, '(?i)\\b{p.replace("'", "''")}\\b')::int" for p in rules.ORANGE_COUNTY)
_SAID = " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PHRASES))


@query("screened", f"""with t as (select *, concat(title, case ord % {len(_PHRASES)} {_SAID} end) as name from {{listings}}),
k as (select *, {_scores()} from t where not regexp_matches(name, {_any(rules.ADULT_TITLES).replace("'(", "'(?i)(", 1)}) and not regexp_matches(description, {_any(rules.ADULT_TEXTS).replace("'(", "'(?i)(", 1)}) and not regexp_matches(name, {_any(_MEETS)})
  and not regexp_matches(name, '{rules.SEVERAL_PLACES}') and {_PLACES} < 3 and start_date >= '2024-01-13T00:00:00.000Z')
select source_id, case when category <> 'Other' then category {_BEST} else 'Other' end as category from k""")  # fmt: skip
def _(l, spark, d):
    """What a run keeps by its default rules, with categories."""
    said = l.withColumn("title", F.concat("title", F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("ord") % len(_PHRASES) + 1).cast("int"))))
    return run.screen(said, run.Rules(), NOW).select("source_id", "category")


@query("cache_keys", """select source_id, concat(source_id, ':', substr(sha256(concat(title, '|', substr(description, 1, 300), '|', category)), 1, 16)) as enrichment, concat(source_id, ':', substr(sha256(title), 1, 16)) as verdict,
  concat('guide:', source_id, ':', substr(sha256(concat(title, '|', coalesce(city, ''), '|', category)), 1, 16)) as guide from {listings}""")  # fmt: skip
def _(l, spark, d):
    guide = l.select("source_id", F.col("source_id").alias("guide_id"), F.col("title").alias("name"), "city", "category", cache.enrichment_key().alias("enrichment"), cache.verdict_key().alias("verdict"))
    return guide.select("source_id", "enrichment", "verdict", cache.guide_key().alias("guide"))


@query("cache_merged", """with a as (select lang as kind, concat('k', doc_id // 3) as key, timestamp '2024-01-01' + to_days((doc_id % 20)::int) as cached_at, concat('a', doc_id % 7) as answer from documents),
b as (select lang as kind, concat('k', doc_id // 2) as key, timestamp '2023-12-01' + to_days((doc_id % 50)::int) as cached_at, concat('b', doc_id % 5) as answer from documents),
u as (select *, 0 as place from a where cached_at >= timestamp '2023-12-14 09:30:00' union all select *, 1 from b where cached_at >= timestamp '2023-12-14 09:30:00')
select kind, key, cached_at, answer from u qualify row_number() over (partition by kind, key order by cached_at desc, place, answer desc) = 1""")  # fmt: skip
def _(l, spark, d):
    """Two caches as one, without expired entries."""
    docs, id_ = table(spark, d, "documents"), F.col("doc_id")
    made = lambda n, first, many, name, kinds: docs.select(
        F.col("lang").alias("kind"), F.concat(F.lit("k"), F.floor(id_ / n).cast("string")).alias("key"), (F.lit(first).cast("timestamp") + F.make_dt_interval(id_ % many)).alias("cached_at"), F.concat(F.lit(name), (id_ % kinds).cast("string")).alias("answer")
    )
    both = [cache.live(made(*x), NOW) for x in ((3, "2024-01-01", 20, "a", 7), (2, "2023-12-01", 50, "b", 5))]
    return cache.newest(*both)


_OPS = ("upsert", "upsert", "edit", "upsert", "release", "edit", "upsert", "delete", "edit", "upsert", "other")


@query("replayed_edits", f"""with recursive o as (select user_id, row_number() over (partition by user_id order by event_id) as rn, case (event_id * 7 + user_id) % {len(_OPS)} {' '.join(f"when {i} then '{x}'" for i, x in enumerate(_OPS))} end as op, event_type as a, case when event_id % 2 = 0 then props end as b from events),
s as (select distinct user_id, 0::bigint as rn, null::varchar as a, null::varchar as b, false as edited, false as there from events
  union all select s.user_id, o.rn, case when o.op = 'delete' then null when o.op = 'edit' then coalesce(o.a, s.a) when o.op = 'upsert' and not s.edited then o.a else s.a end,
    case when o.op = 'delete' then null when o.op = 'edit' then coalesce(o.b, s.b) when o.op = 'upsert' and not s.edited then o.b else s.b end,
    case when o.op = 'edit' then true when o.op in ('release', 'delete') then false else s.edited end, case when o.op in ('edit', 'upsert') then true when o.op = 'delete' then false else s.there end
    from s join o on s.user_id = o.user_id and o.rn = s.rn + 1)
select concat('r', user_id) as record_name, a, b, edited from s where there qualify row_number() over (partition by user_id order by rn desc) = 1 and rn = (select max(rn) from o where o.user_id = s.user_id)""")  # fmt: skip
def _(l, spark, d):
    """A log of operations on records, one record for each user of the events, as the records that it leaves."""
    e = table(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, _OPS)), ((F.col("event_id") * 7 + F.col("user_id")) % len(_OPS) + 1).cast("int"))
    fields = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.when(F.col("event_id") % 2 == 0, F.col("props")))
    state = edits.replay(e.select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("record_name"), op.alias("op"), fields.alias("fields")))
    return state.select("record_name", F.col("fields")["a"].alias("a"), F.col("fields")["b"].alias("b"), "edited")
