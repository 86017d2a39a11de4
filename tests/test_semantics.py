"""Golden examples and traps."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listwright.functions import geo, price, text
from listwright.operators import changes, dedup, enrich, filters
from listwright.operators.categorize import RULES, categorize
from listwright.schema import conform
from listwright.sources import payloads


def listings(spark, *rows):
    base = {"source": "test", "city": "Los Angeles", "metro": "los-angeles", "start_date": "2026-06-15T10:00:00.000Z", "description": ""}
    full = [{**base, "source_id": f"test:{i}", "ord": i, **r} for i, r in enumerate(rows)]
    names = sorted({k for r in full for k in r})
    kinds = {"ord": "long", "latitude": "double", "longitude": "double", "tags": "array<string>", "is_featured": "boolean"}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    return conform(df, ord=F.col("ord"))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "titles, left",
    [
        ([("Party", {}), ("Party", {})], 1),
        ([("Summer Family Music Festival in the Park", {}), ("Summer Family Music Festival in the Park (Free)", {})], 1),
        ([("Big Kids Art Festival", {}), ("Big Kids Art Festival", {"start_date": "2026-06-16T10:00:00.000Z"})], 2),
        ([("Art Class", {}), ("Art Classes", {})], 2),
        ([("Community Garden Day", {}), ("Community Garden Day", {"city": "Irvine"})], 1),
        ([("Anaheim Convention Hall Comic Convention", {"location_name": "Convention Hall"}), ("Comic Convention", {"location_name": "Convention Hall"})], 1),
    ],
)
def test_greedy(spark, titles, left):
    assert dedup.greedy(listings(spark, *({"title": t, **more} for t, more in titles))).count() == left


@pytest.mark.parametrize("first", [True, False])
def test_greedy_keeps_the_more_complete(spark, first):
    rows = [{"title": "Family Picnic Day", "image_url": "https://x/y.jpg"}, {"title": "Family Picnic Day"}]
    out = dedup.greedy(listings(spark, *(rows if first else rows[::-1]))).collect()
    assert [r.image_url for r in out] == ["https://x/y.jpg"] and out[0].place == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def same_title(a, b):
    short, long_ = sorted([a, b], key=len)
    if a == b or (len(short) > len(long_) / 2 and short in long_):
        return True
    return len(long_) - len(short) < 10 and levenshtein(a[:200], b[:200]) <= min(6, len(short) * 15 // 100)


def plain_resolution(rows):
    """Row by row against all that stay so far, of all days."""
    import re

    kept = []  # [key, row that stays, ord of the first]
    for r in rows:
        hit = next((k for k in kept if k[0] == r["key"]), None)
        for k in kept if hit is None else []:
            o = k[1]
            if len(r["norm"]) < 10 or len(o["norm"]) < 10 or o["day"] != r["day"]:
                continue
            match = same_title(r["norm"], o["norm"])
            if not match and r["venue"] and len(r["venue"]) > 3 and r["venue"] == o["venue"]:
                x, y = (re.sub(r"\s*".join(r["venue"].split()), "", t["norm"]).strip() for t in (r, o))
                match = len(x) >= 5 and len(y) >= 5 and same_title(x, y)
            if match:
                hit = k
                break
        if hit is None:
            kept.append([r["key"], r, r["ord"]])
        elif r["score"] > hit[1]["score"]:
            hit[1] = r
    return sorted((k[2], k[1]["ord"]) for k in kept)


@pytest.mark.parametrize("seed", [5, 6])
def test_greedy_like_a_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    words = "garden music family story craft movie night park autumn river picnic".split()

    def title():
        t = " ".join(rng.choices(words, k=rng.randint(2, 6)))
        at = rng.randrange(len(t))
        return rng.choice([t, t[:at] + rng.choice("xyz") + t[at + 1 :], t + " old park hall", t + "s", f"{t} (Free)"])

    rows = [{"title": title(), "start_date": f"2026-06-{rng.randint(10, 11)}T10:00:00", "description": "x" * rng.randint(0, 20), "location_name": rng.choice(["Old Park Hall", None])} for _ in range(120)]
    rows += [dict(rng.choice(rows), description=rng.choice(["", "x" * 30])) for _ in range(80)]
    df = listings(spark, *rows)
    venue = F.trim(F.regexp_replace(F.lower("location_name"), r"[^a-z0-9\s]", ""))
    keys = [r.asDict() for r in dedup.with_key(df).select("ord", "day", "key", "norm", "score", venue.alias("venue")).orderBy("ord").collect()]
    assert sorted((r.place, r.ord) for r in dedup.greedy(df).collect()) == plain_resolution(keys)


def test_pairs_decided_by_each_rule(spark):
    long_ = " ".join(f"word{i % 7} and" for i in range(60))
    titles = ["Autumn River Concert", "Autumn Rivers Concert", "Autumn Fiver Concert", "Autumn River Concert", "The Autumn River Concert at noon", "Picnic", "Pottery for beginners", long_, long_ + " x", long_[:-60], "aaaaaaaaaaaa", "aaaaaaaaaaaaa"]
    df = listings(spark, *({"title": t} for t in titles))
    norm = [r.norm for r in dedup.with_key(df).orderBy("ord").select("norm").collect()]
    first = {n: norm.index(n) for n in norm}
    want = {(first[n], i) for i, n in enumerate(norm) if first[n] != i and len(n) >= 10}
    want |= {(i, j) for i in set(first.values()) for j in set(first.values()) if i < j and min(len(norm[i]), len(norm[j])) >= 10 and same_title(norm[i], norm[j])}
    assert {(r.ord_a, r.ord_b) for r in dedup.candidate_pairs(df).collect()} == want and len(want) > 5


def test_edit_distance():
    assert dedup.edit_distance("kitten", "sitting", 3) == 3 and dedup.edit_distance("kitten", "sitting", 2) == 3
    assert dedup.edit_distance("", "abc", 5) == 3 and dedup.edit_distance("abc", "abc", 0) == 0


@pytest.mark.parametrize("t, tier", [("Free", 0), ("$5", 1), ("$15", 2), ("$30", 3), ("$75", 4), ("$150", 5), ("$10.50", 5), (None, None), ("", None), ("Donation", 1), ("Ages 12 & under", 2), ("$0", 0)])
def test_price_tier(spark, t, tier):
    assert value(spark, price.tier(F.lit(t).cast("string"))) == tier


@pytest.mark.parametrize("t, p", [("entry is free today", "Free"), ("free parking, $5", "$5"), ("complimentary", "Free"), ("$12.50 – $20", "$12.50 - $20"), ("suggested donation", "Suggested donation"), ("", None), ("nothing", None)])
def test_extract_price(spark, t, p):
    assert value(spark, price.extract(F.lit(t))) == p


def test_text(spark):
    assert value(spark, text.clean_description(F.lit("<p>Hello <b>world</b></p>"))) == "Hello world"
    assert value(spark, text.clean_description(F.lit("Tom &amp; Jerry &lt;3"))) == "Tom & Jerry <3"
    assert value(spark, text.clean_description(F.lit("Hello   \n\n  world"))) == "Hello world"
    assert len(value(spark, text.clean_description(F.lit("A" * 600)))) == 500
    assert value(spark, text.decode_entities(F.lit(" caf&#233; &#8211; a &amp; b&rsquo;s "))) == "café – a & b's"
    assert value(spark, text.normal_title(F.lit("San Diego Comic-Con 2026 (Free)"))) == "comiccon"
    assert value(spark, text.normal_title(F.lit("X in the Park at Y"))) == "x"
    assert value(spark, text.text_hash(F.lit("abc"))) == 96354
    assert value(spark, text.city_of_address(F.lit("1 Main St, Irvine, CA 92602, USA"))) == "Irvine"
    assert value(spark, text.parse_time(F.lit("from 9:30a – 11a"))) == "09:30"
    assert value(spark, text.parse_time(F.lit("12 pm"))) == "12:00"
    assert value(spark, text.search_url(F.lit("A b (c)"), F.lit(""))).endswith("q=A%20b%20(c)")


def test_categories(spark):
    c = lambda a, b: value(spark, categorize(F.lit(a), F.lit(b), RULES))
    assert c("Weekly Storytime for Kids", "") == "Storytime"
    assert c("Downtown Farmers Market", "") == "Farmers Market"
    assert c("A day", "Take a hike through the trails") == "Outdoor"
    assert c("Neighborhood Potluck", "Come join") == "Other"


def test_stale_compares_texts(spark):
    now = datetime(2026, 6, 15, 12)
    stale = lambda s: value(spark, filters.stale(F.lit(s), now))
    assert stale("2026-06-14T23:59:59Z") and not stale("2026-06-15T00:00:00.000Z") and not stale("2026-06-16")
    assert stale("2026-06-15T00:00:00") and stale("2026-06-15") and stale("2026-06-15 10:00:00")


def test_date_ranges():
    sunday, saturday, wednesday = datetime(2024, 1, 14, 9), datetime(2024, 1, 13, 9), datetime(2024, 1, 10, 9)
    assert filters.range_bounds("weekend", sunday) == (datetime(2024, 1, 13), datetime(2024, 1, 15))
    assert filters.range_bounds("weekend", saturday) == (datetime(2024, 1, 13), datetime(2024, 1, 15))
    assert filters.range_bounds("weekend", wednesday) == (datetime(2024, 1, 13), datetime(2024, 1, 15))
    assert filters.range_bounds("week", wednesday) == (datetime(2024, 1, 7), datetime(2024, 1, 14))
    assert filters.range_bounds("month", datetime(2024, 12, 5)) == (datetime(2024, 12, 1), datetime(2025, 1, 1))


def test_filter_object(spark):
    f = filters.ListingFilter(categories={"Music"}, miles=5)
    assert f.active() == ["category", "distance"] and f.without("category").active() == ["distance"]
    assert f.toggled("Craft").categories == {"Music", "Craft"} and f.chips()[0] == ("category", "Music")
    df = listings(spark, {"title": "near", "latitude": 33.69, "longitude": -117.83}, {"title": "far", "latitude": 34.05, "longitude": -118.24}, {"title": "none", "latitude": 0.0, "longitude": 0.0})
    out = filters.ListingFilter(miles=5).apply(df, datetime(2026, 6, 1), current=(33.6846, -117.8265)).collect()
    assert [r.title for r in out] == ["near"]


def test_distance(spark):
    d = value(spark, geo.metres(F.lit(33.6846), F.lit(-117.8265), 34.0522, -118.2437))
    assert abs(d - 56200) < 600


def test_diff(spark):
    base = listings(spark, {"title": "a", "latitude": 1.0, "longitude": 2.0, "image_url": "https://images.unsplash.com/x"}, {"title": "b", "latitude": 1.0, "longitude": 2.0, "image_url": "https://own/x.jpg"}, {"title": "c"})
    now = listings(spark, {"title": "a2"}, {"title": "b2", "city": "Irvine"}, {"title": "x", "source_id": "test:9"})
    out = {r.source_id: r for r in changes.diff(now, base).collect()}
    assert {k: r.change_type for k, r in out.items()} == {"test:0": "changed", "test:1": "changed", "test:2": "removed", "test:9": "new"}
    assert out["test:0"].latitude == 1.0 and out["test:0"].image_url is None
    assert out["test:1"].latitude is None and out["test:1"].image_url == "https://own/x.jpg"


def test_deletes_keep_vanished_sources(spark):
    removed = listings(spark, {"source_id": "gone:1"}, {"source_id": "alive:1"}, {"source_id": "alive:2"})
    live = listings(spark, {"source": "alive"})
    assert [r.source_id for r in changes.deletes(removed, live, 1).collect()] == ["alive:1"]


def test_contradictions(spark):
    df = listings(spark, {"title": "$7 Movie", "category": "Free Movie", "price": "Free"}, {"title": "Show ($12)", "price": "free", "category": "Music"})
    assert [(r.category, r.price) for r in enrich.contradictions(df).orderBy("ord").collect()] == [("Other", "$7"), ("Music", "$12")]


def test_ical(spark):
    payload = "BEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Kids\\, fun\r\nDESCRIPTION:one\r\n  two\\nthree\r\nDTSTART;VALUE=DATE:20260615\r\nLOCATION:Hall\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:No date\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:u2\r\nSUMMARY:T\r\nDTSTART:20260616T101500Z\r\nEND:VEVENT\r\n"
    rows = payloads.ical(spark.createDataFrame([(0, payload)], "ord long, payload string"), "cal").orderBy("ord").collect()
    assert [(r.source_id, r.title, r.start_date, r.is_all_day) for r in rows] == [("cal:u1", "Kids, fun", "2026-06-15T00:00:00", True), ("cal:u2", "T", "2026-06-16T10:15:00Z", False)]
    assert rows[0].description == "one two three"


def test_json_ld(spark):
    one = '<script type="application/ld+json">{"@type":"Event","name":"A &amp; B","startDate":"2026-06-15","image":["i1","i2"],"location":{"name":"Hall","address":{"addressLocality":"Irvine"}}}</script>'
    graph = '<script type="application/ld+json">{"@graph":[{"@type":"ChildrensEvent","name":"G","startDate":"2026-06-16","image":{"url":"i3"}},{"@type":"Place"}]}</script>'
    items = '<script type="application/ld+json">{"itemListElement":[{"item":{"@type":"Event","name":"L","startDate":"2026-06-17"}}]}</script><script type="application/ld+json">{broken</script>'
    pages = spark.createDataFrame([(0, "https://p/1", one + graph + items)], "ord long, url string, html string")
    rows = payloads.json_ld(pages, "ld").orderBy("ord").collect()
    assert [(r.title, r.start_date, r.image_url) for r in rows] == [("A & B", "2026-06-15", "i1"), ("G", "2026-06-16", "i3"), ("L", "2026-06-17", None)]
    assert rows[0].city == "Irvine" and rows[0].external_url == "https://p/1"


def test_calendar_api(spark):
    payload = '{"events":[{"id":1,"title":"<b>Zoo</b> day","description":"x","start_date":"2026-06-15 10:00:00","all_day":false,"image":false,"venue":{"venue":"Zoo","city":"LA"},"cost":"","categories":[{"name":"Kids"}]}]}'
    r = payloads.calendar_api(spark.createDataFrame([(0, payload), (1, "nonsense")], "ord long, payload string"), "zoo").collect()
    assert [(x.source_id, x.title, x.city, x.image_url, x.price, x.tags) for x in r] == [("zoo:1", "Zoo day", "LA", None, None, ["Kids"])]


def test_ticket_events(spark):
    payload = """{"events":[{"id":"a","name":"Show","dates":{"start":{"localDate":"2026-06-15"},"status":{"code":"onsale"}},"images":[{"url":"s","ratio":"16_9","width":10},{"url":"w","ratio":"16_9","width":90}],
      "priceRanges":[{"min":10,"max":25}],"venues":[{"name":"V","city":"C"}]},{"id":"b","name":"Off","dates":{"start":{"localDate":"2026-06-15"},"status":{"code":"cancelled"}}},{"id":"a","name":"Again","dates":{"start":{"localDate":"2026-06-15"}}}]}"""
    r = payloads.ticket_events(spark.createDataFrame([(0, payload)], "ord long, payload string")).collect()
    assert [(x.title, x.start_date, x.image_url, x.price) for x in r] == [("Show", "2026-06-15T00:00:00", "w", "$10-$25")]


def test_gather_isolates_failures(spark):
    good = lambda s: listings(s, {"title": "ok"}).drop("ord")
    bad = lambda s: s.read.json("/nowhere/at/all")
    out, failed = payloads.gather(spark, "la", {"good": (["la"], good), "bad": (["la"], bad), "other": (["oc"], bad)})
    assert out.count() == 1 and list(failed) == ["bad"]


def test_run_incremental(spark):
    from listwright.plans import run

    rules, now = run.Rules(), datetime(2026, 6, 1)
    raw = listings(spark, {"title": "Storytime at the hall"}, {"title": "Storytime at the hall"}, {"title": "Old", "start_date": "2026-05-01T00:00:00.000Z"})
    table, changed = run.incremental(raw, raw.limit(0), run.Tables(), rules, now)
    assert [r.category for r in table.collect()] == ["Storytime"] and changed.count() == 1


def test_streaming(spark, tmp_path):
    from listwright.streaming import landing

    source = tmp_path / "in"
    listings(spark, {"title": "a"}, {"title": "b", "source_id": "test:0"}).drop("ord").coalesce(1).write.json(str(source))
    rows = landing.distinct_arrivals(landing.landing(spark, str(source)))
    landing.upsert(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert landing.newest(spark, str(tmp_path / "out")).count() == 1
