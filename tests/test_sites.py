"""Readers of sites' pages and the grammar of dates, on hand-made and random pages, against plain loops."""

import calendar
import json
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listwright.functions import dates
from listwright.schema import numbered
from listwright.sources import apis, sites

NOW = datetime(2024, 1, 13, 9, 30)
SITE = sites.Site("venue-x", "x", "https://x.example.org", "Irvine", "orange-county", "Hall")
MONTHS = list(calendar.month_name)[1:]


def pages(spark, *html, url="https://x.example.org/p"):
    return spark.createDataFrame([(i, f"{url}{i}", h) for i, h in enumerate(html)], "ord long, url string, html string")


def state(text):
    return f'<html><script id="__NEXT_DATA__" type="application/json">{text}</script></html>'


def found_objects(doc, keys):
    out = [doc] if isinstance(doc, dict) and all(k in doc for k in keys) else []
    for v in doc.values() if isinstance(doc, dict) else doc if isinstance(doc, list) else ():
        out += found_objects(v, keys)
    return out


def random_document(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, 1, "x", True, [], {}])
    if rng.random() < 0.5:
        return [random_document(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: random_document(rng, depth - 1) for k in rng.sample(["a", "b", "slug", "t", "c d", 'e"f'], rng.randint(0, 4))}


def test_objects_at_any_depth(spark):
    rng = random.Random(1)
    docs = [random_document(rng, rng.randint(1, 9)) for _ in range(150)]
    deep = {"slug": 1, "t": None}
    for _ in range(40):
        deep = rng.choice([[deep], {"k": deep}])
    docs.append(deep)
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i long, j string")
    got = {r.i: sorted(r.f or []) for r in rows.select("i", F.transform(sites.objects_with(F.col("j"), "slug", "t"), lambda v: F.to_json(v)).alias("f")).collect()}
    for i, d in enumerate(docs):
        assert sorted(json.dumps(json.loads(x), sort_keys=True) for x in got[i]) == sorted(json.dumps(x, sort_keys=True) for x in found_objects(d, ["slug", "t"]))


def test_damaged_states_give_no_rows(spark):
    good = {"title": {"html": "<b>Film</b> night"}, "activeStartDate": "2024-01-20T19:00:00", "slug": "s", "sys": 7, "programTagline": {"raw": []}, "filmDescription1": "Told &amp; shown"}
    bad = [None, "", "<html>", state(""), state("{"), state("null"), state("[1,2"), state(json.dumps({"activeStartDate": 5, "title": "T"})), state(json.dumps([{**good, "title": None}, {**good, "activeStartDate": "soon"}, {**good, "activeStartDate": "2024-06-01"}])), state(json.dumps({**good, "hideFromCalendar": True}))]
    assert sites.state_events(pages(spark, *bad), SITE, NOW).count() == 0
    rows = sites.state_events(pages(spark, *bad, state(json.dumps({"props": [[{"x": good}]]}))), SITE, NOW).collect()
    assert [(r.source_id, r.title, r.description, r.start_date, r.external_url, r.city) for r in rows] == [("x:s", "Film night", "Told & shown", "2024-01-20T19:00:00", "https://x.example.org/s", "Irvine")]


def on(year, month, day):
    return date(year, month, 1) + timedelta(day - 1) if 1 <= day <= 31 else None


def here(month, day):
    d = on(2024, month, day)
    return on(2025, month, day) if d and datetime(d.year, d.month, d.day) < NOW else d


@pytest.mark.parametrize("seed", range(3))
def test_random_lists_of_dates(spark, seed):
    rng = random.Random(seed)
    cases = []
    for i in range(120):
        text, want = [], []
        for _ in range(rng.randint(0, 4)):
            m, year = rng.randint(1, 12), rng.choice([None, rng.randint(2023, 2027)])
            name = rng.choice([MONTHS[m - 1], MONTHS[m - 1][:3], MONTHS[m - 1].upper(), MONTHS[m - 1][:3] + "."])
            tail = f"{rng.choice([', ', ' '])}{year}" if year else ""
            place = lambda d: on(year, m, d) if year else here(m, d)  # noqa: B023, E731
            if rng.random() < 0.3:  # a range across months
                m2, y2 = rng.randint(1, 12), rng.choice([None, rng.randint(2023, 2027)])
                d1, d2 = rng.randint(1, 31), rng.randint(1, 31)
                later = (m2, d2) < (m, d1)
                first = on(year, m, d1) if year else on(y2 - later, m, d1) if y2 else here(m, d1)
                last = on(y2 or first.year + later, m2, d2)
                text.append(f"{name} {d1}{tail} {rng.choice('–—-')} {MONTHS[m2 - 1]} {d2}{f', {y2}' if y2 else ''}")
                want += [(first, last)] if first <= last else []
            else:
                parts = []
                for _ in range(rng.randint(1, 4)):
                    d = rng.randint(1, 35)
                    if rng.random() < 0.3:
                        e = rng.randint(1, 31)
                        parts.append(f"{d}{rng.choice(['-', ' – '])}{e}")
                        first = place(d)
                        last = first and on(first.year, m, e)
                        want += [(first, last)] if first and first <= last else []
                    else:
                        parts.append(f"{d}{rng.choice(['', '', 'th'])}")
                        want += [(place(d), place(d))] if place(d) else []
                text.append(f"{name} {rng.choice([', ', ' and ', ' & ', ', and ']).join(parts)}{tail}")
        words = ["at 7:30 pm", "Maybe 5", "room 12", "9 am", "in 2024", "3/4", ""]
        cases.append((i, "; ".join(f"{rng.choice(words)} x {t} x" for t in text), want))
    rows = spark.createDataFrame([c[:2] for c in cases], "i long, t string").select("i", "t", dates.spans_in(F.col("t"), NOW).alias("s"))
    got = {r.i: [(x["first"], x["last"]) for x in r.s] for r in rows.collect()}
    for i, text, want in cases:
        assert got[i] == want, text


@pytest.mark.parametrize(
    "text, spans",
    [
        ("July 4th and 5th, 2024", ["2024-07-04", "2024-07-05"]), ("Feb 30, 2024", ["2024-03-01"]), ("Jan 0, 2024", []), ("Jan 13", ["2025-01-13"]), ("Jan 14", ["2024-01-14"]), ("Marching 3, 2024", []),
        ("May 5 2024", ["2024-05-05"]), ("SAT, APR 6, 9AM & 5 pm", ["2024-04-06"]), ("March 3, 12:30", ["2024-03-03"]), ("March 3-4/5", ["2024-03-03"]), (None, []), ("", []), ("Dec 9-5, 2024", []), ("Summer 12, 2024", []),
    ],
)
def test_dates(spark, text, spans):
    r = spark.createDataFrame([(text,)], "t string").select(dates.spans_in(F.col("t"), NOW).alias("s")).first()
    assert [str(x["first"]) for x in r.s] == spans


def test_days_in_the_window(spark):
    text = "Jan 10 - 15, Jan 14, 2024; Feb 3; June 1, 2025; Jan 15, 2024"
    r = spark.createDataFrame([(text,)], "t string").select(dates.days_in_window(dates.spans_in(F.col("t"), NOW), NOW, 60).alias("d"), dates.full_dates(F.col("t")).alias("f")).first()
    assert [str(d) for d in r.d] == ["2024-01-14", "2024-01-15", "2024-02-03"] and [str(d) for d in r.f] == ["2024-01-14", "2025-06-01", "2024-01-15"]


def test_links_within_budgets(spark):
    rows = [("a", 2, '<a href="/e/3"></a>'), ("a", 1, '<a href="/e/1?x"></a><a href="/c/9"></a><a href="/e/2#y"></a><a href="/e/1"></a>'), ("b", 0, '<a href="/e/3"></a>' * 3), ("b", 1, None), ("c", 1, "")]
    lists = spark.createDataFrame(rows, "site string, ord long, html string")
    patterns = [r'href="(/e/[^"]+)"', r'href="(/c/[^"]+)"']
    got = lambda most: [(r.site, r.link) for r in sites.first_links(lists, patterns, most).orderBy("site", "place").collect()]
    assert got(9) == [("a", "/e/1"), ("a", "/e/2"), ("a", "/c/9"), ("a", "/e/3"), ("b", "/e/3")]
    assert got(2) == [("a", "/e/1"), ("a", "/e/2"), ("b", "/e/3")]
    kept = sites.first_links(lists, patterns, 1, clean=False, not_links="x$").collect()
    assert sorted((r.site, r.link) for r in kept) == [("a", "/e/2#y"), ("b", "/e/3")]


def test_detail_pages(spark):
    how = sites.Details([r'href="(/events/[a-z0-9]+)"'], ["Events"], tickets="general|admission")
    page = lambda title, on_, more="": f'<meta property="og:title" content="{title} | Museum"/><p>{on_}</p>{more}'
    html = [
        page("Show", "December 14, 2023 – April 18, 2024", '<meta property="og:image" content="/a.png"/><i>$7.50 general</i>'), page("Past and gone", "January 2, 2023"), page("Later", "April 1, 2024"), page("", "March 1, 2024"), page("Fair", "Foo 1, 2024"),
        '<h1 class="t"> Walk </h1> January 20, 2024, then February 1, 2024 - February 3, 2024', None, "cut off",
    ]
    details = spark.createDataFrame([(f"https://x.example.org/events/{i}", h) for i, h in enumerate(html)], "url string, html string")
    lists = spark.createDataFrame([(0, "".join(f'<a href="/events/{i}">' for i in range(12)))], "ord long, html string")
    rows = sorted((r.source_id, r.title, r.start_date, r.end_date, r.price, r.image_url) for r in sites.detail_events(lists, details, SITE, how, NOW).collect())
    assert rows == [
        ("x:0", "Show", "2024-01-13T00:00:00", "2024-04-18T00:00:00", "$7.50 general", "https://x.example.org/a.png"), ("x:1", "Past and gone", "2023-01-02T00:00:00", None, None, None),
        ("x:5", "Walk", "2024-02-01T00:00:00", "2024-02-03T00:00:00", None, None),
    ]


def test_program_pages(spark):
    card = '<article class="node"><h2><a href="/programs/a">Art &amp; play</a></h2><p class="date">Sundays</p><p class="summary">For <b>all</b></p><img class="i" src="/i.png"></article>'
    links = '<a href="/programs/a">again</a><a href="/calendar/b"> Songs </a><a href="/calendar/c">View</a><a href="/other/d">no</a><a href="https://y.example.org/programs/z">no</a>'
    lists = spark.createDataFrame([(0, links), (1, card + links), (2, None)], "ord long, html string")
    details = spark.createDataFrame([("https://x.example.org/programs/a", "March 1, 2024 and January 20, 2024, not June 1, 2025, March 1, 2024")], "url string, html string")
    rows = sites.program_dates(lists, details, SITE, NOW, otherwise="A program.").orderBy("ord").collect()
    assert [(r.source_id, r.title, r.start_date, r.is_recurring, r.description) for r in rows] == [
        ("x:-programs-a-2024-03-01", "again", "2024-03-01T10:00:00", True, ""), ("x:-programs-a-2024-01-20", "again", "2024-01-20T10:00:00", True, ""), ("x:-programs-a-2024-03-01", "again", "2024-03-01T10:00:00", True, ""),
        ("x:-calendar-b", "Songs", "2024-01-13T10:00:00", True, "A program."),
    ]
    card_first = sites.program_dates(lists.filter("ord = 1"), details.filter("false"), SITE, NOW).filter("title like 'Art%'").first()
    assert (card_first.title, card_first.description, card_first.image_url, card_first.is_recurring) == ("Art &amp; play", "For all Schedule: Sundays.", "https://x.example.org/i.png", True)


DAY = re.compile(r"^((?:SUN|MON|TUE|WED|THU|FRI|SAT),?\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+\d{1,2})", re.I)


def windows(lines):
    """By one pass over the lines."""
    out, seen = [], set()
    for i in range(len(lines) - 2):
        m = DAY.match(lines[i])
        place, title = lines[i + 1], lines[i + 2]
        if not m or place != place.upper() or not 5 <= len(title) <= 100 or re.match(r"(?i)(SUN|MON|TUE|WED|THU|FRI|SAT|BEGINNING|EVERY|LEARN)", title) or (title == title.upper() and len(title) < 40):
            continue
        if (m[1], title) in seen:
            continue
        seen.add((m[1], title))
        far = [x for x in lines[i + 3 : i + 8] if len(x) > 50 and x != x.upper() and not re.match(r"(?i)(SUN|MON|TUE|WED|THU|FRI|SAT)", x)]
        out.append((i, m[1], place, title, far[0] if far else ""))
    return out


def test_random_orders_of_lines(spark):
    rng = random.Random(4)
    kinds = ["SUN, APR 5, 9AM", "mon jan 20", "Fri, FEB 3", "HALL ONE", "THE PARK 7", "Family day", "Songs for all", "Learn more", "tiny", "7", "A" * 45, "Sunday school " + "x" * 60, "a longer text " * 5, "NOTHING BUT CAPITALS " * 4, "Every week", "t" * 101]
    docs = [[rng.choice(kinds) for _ in range(rng.choice([0, 1, 2, 3, 8, 40, 150]))] for _ in range(200)]
    docs = [[x.strip() for x in d] for d in docs]
    html = ["<p>" + rng.choice(["</p><p>", "<br>", "\n", "<b></b>"]).join(d) + "</p>" for d in docs]
    got = {r.ord: [tuple(w) for w in r.w] for r in pages(spark, *html).select("ord", sites.line_windows(sites.text_lines(F.col("html"))).alias("w")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == windows(d)
    assert sum(len(w) for w in got.values()) > 50


def test_links_of_lines(spark):
    html = '<a href="/up/fair">The Fair (a+b)?</a>' + "".join(f"<p>{x}</p>" for x in ("SAT, JAN 20", "HALL", "The Fair (a+b)?", "SAT, JAN 20, 5PM", "YARD", "Other thing", "SAT, JAN 2", "HALL", "Long gone"))
    rows = sites.line_events(pages(spark, html, None, ""), SITE, "https://x.example.org/all", NOW).collect()
    assert sorted((r.title, r.external_url, r.start_date) for r in rows) == [("Other thing", "https://x.example.org/all", "2024-01-20T00:00:00"), ("The Fair (a+b)?", "https://x.example.org/up/fair", "2024-01-20T00:00:00")]


def test_attributes(spark):
    quote = lambda x: json.dumps(x).replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    items = {"userItems": [{"title": "<b>Fun</b> fair", "description": "Jan 20-22 &amp; more"}, {"title": "Fun"}, None, {"title": "No day here", "buttonLink": {"url": "https://y.example.org"}}, {"title": "Gone by", "description": "Mar 1, 2023"}, {"title": "Bible study night"}]}
    html = ['<ul data-current-context="{&quot;a&quot;:1}" x>', f'<ul data-current-context="{quote(items)}">', '<ul data-current-context="{">', f'<ul other-data-current-context="{quote(items)}">', None]
    rows = sites.attribute_events(pages(spark, *html), SITE, "https://x.example.org/all", NOW).orderBy("ord").collect()
    assert [(r.title, r.start_date, r.external_url) for r in rows] == [("Fun fair", "2024-01-20T00:00:00", "https://x.example.org/all"), ("No day here", "2024-01-13T09:30:00", "https://y.example.org")]


def test_items_beyond_a_thousand_have_numbers_of_their_own(spark):
    many = {"events": [{"id": f"{i}", "name": "N", "time_start": "2024-01-20T10:00:00"} for i in range(1500)]}
    rows = spark.createDataFrame([(0, json.dumps(many)), (1, json.dumps(many)), (2, json.dumps({"events": many["events"][:10]}))], "ord long, payload string")
    numbers = [r.ord for r in apis.review_events(rows).collect()]
    assert len(numbers) == len(set(numbers)) == 3010 and sorted(numbers)[-1] == (2 << 32) + 9
    with pytest.raises(Exception, match="too large"):
        spark.range(1).select(numbered(F.lit(1), F.lit(1 << 32))).collect()


def card(path, title, after="", before="", more=""):
    return f'{before}<div class="views-field views-field-title"><a href="{path}"> <span>{title}</span></a>{more}</div>\n</div>{after}'


def test_cards_and_linked_data(spark):
    from listwright.sources import cards

    data = [{"@type": "Event", "name": "FAIR ", "startDate": "2024-01-20", "description": "By title", "location": {"name": "Hall", "address": {"streetAddress": "1 A St"}}}, {"@type": "Event", "name": "Named otherwise", "startDate": "2024-01-20T09:00:00", "url": "https://c.example.org/Walk", "description": "By link"}, {"@type": "Event", "name": "Only here", "startDate": "2024-01-20"}, {"@type": "Place", "name": "No"}]
    html = [
        card("/fair", "Fair", '<time datetime="2023-05-05T10:00:00Z">10 am</time> - <time datetime="2023-05-05T12:30:00Z">noon</time>', '<img src="/a.png"><img src="/b.jpg?x">', "<p>Big <b>Hall</b></p><ul><li>Pick</li><li>Art</li></ul>")
        + card("/walk", "Walk", " " * 1300 + '<time datetime="2023-05-05T10:00:00Z">far</time>') + card("/fair", "Fair again") + card("/login", "Login") + card("/x", "ab") + f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">[1,</script>',
        None, "", '<div class="views-field views-field-title"><a href="/cut"><span>Cut',
    ]
    pages_ = spark.createDataFrame([(i, "https://c.example.org/d", "2024-01-20", h) for i, h in enumerate(html)], "ord long, url string, day string, html string")
    rows = {r.title: r for r in cards.day_listings(pages_, "c", "https://c.example.org", "Chicago").collect()}
    assert set(rows) == {"Fair", "Walk", "Only here"}
    fair, walk = rows["Fair"], rows["Walk"]
    assert (fair.start_date, fair.end_date, fair.is_all_day, fair.description, fair.address, fair.location_name) == ("2024-01-20T10:00:00", "2024-01-20T12:30:00", False, "By title", "1 A St", "Big Hall")
    assert (fair.image_url, fair.tags, fair.source_id) == ("https://c.example.org/b.jpg?x", ["c", "Art"], "c:/fair:2024-01-20")
    assert (walk.start_date, walk.is_all_day, walk.description, walk.city) == ("2024-01-20T00:00:00", True, "By link", "Chicago") and rows["Only here"].is_all_day
    either = cards.data_or_cards(pages_.unionByName(pages_.filter("ord = 0").select(F.lit(9).alias("ord"), "url", "day", F.lit(card("/solo", "Alone")).alias("html"))), "c", "https://c.example.org", "Chicago")
    assert {r.title for r in either.collect()} == {"FAIR", "Named otherwise", "Only here", "Alone"}


def test_budgets_by_metro(spark):
    from listwright.schema import conform
    from listwright.sources import cards

    rows = [(i, f"s:{i}", "a" if i % 3 else "b", "" if i % 2 else "told", f"https://d.example.org/{i}") for i in range(40)]
    df = conform(spark.createDataFrame(rows, "ord long, source_id string, metro string, description string, external_url string"))
    details = spark.createDataFrame([(f"https://d.example.org/{i}", "<p>From the page</p>", "1 A St", None) for i in range(40)], "url string, description string, address string, location_name string")
    got = {r.ord: (r.description, r.address) for r in cards.enriched(df, details, 3).collect()}
    lacking = {m: [i for i, _, metro, text, _ in rows if metro == m and not text][:3] for m in "ab"}
    for i, _, metro, text, _ in rows:
        assert got[i] == (("From the page", "1 A St") if i in lacking[metro] else (text, None))
