"""The cache of answers across runs, replays of edits, balanced markup, default filters: against plain versions."""

import random
from datetime import datetime, timedelta
from html.parser import HTMLParser

from pyspark.sql import functions as F

from listwright.functions.markup import elements
from listwright.operators import edits, filters
from listwright.sources import cache, sites

NOW = datetime(2024, 1, 13, 9, 30)
SITE = sites.Site("venue-x", "x", "https://x.example.org", "Irvine", "orange-county")


def entries(spark, *rows):
    return spark.createDataFrame([("verdict", k, at, a) for k, at, a in rows], cache.ENTRIES)


def held(df):
    return sorted((r.key, r.cached_at, r.answer) for r in df.collect())


def test_a_second_run_writes_nothing(spark, tmp_path):
    store = cache.Store(spark, f"file://{tmp_path}/c", buckets=8)
    assert store.read().count() == 0 and store.save(entries(spark), NOW) == 0 and not (tmp_path / "c").exists()
    rows = [(f"k{i}", NOW - timedelta(days=i % 20), f"a{i}") for i in range(200)]
    assert store.save(entries(spark, *rows), NOW) == 8
    files = sorted(str(p) for p in (tmp_path / "c").rglob("*"))
    assert store.save(entries(spark, *rows), NOW) == 0 and sorted(str(p) for p in (tmp_path / "c").rglob("*")) == files
    assert held(store.read()) == sorted(rows)
    assert store.save(entries(spark, ("k7", NOW, "new"), ("k8", NOW - timedelta(days=25), "old")), NOW) == 1  # an older answer changes nothing
    assert ("k7", NOW, "new") in held(store.read()) and len(held(store.read())) == 200
    later = NOW + timedelta(days=20)  # entries of more than ten days are expired then
    assert store.save(entries(spark), later) > 0
    assert held(store.read()) == sorted([r for r in rows if r[1] >= later - timedelta(days=30) and r[0] != "k7"] + [("k7", NOW, "new")])
    assert store.save(entries(spark), later + timedelta(days=99)) > 0 and store.read().count() == 0


def test_saves_that_meet_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    first, second = (cache.Store(spark, path, buckets=2) for _ in range(2))
    first.save(entries(spark, ("a", NOW, "1")), NOW)
    create, calls = second._create, []

    def late(version, manifest):
        if not calls:  # another save comes between reading and writing
            calls.append(first.save(entries(spark, ("b", NOW, "2"), ("c", NOW, "3")), NOW))
        return create(version, manifest)

    second._create = late
    assert second.save(entries(spark, ("d", NOW, "4"), ("b", NOW + timedelta(hours=1), "newer")), NOW + timedelta(hours=2)) > 0
    assert [(k, a) for k, _, a in held(first.read())] == [("a", "1"), ("b", "newer"), ("c", "3"), ("d", "4")]
    (tmp_path / "c" / "manifest-9.json").write_text('{"buckets": {"0"')  # its writer was lost
    assert len(held(first.read())) == 4 and first.save(entries(spark, ("e", NOW, "5")), NOW) == 1 and len(held(second.read())) == 5


def test_unanswered(spark):
    asked = spark.createDataFrame([("s:1", "A", "text"), ("s:2", "B", None)], "source_id string, title string, description string")
    known = asked.filter("title = 'B'").select(F.lit("verdict").alias("kind"), cache.verdict_key().alias("key"))
    assert [r.title for r in cache.unanswered(asked, known, "verdict", cache.verdict_key()).collect()] == ["A"]
    assert cache.unanswered(asked.withColumn("title", F.lit("C")), known, "verdict", cache.verdict_key()).count() == 2


def test_random_logs_like_a_dictionary(spark):
    rng = random.Random(3)
    log, state, seq = [], {}, 0
    for _ in range(1500):
        seq += rng.randint(1, 3)
        name, op = f"r{rng.randrange(40)}", rng.choice(["upsert"] * 4 + ["edit"] * 3 + ["release", "delete", "unknown"])
        fields = None if rng.random() < 0.05 else {k: rng.choice([None, f"v{rng.randrange(9)}"]) for k in rng.sample("abcd", rng.randint(0, 4))}
        log.append((seq, name, op, fields))
        given, old = {k: v for k, v in (fields or {}).items() if v is not None}, state.get(name)
        if op == "upsert" and not (old and old[1]):
            state[name] = (given, False)
        elif op == "edit":
            state[name] = ({**(old[0] if old else {}), **given}, True)
        elif op == "release" and old:
            state[name] = (old[0], False)
        elif op == "delete":
            state.pop(name, None)
    rng.shuffle(log)
    df = spark.createDataFrame(log, "seq long, record_name string, op string, fields map<string,string>")
    got = edits.replay(df)
    assert {r.record_name: (r.fields, r.edited) for r in got.collect()} == state
    cut = sorted(s for s, *_ in log)[700]  # a state stands for the log before it
    resumed = edits.replay(edits.as_log(edits.replay(df.filter(F.col("seq") < cut)), -2).unionByName(df.filter(F.col("seq") >= cut)))
    assert {r.record_name: (r.fields, r.edited) for r in resumed.collect()} == state
    assert {r.record_name for r in edits.protected(got).collect()} == {k for k, (_, e) in state.items() if e}
    assert edits.replay(df.limit(0)).count() == 0


def test_upserts_as_log(spark):
    rows = spark.createDataFrame([("r1", "T", 5), ("r2", None, 6)], "record_name string, title string, n int")
    log = edits.upserts_to_log(rows, 9, ["title", "n"])
    assert {r.record_name: r.fields for r in edits.replay(log).collect()} == {"r1": {"title": "T", "n": "5"}, "r2": {"n": "6"}}


class Balanced(HTMLParser):
    """(tag, inner text of markup, depth) of elements, each closing tag closing the last open one of its name."""

    def __init__(self, html, tags):
        super().__init__()
        self.tags, self.html, self.found, self.open = tags, html, [], {t: [] for t in tags}
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)

    def at(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag in self.tags:
            self.open[tag].append(self.at() + len(self.get_starttag_text()))

    def handle_endtag(self, tag):
        if tag in self.tags and self.open[tag]:
            start = self.open[tag].pop()
            self.found.append((tag, self.html[start : self.at()], len(self.open[tag])))


def test_balanced_elements(spark):
    rng = random.Random(2)

    def markup(depth):
        if depth == 0:
            return rng.choice(["text", "a &amp; b", "\n", "", "<br>", "<b>x</b>"])
        tag = rng.choice(["div", "li", "DIV", "span"])
        attrs = rng.choice(["", ' class="a > b"', " id='x'", "\n class='z'"])
        return "".join(f"<{tag}{attrs}>{markup(depth - 1)}</{tag}>" if rng.random() < 0.8 else markup(depth - 1) for _ in range(rng.randint(1, 3)))

    pages = [(i, markup(rng.randint(0, 5))) for i in range(80)] + [(80, None), (81, ""), (82, "<div><li>open<div>x</div>"), (83, "</div><div>after</div>")]
    rows = elements(spark.createDataFrame(pages, "ord long, html string"), ["div", "li"]).collect()
    for i, html in pages[:80]:
        assert sorted((r.tag, r.inner, r.depth) for r in rows if r.ord == i) == sorted(Balanced(html, ["div", "li"]).found), html
    assert [(r.tag, r.inner) for r in rows if r.ord == 82] == [("div", "x")] and not [r for r in rows if r.ord in (80, 81)]


def test_blocks_by_the_first_strategy(spark):
    block = lambda title, more="": f"<h2> {title} </h2>{more}"
    html = [
        f'<li class="user-items-list-item-container"><ul><li>x</li></ul>{block("Family fair", "<p>June 3, 2025</p>")}</li><article>{block("Not on this page")}</article>',
        f'<div class="blog-basic-grid--container">{block("Autumn walk", "<i>February 3-5, 2024</i>")}</div><article>{block("Nor here")}</article>',
        f'<article>{block("Events")}</article><article>{block("12 Main St now")}</article><article>{block("Bible study night")}</article><article>{block("Open house", "<time datetime=&>")}</article>', None, "<article>",
    ]
    rows = sites.block_events(spark.createDataFrame(list(enumerate(html)), "ord long, html string"), SITE, NOW).collect()
    assert sorted((r.title, r.start_date) for r in rows) == [("Autumn walk", "2024-02-03T00:00:00"), ("Open house", "2024-01-13T09:30:00")]


def test_default_rules_of_a_run(spark):
    titles = {"Fun fair": 1, "21+ Karaoke": 0, "UYE: brunch": 0, "Skating in Irvine, Anaheim, Westminster, and Yorba Linda": 0, "Brea, Tustin & Irvine by bike": 0, "Lunch with Joel": 0, "Orange blossom walk": 1, "Wine tasting": 0}
    df = spark.createDataFrame([(t, "", "yelp", None) for t in titles] + [("Show", "must be 21", "x", None), ("Laughs", "", "yelp", "The Improv Hall"), ("Laughs too", None, "library", "The Improv Hall")], "title string, description string, source string, location_name string")
    assert {r.title for r in filters.family_listings(df).collect()} == {t for t, k in titles.items() if k} | {"Laughs too"}
