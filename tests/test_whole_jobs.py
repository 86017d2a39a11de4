"""Odd inputs and work that must not grow with the square of a group, against SQL and plain loops."""

import random
import re
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from listwright import catalog, rules
from listwright.operators import dedup, filters, joins
from listwright.operators.categorize import categorize
from listwright.sources import apis, payloads, sites


def in_sql(name, **tables):
    """Rows of the query's SQL over tables of pandas."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table, rows in tables.items():
        con.register(table, rows)
    return sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_headings_decode_only_ampersands(spark):
    html = "<h1>a &quot;b&quot; &amp;lt; c</h1> <h2 class=x> <b>&#39;d</b><br/>\n</h2><h3>\n\n\n e</p></h3><h4></h4>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    rows = payloads.headings(pages).collect()
    assert [r.heading for r in sorted(rows, key=lambda r: r.pos)] == ["a &quot;b&quot; &lt; c", "'d\n".replace("'", "&#39;"), "\n\n\n e", ""]
    assert sorted(map(tuple, rows)) == in_sql("page_headings", pages=pages.toPandas())


def planned(df):
    """The optimized plan as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_by_first_letter():
    words = ["bible", "study", "studies", "men's", "mens", "group", "21+", "18 and over", "UYE", "uye", "sunday", "church", "service", "x", "must be 21", "esl", "(", ".", "ages 55 +", "saturday", "nights", "at", "A\tstaff", "meeting"]
    rng = random.Random(5)
    texts = [rng.choice(["", "x", " "]) + rng.choice([" ", "  ", "-", ""]).join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(4000)]
    odd = [r"\b(a|b?c)d", r"\ba|b", r"\b(x|yz)?q", r"\bs?x", r"(?i)\b\w+ly", r"\b[ab]c", r"\bo\(a|b\)"]
    for patterns in ([f"(?i){p}" for p in rules.RELIGIOUS], [f"(?i){p}" for p in rules.ADULT_TITLES], [f"(?i){p}" for p in rules.ADULT_TEXTS], rules.MEETUPS, odd):
        plain, joined = re.compile("|".join(f"(?{'i' if p.startswith('(?i)') else ''}:{p.removeprefix('(?i)')})" for p in patterns)), re.compile(re.sub(r"\(\?:\(\?i\)", "(?i:", filters.by_first_letter(patterns)))
        assert [bool(joined.search(t)) for t in texts] == [bool(plain.search(t)) for t in texts]
    # One boundary answers for all words of the rules, instead of one for each.
    assert filters.by_first_letter([f"(?i){p}" for p in rules.RELIGIOUS]).startswith(r"(?i:\b(?:a(?:")


def test_text_of_categories_is_read_once(spark):
    rows = spark.createDataFrame([("Art class", "<b>soccer</b>", 1), ("Day", "<i>pottery</i> and robotics", 2), (None, None, 3), ("", "none", 4)], "title string, text string, n int")
    found = rows.select("n", categorize(F.col("title"), F.regexp_replace("text", "<[^>]+>", "")).alias("c"))
    assert planned(found).count("regexp_replace") == 1
    assert [r.c for r in found.orderBy("n").collect()] == ["Craft", "Craft", "Other", "Other"]


def test_readers_strip_a_text_once(spark):
    now, about = datetime(2024, 1, 13, 9, 30), sites.Site("x", "x", "https://x.example.org", "Irvine", "orange-county")
    answers = spark.createDataFrame([(1, "[]"), (2, None)], "ord long, payload string")
    pages = spark.createDataFrame([(1, "", "<p>")], "ord long, url string, html string")
    for found, texts in ((apis.dated_programs(answers, "p", [], now), 1), (apis.day_groups(answers, "d", [1], ["x"], now), 1), (sites.attribute_events(pages, about, "https://x.example.org", now), 2)):
        assert planned(found).count("(?i)</p>") == texts
        assert planned(found).count("from_json") <= 1
        assert found.count() == 0


def test_counts_in_ranges(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    moment = lambda: start + timedelta(seconds=rng.choice([0, 43200, 86400, 172800, rng.randrange(900000)]))
    points = [(moment(),) for _ in range(300)] + [(start,)] * 50 + [(None,)]
    ranges = [(i, *rng.choice([sorted((moment(), moment())), (start, start + timedelta(days=2)), (start, start), (start + timedelta(days=3), start), (None, start)])) for i in range(200)]
    found = joins.count_in_ranges(spark.createDataFrame(ranges, "id long, begin timestamp, until timestamp"), spark.createDataFrame(points, "at timestamp"), "begin", "until", "at", timedelta(days=2))
    n = {i: sum(p is not None and b <= p < u for p, in points) for i, b, u in ranges if b}
    assert {r.id: r.n for r in found.collect()} == {i: k for i, k in n.items() if k}
    # Points and ranges never meet in a join: only times do.
    assert "at" not in [c for line in planned(found).splitlines() if "Join" in line for c in re.findall(r"\b(at|event_id)#", line)]


def test_pairs_of_a_large_group_are_dealt_into_cells(spark):
    rows = [(i, "Same", "2024-01-01T10") if i % 5 else (i, f"T{i % 3}", "2024-01-01") for i in range(300)] + [(400, None, "2024-01-01"), (401, "T1", None)]
    df = spark.createDataFrame(rows, "ord long, title string, start_date string")
    for together in (7, 1000):
        pairs = dedup.duplicate_pairs(df, together=together)
        by = {}
        for o, t, d in rows[:300]:
            by.setdefault((t.lower(), d[:10]), []).append(o)
        assert sorted(map(tuple, pairs.collect())) == sorted((a, b) for g in by.values() for a in g for b in g if a < b)
    assert "i#" in next(line for line in planned(pairs).splitlines() if "Join Inner" in line)
    assert [tuple(r) for r in dedup.duplicate_pairs(df, 2).collect()] == [(0, 15), (0, 30)]


def test_alike_pairs_by_marks_of_any_length(spark):
    import random

    import pandas as pd

    from listwright.operators import similar

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 5)))
    texts = set()
    for n in (5, 7, 8, 10, 13, 16, 19, 21, 30, 37, 40, 47, 60, 90, 130, 190, 197, 200, 205, 230, 700, 3000):
        base = " ".join(word() for _ in range(n))[:n].strip()
        texts.update([base, "x" * 4 + base, base + "y" * 4, base[n // 3 :], base[: -n // 4]])
        for _ in range(12):
            t = base
            for _ in range(rng.randint(1, 7)):
                at = rng.randrange(min(len(t), 200))
                t = t[:at] + rng.choice(["", "q", t[at] + "z"]) + t[at + 1 :]
            texts.add(t)
    rows = [(i, block, t) for i, (block, t) in enumerate((b, t) for b in "uv" for t in sorted(texts) if len(t) >= 5)]
    want = {(a, b) for a, x, t in rows for b, y, u in rows if a < b and x == y and dedup.alike(t, u)}
    classes, pairs = similar.alike_pairs(spark.createDataFrame(rows, "id long, block string, text string"))
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want) and len(want) > 1000 and classes.count() == len(rows)
    # A text has few marks, however long it is; it had a fragment at each of its characters.
    marks = pd.concat(similar._marks([pd.DataFrame({"id": range(2), "text": [" ".join(word() for _ in range(k)) for k in (5000, 50000)], "within": 7})]))
    assert marks.groupby("id").size().max() < 120


def test_choice_within_a_large_group_follows_links_only():
    import random

    import pandas as pd

    def resolved(rows, links):
        found = dedup._resolve(pd.DataFrame(rows, columns=["first", "ord", "score", "title", "rest"]), pd.DataFrame(links, columns=["a", "b"]))
        return sorted(found.itertuples(index=False, name=None))

    # A chain: each second listing has no entity beside it. A comparison of all with all would take hours here.
    n = 100_000
    assert resolved([(i, i, 0, 2 * i, -1) for i in range(n)], [(2 * i, 2 * i + 2) for i in range(n - 1)]) == [(i, i) for i in range(0, n, 2)]
    rng = random.Random(1)
    for _ in range(20):
        rows = [(k := rng.randrange(40), i, rng.randrange(6), 2 * (k // 2) if k < 36 else -1, 2 * rng.randrange(20) + 1 if k % 3 and k < 36 else -1) for i in range(150)]
        links = [tuple(sorted(rng.sample(range(odd, 40, 2), 2))) for odd in (0, 1) for _ in range(12)]
        both = {*links, *((b, a) for a, b in links)}
        kept = []  # [key, place, row]: a plain loop
        for row in rows:
            hit = next((e for e in kept if e[0] == row[0]), None)
            hit = hit or next((e for e in kept if any(x >= 0 and x == y or (x, y) in both for x, y in zip(row[3:], e[2][3:]))), None)
            if hit is None:
                kept.append([row[0], row[1], row])
            elif row[2] > hit[2][2]:
                hit[2] = row
        assert resolved(rows, links) == sorted((e[1], e[2][1]) for e in kept)


def test_cards_of_listings_with_odd_or_no_titles(spark, tmp_path):
    import pandas as pd

    titles = ["", " ", "&", "<>", "\u00a0", "Fair\u00a0", " Fair  day ", "\u2003Walk\u2003", "a\x0bb", "Walk \x0b", "Walk\ufeff", "\ufeff", "Walk\r", "Walk \u2028", "Walk \x85", "x" * 300 + " \x0b", "x" * 196 + "\x0b", "Plain"]
    rows = [(1 + 20 * i + j, f"{t}\nbody", "en", "web") for i, t in enumerate(titles) for j in range(12)] + [(1000 + j, "", "en", "web") for j in range(12)]
    rows += [(j, "\nbody", "en", "web") for j in (20, 40, 60, 80)]  # no title and a short number: a name of two or three characters
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).drop_duplicates("doc_id")
    spark.createDataFrame(documents).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["day_listings"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, in_sql("day_listings", documents=documents)))
    assert sum(r.title == f"{r.external_url.split('/')[-1]} " for r in found) > 40


def test_edits_count_in_whole_texts(spark):
    from listwright.operators import similar

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 5)))
    texts = set()
    for n in (8, 20, 41, 200, 206, 251, 257, 262, 330, 500):
        base = " ".join(word() for _ in range(n))[:n].strip()
        texts.update([base, base[: n // 2] + "x" * 12 + base[n // 2 + 12 :], base[: n - 9] + "yyyyyyyyy", base + "z" * 6, base + "z" * 7])
        for k in (1, 3, 6, 7):
            t = base
            for _ in range(k):
                at = rng.choice([rng.randrange(len(t)), rng.randrange(len(t) * 3 // 4, len(t)), 0])
                t = t[:at] + rng.choice(["", "q", t[at] + "z"]) + t[at + 1 :]
            texts.add(t)
    rows = [(i, "u", t) for i, t in enumerate(sorted(t for t in texts if len(t) >= 5))]
    want = {(a, b) for a, _, t in rows for b, _, u in rows if a < b and dedup.alike(t, u, None)}
    first = {(a, b) for a, _, t in rows for b, _, u in rows if a < b and dedup.alike(t, u)}
    assert sorted((r.a, r.b) for r in similar.alike_pairs(spark.createDataFrame(rows, "id long, block string, text string"), None)[1].collect()) == sorted(want)
    assert len(want) > 80 and len(first - want) > 5
    for _, _, t in rows[::3]:
        for _, _, u in rows[::5]:
            assert similar.few_edits(t, u, 4) == (dedup.edit_distance(t, u, 4) <= 4)


def test_long_titles_that_begin_alike_stay_apart(spark):
    from listwright.schema import conform

    begin = " ".join(f"word{i}" for i in range(40))
    titles = [begin + " painting for children", begin + " walk along the river.", begin + " pointing for childrens", begin[:205] + "!" + begin[205:] + " singing"]
    df = conform(spark.createDataFrame([(i, t, "2026-06-15T10:00:00", f"city {i}") for i, t in enumerate(titles)], "ord long, title string, start_date string, city string"))
    assert len(begin) > 220 and sorted((r.place, r.ord) for r in dedup.greedy(df).collect()) == [(0, 0), (1, 1), (3, 3)]
