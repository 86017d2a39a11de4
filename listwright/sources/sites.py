"""Readers of the captured pages of single sites.

Pages are (ord, url, html).  A page that is null, cut off or of another shape gives no rows, and so does an item
without a title or a proper start.  What a site is and where stands in a Site; the clock is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import dates
from listwright.functions.markup import elements, first_strategy
from listwright.functions.text import clean_description, parse_timestamp, strip_html, trimmed
from listwright.operators.categorize import categorize
from listwright.operators.changes import first_by
from listwright.operators.filters import religious
from listwright.plans.shared import once
from listwright.schema import conform, numbered


@dataclass
class Site:
    """A site and the place that its listings are at."""

    source: str
    prefix: str  # of ids
    base: str  # of links, without a slash at the end
    city: str
    metro: str
    location_name: str | None = None
    address: str | None = None
    latitude: float | None = None
    longitude: float | None = None
    price: str | None = None
    tags: list[str] = field(default_factory=list)

    def columns(self) -> dict[str, Column]:
        lit = {n: F.lit(getattr(self, n)) for n in ("source", "city", "metro", "location_name", "address", "latitude", "longitude", "price")}
        return {**lit, "tags": F.array(*map(F.lit, self.tags)).cast("array<string>")}

    def link(self, href: Column) -> Column:
        return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(self.base), href))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group holds; null if nothing."""
    return _some(F.regexp_extract(text, pattern, group))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def _today(now: datetime) -> datetime:
    return datetime(now.year, now.month, now.day)


def _in_window(t: Column, now: datetime, days: int) -> Column:
    """From today's midnight through so many days from now."""
    return F.coalesce(t.between(F.lit(_today(now)), F.lit(now + timedelta(days=days))), F.lit(False))


def _short(title: Column, longest: int) -> Column:
    """A title as the end of an id."""
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), 1, longest)


# State of an application, embedded in a page.


def _inside(v: Column) -> Column:
    """The values of an object, or the elements of an array; none of others."""
    none = F.array().cast("array<variant>")
    return F.concat(F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), none), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none))


def objects_with(text: Column, *keys: str) -> Column:
    """Array of all objects with these keys, at any depth of a JSON text, outer ones first; null if the text isn't JSON.

    The document is searched level by level, for as many levels as it can have: as many as it has opening brackets.
    """
    fit = lambda v: F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), k))
    whole = F.array(F.try_parse_json(text))
    levels = F.greatest(F.length(F.regexp_replace(text, r"[^\[{]", "")), F.lit(1))

    def deeper(acc: Column, _: Column) -> Column:
        level = F.flatten(F.transform(acc["level"], _inside))
        return F.struct(level.alias("level"), F.concat(acc["found"], F.filter(level, fit)).alias("found"))

    start = F.struct(whole.alias("level"), F.filter(whole, fit).alias("found"))
    return F.when(F.get(whole, F.lit(0)).isNotNull(), F.aggregate(F.sequence(F.lit(1), levels), start, deeper)["found"])


def state_objects(pages: DataFrame, *keys: str, element: str = "__NEXT_DATA__") -> DataFrame:
    """(ord, pos, item): objects with these keys in the state that pages embed in a script element of that id."""
    state = _group(F.col("html"), rf'(?s)<script id="{element}"[^>]*>(.*?)</script>')
    return pages.select("ord", F.posexplode(objects_with(state, *keys)).alias("pos", "item"))


def state_events(pages: DataFrame, site: Site, now: datetime, days: int = 60, starts: str = "activeStartDate", ends: str = "activeEndDate") -> DataFrame:
    """Programs in an embedded state: not hidden, with a title (rich text) and a start in the window."""
    at = lambda path, kind="string": F.try_variant_get("item", f"$.{path}", kind)
    plain = lambda path: F.when(F.schema_of_variant(at(path, "variant")) == "STRING", at(path))
    hidden = ~F.coalesce(at("hideFromCalendar").isin("false", "0", ""), F.lit(True))
    start, end = parse_timestamp(plain(starts)), parse_timestamp(plain(ends))
    title = trimmed(F.regexp_replace(_text(F.coalesce(_some(plain("programTitle.html")), plain("title.html"))), "<[^>]+>", ""))
    text = clean_description(strip_html(_text(F.coalesce(plain("programTagline"), plain("filmDescription1")))))
    rows = state_objects(pages, starts).filter(~hidden).select("ord", "pos", "item", title.alias("title"), text.alias("description"), start.alias("start"), end.alias("end"))
    rows = rows.filter((F.col("title") != "") & _in_window(F.col("start"), now, days))
    id_ = _some(plain("sys.id"))
    name = F.coalesce(_some(plain("slug")), id_, F.substring(F.regexp_replace(F.lower("title"), r"\s+", "-"), 1, 40))
    link = F.concat(F.lit(f"{site.base}/"), name)
    return conform(
        rows, source_id=F.concat(F.lit(f"{site.prefix}:"), F.coalesce(id_, name)), start_date=_iso(F.col("start")), end_date=_iso(F.col("end")), category=categorize(F.col("title"), F.col("description")),
        external_url=link, website_url=link, image_url=_some(plain("image.url")), ord=numbered("ord", "pos"), **site.columns(),
    )


# Lists of links, and the pages that they lead to.


def first_links(lists: DataFrame, patterns: list[str], most: int, clean: bool = True, not_links: str = r"^$") -> DataFrame:
    """(site, link, seen): the links of list pages (site, ord, html) that match, each once for a site; of each site, the `most` that were seen first.

    On a page, the matches of one pattern come before those of the next.  A link goes without query and fragment
    if clean is set; links of the pattern not_links don't count.  Budgets are kept by site, and reduced in each partition before rows move.
    """
    found = F.flatten(F.array(*[_all(F.col("html"), p) for p in patterns]))
    rows = lists.select("site", "ord", F.posexplode(found).alias("pos", "link"))
    if clean:
        rows = rows.withColumn("link", F.regexp_replace("link", r"[?#].*$", ""))
    seen = rows.filter(~F.col("link").rlike(not_links)).groupBy("site", "link").agg(F.min(F.struct("ord", "pos")).alias("seen"))
    order = Window.partitionBy("site").orderBy("seen", "link")
    return seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


@dataclass
class Details:
    """How a site's list and detail pages look."""

    links: list[str]  # patterns of links on list pages, with one group
    general: list[str]  # titles of pages that are no event
    most: int = 100
    clean: bool = True
    not_links: str = r"^$"  # cleaned links that are no event
    strip_first: bool = False  # whether " | name" leaves a title before it is compared with the general ones
    tickets: str = "admission|member|person|ticket"  # words that a price stands before
    id_from: str = r"^.*/"  # what a link's id goes without


def _meta(html: Column, name: str) -> Column:
    return _group(html, rf'property="og:{name}"\s+content="([^"]+)"')


def detail_events(lists: DataFrame, pages: DataFrame, site: Site, how: Details, now: datetime, days: int = 60) -> DataFrame:
    """Events of the pages (one for a url) that list pages (ord, html, and site where budgets are kept for several) lead to.

    What has begun and goes on starts today; what starts after the window doesn't count.
    """
    lists = lists if "site" in lists.columns else lists.withColumn("site", F.lit(site.source))
    links = first_links(lists, how.links, how.most, how.clean, how.not_links)
    links = first_by(links.select("link", "seen", site.link(F.col("link")).alias("url")), "url", order="seen")
    html = F.col("html")
    bare = lambda t: trimmed(F.regexp_replace(t, r"\s*\|.*$", ""))
    title = _text(F.coalesce(_meta(html, "title"), trimmed(_group(html, "<h1[^>]*>([^<]+)</h1>"))))
    named = bare(title) if how.strip_first else title
    price = F.substring(trimmed(_group(html, rf"(?i)((?:Free|\$\d+[^<]*?)(?:\s*(?:with|per|for))?[^<]{{0,30}}(?:{how.tickets}))")), 1, 50)
    rows = pages.drop("ord").join(links, "url").select(
        "url", "link", "seen", bare(title).alias("title"), named.alias("named"), dates.full_range(html).alias("on"), price.alias("price"), _text(_meta(html, "description")).alias("text"), _meta(html, "image").alias("image"),
    )
    today, first, last = F.lit(now.date()), F.col("on.first"), F.col("on.last")
    start = F.when((first < today) & (last > F.lit(now.date())), today).otherwise(first)
    rows = rows.filter((F.col("title") != "") & ~F.col("named").isin(how.general)).withColumn("start", start)
    rows = rows.filter(F.col("start").cast("timestamp") <= F.lit(now + timedelta(days=days)))
    text = clean_description(strip_html(F.col("text")))
    id_ = F.substring(F.regexp_replace(F.regexp_replace("link", how.id_from, ""), "(?i)[^a-z0-9_-]", "-"), 1, 50)
    own = {**site.columns(), "price": F.col("price")}
    return conform(
        rows, source_id=F.concat(F.lit(f"{site.prefix}:"), id_), description=text, start_date=_iso(F.col("start").cast("timestamp")), end_date=_iso(last.cast("timestamp")), is_all_day=F.lit(True),
        category=categorize(F.col("title"), F.col("text")), external_url=F.col("url"), website_url=F.col("url"), image_url=site.link(F.col("image")), ord=numbered("seen.ord", "seen.pos"), **own,
    )


# Cards with programs, one listing for each of their dates.

# Cards, what they hold, and words of links that name no program.
_CARD = r'(?s)<article[^>]*class="[^"]*node[^"]*"[^>]*>(.*?)</article>'
_CARD_TITLE = r'<h[23][^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>([^<]+)</a>'
_CARD_DATE = r'(?s)<p[^>]*class="[^"]*date[^"]*"[^>]*>(.*?)</p>'
_CARD_TEXT = r'(?s)<p[^>]*class="[^"]*(?:body|desc|summary)[^"]*"[^>]*>(.*?)</p>'
_PROGRAM = r'(?i)(<a[^>]*href="/(?:programs|calendar|exhibitions)/[a-z0-9_-]+"[^>]*>[^<]+</a>)'
_PROGRAM_PARTS = r'(?i)^<a[^>]*href="(/(?:programs|calendar|exhibitions)/[a-z0-9_-]+)"[^>]*>([^<]+)</a>$'
_MORE = r"(?i)^(details|reservations|learn more|read more|view|see)$"


def programs(lists: DataFrame, most: int) -> DataFrame:
    """(site, ord, place, href, title, schedule, text, image) of list pages (site, ord, html): of each page its cards, then its other program links, by first appearance of a link; the first `most` of a site."""
    card = lambda c: F.struct(
        _group(c, _CARD_TITLE, 1).alias("href"), trimmed(_text(_group(c, _CARD_TITLE, 2))).alias("title"), strip_html(_text(_group(c, _CARD_DATE))).alias("schedule"),
        strip_html(_text(_group(c, _CARD_TEXT))).alias("text"), _group(c, '<img[^>]*src="([^"]+)"').alias("image"), F.lit(False).alias("bare"),
    )
    link = lambda a: F.struct(
        _group(a, _PROGRAM_PARTS, 1).alias("href"), trimmed(_text(_group(a, _PROGRAM_PARTS, 2))).alias("title"), F.lit("").alias("schedule"), F.lit("").alias("text"), F.lit(None).cast("string").alias("image"), F.lit(True).alias("bare"),
    )
    cards, links = F.transform(_all(F.col("html"), _CARD), card), F.transform(_all(F.col("html"), _PROGRAM), link)
    rows = lists.select("site", "ord", F.posexplode(F.concat(cards, links)).alias("pos", "p")).select("site", "ord", "pos", "p.*")
    rows = rows.filter("href is not null and title <> ''").filter(~(F.col("bare") & F.col("title").rlike(_MORE)))
    values = F.struct("ord", "pos", "title", "schedule", "text", "image")
    firsts = rows.groupBy("site", "href").agg(F.min_by(values, F.struct("ord", "pos")).alias("p")).select("site", "href", "p.*")
    order = Window.partitionBy("site").orderBy("ord", "pos")
    return firsts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def program_dates(lists: DataFrame, pages: DataFrame, site: Site, now: datetime, days: int = 60, most: int = 50, hour: int = 10, otherwise: str = "") -> DataFrame:
    """A listing for each day with a year in the window that a program's page names; where there is none, or no page, one recurring listing today.

    Budgets are kept for each site that lists name.
    """
    lists = lists if "site" in lists.columns else lists.withColumn("site", F.lit(site.source))
    url = site.link(F.col("href"))
    facts = pages.select("url", F.col("html").alias("page"))
    rows = programs(lists, most).withColumn("url", url).join(facts, "url", "left")
    begin, until = F.lit(now.date()), F.lit(now + timedelta(days=days))
    found = F.filter(F.coalesce(dates.full_dates(F.col("page")), F.array().cast("array<date>")), lambda d: (d >= begin) & (d.cast("timestamp") <= until))
    told, shown = F.coalesce(_meta(F.col("page"), "description"), F.col("text")), F.coalesce(_meta(F.col("page"), "image"), site.link(F.col("image")))
    rows = rows.select("url", "href", "title", "schedule", "ord", "place", told.alias("told"), shown.alias("image"), found.alias("found"))
    rows = rows.select("*", F.posexplode_outer("found").alias("pos", "day"))
    schedule = F.when(F.col("schedule") != "", F.concat(F.lit(" Schedule: "), F.col("schedule"), F.lit("."))).otherwise("")
    dated = F.col("day").isNotNull()
    whole = F.when(dated, F.concat(strip_html(F.col("told")), schedule)).otherwise(F.coalesce(_some(F.concat("told", schedule)), F.lit(otherwise)))
    name = lambda n: F.substring(F.regexp_replace("href", "(?i)[^a-z0-9]", "-"), 1, n)
    id_ = F.when(dated, F.concat(name(40), F.lit("-"), F.col("day").cast("string"))).otherwise(name(50))
    return conform(
        rows, source_id=F.concat(F.lit(f"{site.prefix}:"), id_), description=clean_description(whole), start_date=F.concat(F.coalesce("day", begin).cast("string"), F.lit(f"T{hour:02d}:00:00")),
        category=categorize(F.col("title"), F.col("told")), external_url=F.col("url"), website_url=F.col("url"), image_url=F.col("image"), is_recurring=~dated | (F.size("found") > 1),
        ord=numbered("ord", F.col("place") * (1 << 12) + F.coalesce("pos", F.lit(0))), **site.columns(),
    )


# Lines of text: a date, a place in capitals, a title, and a longer text within the next lines.

# Lines that begin with a day, and words that begin no title.
_DAY_LINE = r"(?i)^((?:SUN|MON|TUE|WED|THU|FRI|SAT),?\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+\d{1,2})"
_DAY_NAME, _NO_TITLE = r"(?i)^(SUN|MON|TUE|WED|THU|FRI|SAT)", r"(?i)^(SUN|MON|TUE|WED|THU|FRI|SAT|BEGINNING|EVERY|LEARN)"


def text_lines(html: Column) -> Column:
    """The lines of a page's text, without empty ones; every tag ends a line."""
    lines = F.transform(F.split(F.regexp_replace(html, "<[^>]+>", "\n"), "\n"), trimmed)
    return F.filter(lines, lambda x: x != "")


def line_windows(lines: Column, look_ahead: int = 5) -> Column:
    """Array of (pos, day, place, title, text) of the places in an array of lines where a date, capitals and a title follow each other.

    The text is the first longer line in mixed case, no date itself, among the `look_ahead` lines after the title.
    Of equal dates and titles, the first counts.
    """
    capitals = lambda x: x == F.upper(x)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(lines) - 3, F.lit(0))), lambda i: F.coalesce(F.get(lines, i).rlike(_DAY_LINE), F.lit(False)))
    long_ = lambda x: (F.length(x) > 50) & ~capitals(x) & ~x.rlike(_DAY_NAME)
    window = lambda i: F.struct(
        i.alias("pos"), F.regexp_extract(F.get(lines, i), _DAY_LINE, 1).alias("day"), F.get(lines, i + 1).alias("place"), F.get(lines, i + 2).alias("title"),
        _text(F.get(F.filter(F.slice(lines, i + 4, look_ahead), long_), F.lit(0))).alias("text"),
    )
    title = lambda t: F.length(t).between(5, 100) & ~t.rlike(_NO_TITLE) & ~(capitals(t) & (F.length(t) < 40))
    found = F.filter(F.transform(starts, window), lambda w: F.coalesce(capitals(w["place"]) & title(w["title"]), F.lit(False)))
    key = lambda w: F.concat(w["day"], F.lit(":"), w["title"])
    return F.get(F.transform(F.array(found), lambda f: F.filter(f, lambda w, i: F.array_position(F.transform(f, key), key(w)) == i + 1)), 0)


def line_events(pages: DataFrame, site: Site, page: str, now: datetime, days: int = 60) -> DataFrame:
    """Events of pages that are lines of text, first of equal titles: no religious services, in the window.  Links are those around or after the title."""
    rows = pages.withColumn("lines", text_lines(F.col("html")))
    rows = rows.select("ord", "html", F.explode(line_windows(F.col("lines"))).alias("w")).select("ord", "html", "w.*")
    rows = rows.filter(~religious(F.col("title"), F.col("text"))).withColumn("start", dates.first_day(F.col("day"), now).cast("timestamp"))
    rows = rows.filter(_in_window(F.col("start"), now, days))
    quoted = F.concat(F.lit(r"\Q"), F.replace("title", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    search = lambda *p: _some(F.call_function("regexp_extract", F.col("html"), F.concat(F.lit("(?i)"), *p), F.lit(1)))
    around, after = search(F.lit('href="([^"]*)"[^>]*>[^<]*'), quoted), search(quoted, F.lit(r'[^<]*</a>[\s\S]*?href="([^"]*)"'))
    link = F.coalesce(site.link(F.coalesce(around, after)), F.lit(page))
    made = conform(
        rows.withColumn("link", link), source_id=F.concat(F.lit(f"{site.prefix}:"), _short(F.col("title"), 50)), description=clean_description(F.col("text")), start_date=_iso(F.col("start")),
        category=categorize(F.col("title"), F.col("text")), external_url=F.col("link"), website_url=F.col("link"), ord=numbered("ord", "pos"), **site.columns(),
    )
    return first_by(made, "source_id")


# JSON in attributes.

# Entities in attributes, in the order in which they are decoded; dates with names of months.
_ATTRIBUTE = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_MONTH_DATE = r"(?i)\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:\s*[-–]\s*\d{1,2})?,?\s*(?:\d{4})?)"


def attributes(html: Column, name: str) -> Column:
    """Array of the values of an attribute, in order, with entities decoded."""

    def plain(v: Column) -> Column:
        for entity, c in _ATTRIBUTE:
            v = F.replace(v, F.lit(entity), F.lit(c))
        return v

    return F.transform(_all(html, rf'(?i)\s{name}="([^"]*)"'), plain)


def attribute_events(pages: DataFrame, site: Site, page: str, now: datetime, days: int = 60, name: str = "data-current-context", under: str = "userItems") -> DataFrame:
    """Items of lists in JSON attributes: a title of 5 letters or more, no religious service, a date in the text that is in the window, or none (then now)."""
    item = "struct<title:string,description:string,buttonLink:struct<url:string>,image:struct<assetUrl:string>>"
    lists = F.transform(attributes(F.col("html"), name), lambda j: F.coalesce(F.from_json(j, f"struct<{under}:array<{item}>>")[under], F.array().cast(f"array<{item}>")))
    rows = pages.select("ord", F.posexplode_outer(F.flatten(lists)).alias("pos", "e")).filter("e is not null")
    rows = once(rows, title=strip_html(_text(F.col("e.title")))).filter(F.length("title") >= 5)
    rows = once(rows, text=strip_html(_text(F.col("e.description")))).filter(~religious(F.col("title"), F.col("text")))
    rows = once(rows, day=_group(F.col("text"), _MONTH_DATE))
    rows = once(rows, start=dates.first_day(F.col("day"), now).cast("timestamp")).filter(F.col("start").isNull() | _in_window(F.col("start"), now, days))
    link = F.coalesce(site.link(_some(F.col("e.buttonLink.url"))), F.lit(page))
    return conform(
        rows, source_id=F.concat(F.lit(f"{site.prefix}:"), _short(F.col("title"), 50)), description=clean_description(F.col("text")), start_date=_iso(F.coalesce("start", F.lit(now))),
        category=categorize(F.col("title"), F.col("text")), external_url=link, website_url=link, image_url=_some(F.col("e.image.assetUrl")), ord=numbered("ord", "pos"), **site.columns(),
    )


# Blocks of markup, by the first strategy that finds some.

# Containers of events, best first (tag, class), and what they hold.
BLOCKS = [("li", "user-items-list-item-container"), ("div", "blog-basic-grid--container"), ("article", "")]
_BLOCK_TITLES = (r"<h[1-4][^>]*>\s*(?:<a[^>]*>)?\s*([^<]+)", r'class="[^"]*(?:list-item-content__title|blog-title)[^"]*"[^>]*>([^<]+)')
_BLOCK_TEXT = r'(?is)class="[^"]*(?:list-item-content__description|blog-excerpt|description|excerpt)[^"]*"[^>]*>(.*?)</(?:p|div|span)>'
_NAVIGATION, _STREET = r"(?i)^(events?|home|about|contact|menu)$", r"(?i)^\d+\s+\w+\s+(blvd|st|ave|dr|rd|ln|way|ct)\b"


def block_events(pages: DataFrame, site: Site, now: datetime, days: int = 60, strategies: list[tuple[str, str]] | None = None) -> DataFrame:
    """Events in blocks of markup; of each page, the blocks of the first strategy that finds some there, nested blocks whole.

    A start comes from a time element, else from the text's first day with a name of a month, and is now if there is none.  No navigation,
    addresses, religious services, or starts out of the window.
    """
    strategies = strategies or BLOCKS
    blocks = first_strategy(elements(pages, sorted({t for t, _ in strategies})), strategies)
    inner = F.col("inner")
    title = strip_html(trimmed(_text(F.coalesce(*[_group(inner, p) for p in _BLOCK_TITLES]))))
    text = clean_description(strip_html(_text(_group(inner, _BLOCK_TEXT))))
    rows = blocks.select("ord", "pos", "strategy", "inner", title.alias("title"), text.alias("description"))
    rows = rows.filter((F.length("title") >= 5) & ~F.col("title").rlike(_NAVIGATION) & ~F.col("title").rlike(_STREET)).filter(~religious(F.col("title"), F.col("description")))
    declared = _group(inner, 'datetime="([^"]*)"')
    prose = dates.first_day(_group(strip_html(inner), _MONTH_DATE), now).cast("timestamp")
    rows = rows.withColumns({"declared": declared, "start": F.when(declared.isNotNull(), parse_timestamp(declared)).otherwise(prose)})
    rows = rows.filter((F.col("declared").isNull() & F.col("start").isNull()) | _in_window(F.col("start"), now, days))
    link = F.concat(F.lit(site.base), F.coalesce(_group(inner, r'href="(/events/[^"]*)"'), F.lit("/events/")))
    return conform(
        rows, source_id=F.concat(F.lit(f"{site.prefix}:"), _short(F.col("title"), 50)), start_date=F.coalesce("declared", _iso(F.coalesce("start", F.lit(now)))), category=categorize(F.col("title"), F.col("description")),
        external_url=link, website_url=link, image_url=_group(inner, r'(?i)(?:src|data-src)="([^"]*(?:jpg|jpeg|png|webp)[^"]*)"'), ord=numbered("ord", "pos"), **site.columns(),
    )
