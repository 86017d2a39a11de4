"""Readers of captured answers of event APIs.  Each takes payloads (`ord`, `payload`) and gives listings.

A payload that isn't the expected JSON, and an item without the fields that a listing needs, give no rows.
Null and empty fields count as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import rules
from listwright.functions.text import clean_description, parse_timestamp, strip_html
from listwright.operators.categorize import categorize
from listwright.operators.changes import first_by
from listwright.operators.filters import any_keyword, religious
from listwright.plans.shared import once
from listwright.schema import conform, numbered, or_else


def _items(payloads: DataFrame, fields: str, under: str | None = None, keep: Iterable[str] = (), inner: Callable[[Column], Column] | None = None) -> DataFrame:
    """(kept columns, ord, e): one row for each item of the array in the payload, or in its field `under`; with inner, for each element of the array inner(item)."""
    many = f"array<struct<{''.join(fields.split())}>>"
    found = F.from_json("payload", f"struct<{under}:{many}>")[under] if under else F.from_json("payload", many)
    if inner is not None:
        found = F.flatten(F.filter(F.transform(found, inner), lambda a: a.isNotNull()))
    # The outer form: for the other one, a filter on the array's size would read the payload a second time.
    rows = payloads.select("ord", *keep, F.posexplode_outer(found).alias("pos", "e"))
    return rows.filter("e is not null").select(*keep, numbered("ord", "pos").alias("ord"), "e")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _named(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _in_days(start: Column, now: datetime, days: int) -> Column:
    """From this day's midnight to so many days from now."""
    t = parse_timestamp(start)
    return F.coalesce(t.between(F.lit(datetime(now.year, now.month, now.day)), F.lit(now + timedelta(days=days))), F.lit(False))


def review_events(payloads: DataFrame) -> DataFrame:
    """Events of a review site: not cancelled, two decimals in prices, the first address line or all lines."""
    e = _items(payloads, """id:string,name:string,description:string,category:string,is_canceled:boolean,is_free:boolean,cost:double,cost_max:double,time_start:string,
      time_end:string,image_url:string,event_site_url:string,latitude:double,longitude:double,location:struct<city:string,address1:string,display_address:array<string>>""", "events")  # fmt: skip
    e = e.filter(~F.coalesce("e.is_canceled", F.lit(False)))
    free, low, high = F.coalesce("e.is_free", F.lit(False)), F.col("e.cost"), F.col("e.cost_max")
    dollars = lambda v: F.format_string("$%.2f", v)
    price = F.when(free, "Free").when(low > 0, F.concat(dollars(low), F.when(high > low, F.concat(F.lit("-"), dollars(high))).otherwise("")))
    kind = F.col("e.category")
    return conform(e.select(
        F.concat(F.lit("yelp:"), F.col("e.id")).alias("source_id"), F.lit("yelp").alias("source"), F.col("e.name").alias("title"), clean_description(_text("e.description")).alias("description"),
        F.col("e.time_start").alias("start_date"), F.col("e.time_end").alias("end_date"), categorize(F.col("e.name"), F.concat_ws(" ", "e.description", kind)).alias("category"),
        F.col("e.location.city").alias("city"), or_else("e.location.address1", F.array_join("e.location.display_address", ", ")).alias("address"), "e.latitude", "e.longitude",
        _named(F.col("e.image_url")).alias("image_url"), F.col("e.event_site_url").alias("external_url"), price.alias("price"),
        F.array_compact(F.array(_named(kind), F.when(free, "free").otherwise("paid"))).alias("tags"), "ord",
    ))


def sale_events(payloads: DataFrame) -> DataFrame:
    """Events of a ticket-sale site: neither cancelled, drafts nor online, with a venue and a start."""
    amount = "struct<major_value:string>"
    e = _items(payloads, f"""id:string,name:struct<text:string>,description:struct<text:string>,url:string,status:string,online_event:boolean,is_free:boolean,
      start:struct<local:string>,`end`:struct<local:string>,logo:struct<url:string,original:struct<url:string>>,tags:array<struct<tag:string,display_name:string>>,
      ticket_availability:struct<minimum_ticket_price:{amount},maximum_ticket_price:{amount}>,
      venue:struct<name:string,address:struct<address_1:string,city:string,latitude:string,longitude:string>>""", "events")  # fmt: skip
    on = ~_text("e.status").isin("cancelled", "draft") & ~F.coalesce("e.online_event", F.lit(False))
    e = e.filter(on & F.col("e.venue").isNotNull() & (_text("e.start.local") != ""))
    low, high = (_named(F.col(f"e.ticket_availability.{x}_ticket_price.major_value")) for x in ("minimum", "maximum"))
    price = F.when(F.coalesce("e.is_free", F.lit(False)), "Free").when(low.isNotNull(), F.concat(F.lit("$"), low, F.when(low != high, F.concat(F.lit("-$"), high)).otherwise("")))
    kinds = F.array_compact(F.transform("e.tags", lambda t: _named(F.coalesce(_named(t["display_name"]), t["tag"]))))
    text, place = clean_description(_text("e.description.text")), "e.venue.address"
    return conform(e.select(
        F.concat(F.lit("eventbrite:"), F.col("e.id")).alias("source_id"), F.lit("eventbrite").alias("source"), F.col("e.name.text").alias("title"), text.alias("description"),
        F.col("e.start.local").alias("start_date"), F.col("e.end.local").alias("end_date"), categorize(F.col("e.name.text"), F.concat_ws(" ", text, F.array_join(kinds, " "))).alias("category"),
        F.col(f"{place}.city").alias("city"), F.col(f"{place}.address_1").alias("address"), F.col(f"{place}.latitude").try_cast("double").alias("latitude"),
        F.col(f"{place}.longitude").try_cast("double").alias("longitude"), F.col("e.venue.name").alias("location_name"), or_else("e.logo.original.url", _named(F.col("e.logo.url"))).alias("image_url"),
        F.col("e.url").alias("external_url"), F.col("e.url").alias("website_url"), price.alias("price"), kinds.alias("tags"), "ord",
    ))


@dataclass
class Library:
    """Where the branches of one library system are: by name, by calendar, else `default`."""

    default: str
    branches: dict[str, str] = field(default_factory=dict)
    calendars: dict[int, str] = field(default_factory=dict)


def branch_city(name: Column, calendar: Column, library: Library) -> Column:
    """The city of a branch: its name, then the first name that holds it or is held by it (an empty one is held by all), its calendar, the default."""
    exact = [F.when(name == k, c) for k, c in library.branches.items()]
    either = [F.when(name.contains(k) | F.lit(k).contains(name), c) for k, c in library.branches.items()]
    by_calendar = [F.when(calendar == k, c) for k, c in library.calendars.items()]
    return F.coalesce(*exact, *either, *by_calendar, F.lit(library.default))


def library_events(payloads: DataFrame, library: Library) -> DataFrame:
    """Events of a library calendar (payloads also have calendar_id), first of equal ids; none with words that aren't for families in its title."""
    e = _items(payloads, """id:long,title:string,startdt:string,enddt:string,all_day:boolean,location:string,calendar:string,shortdesc:string,description:string,registration_cost:string,
      url:string,featured_image:string,recurring_event:boolean""", "events", ["calendar_id"])  # fmt: skip
    e = e.filter((_text("e.title") != "") & (_text("e.startdt") != "") & ~any_keyword(F.col("e.title"), rules.LIBRARY_ADULT))
    place = _text(or_else("e.location", "e.calendar"))
    name = F.when((place != "") & ~F.lower(place).contains("library"), F.concat(place, F.lit(" Library"))).otherwise(place)
    text = clean_description(strip_html(_text(or_else("e.shortdesc", "e.description"))))
    cost = F.trim("e.registration_cost")
    iso = lambda c: F.regexp_replace(_named(F.col(c)), "^([^ ]+) ([^ ]+).*$", "$1T$2")
    rows = e.select(
        F.concat(F.lit("libcal:"), F.col("e.id").cast("string")).alias("source_id"), F.lit("libcal").alias("source"), F.trim("e.title").alias("title"), text.alias("description"),
        iso("e.startdt").alias("start_date"), iso("e.enddt").alias("end_date"), F.col("e.all_day").alias("is_all_day"), categorize(F.col("e.title"), text).alias("category"),
        branch_city(F.trim(F.lower(place)), F.col("calendar_id"), library).alias("city"), name.alias("location_name"), F.col("e.url").alias("external_url"), F.col("e.url").alias("website_url"),
        _named(F.col("e.featured_image")).alias("image_url"), F.col("e.recurring_event").alias("is_recurring"),
        F.when(cost.isin("", "0", "$0", "$0.00"), "Free").otherwise(F.coalesce(cost, F.lit("Free"))).alias("price"), "ord",
    )
    return conform(first_by(rows, "source_id"))


def park_schedule(parks: DataFrame, now: datetime, days: int = 60, zone: str = "America/Los_Angeles") -> DataFrame:
    """Special days of parks: ticketed events and extra hours, one of a kind for each park and date, from today on.

    parks: (ord, park_id, name, city, address, latitude, longitude, metro, url, payload); rows of several fetches of one park are one schedule.
    """
    about = ["park_id", "name", "city", "address", "latitude", "longitude", "metro", "url"]
    e = _items(parks, "date:string,type:string,openingTime:string,closingTime:string,description:string", "schedule", about).select("*", "e.date", "e.type")
    e = first_by(e.filter(F.col("type").isin("TICKETED_EVENT", "EXTRA_HOURS")), "park_id", "date", "type").filter(_in_days(F.col("date"), now, days))
    clock = lambda c: F.date_format(F.convert_timezone(None, F.lit(zone), F.try_to_timestamp(F.col(c))), "h:mm a")
    hours = F.coalesce(F.concat(F.lit("Hours: "), clock("e.openingTime"), F.lit(" - "), clock("e.closingTime"), F.lit(". ")), F.lit(""))
    extra, name, told = F.col("type") == "EXTRA_HOURS", F.col("name"), _named(F.col("e.description"))
    ticketed = F.when(told.isNotNull(), F.concat(told, F.lit(". "), hours, F.lit("Special ticketed event at "), name, F.lit(" — separate admission required."))).otherwise(
        F.concat(F.lit("Special ticketed event at "), name, F.lit(". "), hours, F.lit("Separate admission required."))
    )
    text = clean_description(F.when(extra, F.concat(F.lit("Extended hours at "), name, F.lit(". "), hours, F.lit("Extra time to enjoy the park with fewer crowds."))).otherwise(ticketed))
    opening = _named(F.col("e.openingTime"))
    return conform(e.select(
        F.concat(F.lit("themeparks:"), F.substring("park_id", 1, 8), F.when(extra, ":extra:").otherwise(":ticketed:"), F.col("date")).alias("source_id"), F.lit("themeparks").alias("source"),
        F.concat(name, F.when(extra, " Extra Hours").otherwise(" Special Ticketed Event")).alias("title"), text.alias("description"),
        F.coalesce(opening, F.concat("date", F.lit("T00:00:00"))).alias("start_date"), _named(F.col("e.closingTime")).alias("end_date"), opening.isNull().alias("is_all_day"),
        categorize(F.concat(name, F.when(extra, " Extra Hours").otherwise(" Special Event")), text).alias("category"), "city", "address", "latitude", "longitude", name.alias("location_name"),
        F.col("url").alias("external_url"), F.col("url").alias("website_url"), F.array(F.lit("theme-park"), F.when(extra, "extra-hours").otherwise("ticketed-event")).alias("tags"), "metro", "ord",
    ))


def dated_programs(payloads: DataFrame, source: str, audiences: list[str], now: datetime, days: int = 60) -> DataFrame:
    """One listing for each date in the window of a program: not online, for one of the audiences if it names any, no religious service."""
    e = _items(payloads, """EventItemOccurrenceId:long,Name:string,Description:string,Summary:string,Campus:string,LocationDescription:string,Audiences:array<struct<Value:string>>,
      Image:struct<Url:string>,FriendlyScheduleText:string,EventDates:array<struct<StartDateTime:string,EndDateTime:string>>""",
      inner=lambda i: F.transform(i["EventDates"], lambda d: F.struct(i.alias("e"), d.alias("d"))))
    e = e.select("ord", "e.e", "e.d")
    online = (_text("e.Campus") == "Online") | F.lower(_text("e.LocationDescription")).contains("zoom")
    meant = (F.coalesce(F.size("e.Audiences"), F.lit(0)) <= 0) | F.exists("e.Audiences", lambda a: F.lower(a["Value"]).isin(audiences))
    e = e.filter(~online & F.coalesce(meant, F.lit(False))).filter(_in_days(F.col("d.StartDateTime"), now, days))
    e = once(e, text=strip_html(_text(or_else("e.Description", "e.Summary")))).filter(~religious(F.col("e.Name"), F.col("text")))
    again = (F.size("e.EventDates") > 1) | _text("e.FriendlyScheduleText").startswith("Weekly")
    dates = once(e.withColumn("again", again), text=clean_description(F.col("text")))
    text, campus = F.col("text"), _named(F.col("e.Campus"))
    return conform(dates.select(
        F.concat(F.lit(f"{source}:"), F.col("e.EventItemOccurrenceId").cast("string"), F.lit("-"), F.substring_index("d.StartDateTime", "T", 1)).alias("source_id"), F.lit(source).alias("source"),
        F.col("e.Name").alias("title"), text.alias("description"), F.col("d.StartDateTime").alias("start_date"), _named(F.col("d.EndDateTime")).alias("end_date"),
        categorize(F.col("e.Name"), text).alias("category"), F.coalesce(campus, F.lit("Irvine")).alias("city"), F.concat_ws(" - ", campus, _named(F.col("e.LocationDescription"))).alias("location_name"),
        _named(F.col("e.Image.Url")).alias("image_url"), F.col("again").alias("is_recurring"), "ord",
    ))


def day_groups(payloads: DataFrame, source: str, kinds: list[int], far: list[str], now: datetime) -> DataFrame:
    """Events grouped by day, first of equal ids: of these kinds or none, not virtual, at no far campus, no religious service, from today on."""
    e = _items(payloads, """date:string,events:array<struct<id:long,name:string,publicName:string,description:string,summary:string,categoryId:int,isVirtual:boolean,location:string,
      campusName:string,photoUrl:string,isPaid:boolean,cost:string,occurrence:struct<localStartDateTime:string,localEndDateTime:string,date:string>,
      locationDetail:struct<address1:string,city:string,region:string,postalCode:string,latitude:double,longitude:double>>>""",
      inner=lambda g: F.transform(g["events"], lambda e: F.struct(g["date"].alias("day"), e.alias("e"))))
    e = e.select("ord", "e.day", "e.e").filter("e is not null")
    title = or_else("e.publicName", "e.name")
    start = or_else("e.occurrence.localStartDateTime", or_else("e.occurrence.date", "day"))
    kept = (_text(title) != "") & F.coalesce(F.col("e.categoryId").isin(kinds), F.lit(True)) & ~F.coalesce("e.isVirtual", F.lit(False))
    kept = kept & ~any_keyword(F.col("e.location"), ["online", "zoom"]) & ~any_keyword(F.col("e.campusName"), far)
    e = e.filter(kept & F.coalesce(parse_timestamp(start) >= F.lit(datetime(now.year, now.month, now.day)), F.lit(False)))
    e = once(e, text=strip_html(_text(or_else("e.description", "e.summary")))).filter(~religious(title, F.col("text")))
    e = once(e, text=clean_description(F.col("text")))
    at, clean = F.col("e.locationDetail"), F.col("text")
    address = F.when(at.isNotNull(), F.trim(F.regexp_replace(F.concat(_text(at["address1"]), F.lit(", "), _text(at["city"]), F.lit(", "), _text(at["region"]), F.lit(" "), _text(at["postalCode"])), r"^,\s*", "")))
    cost = _named(F.col("e.cost"))
    rows = e.select(
        F.concat(F.lit(f"{source}:"), F.col("e.id").cast("string"), F.lit("-"), F.substring_index(start, "T", 1)).alias("source_id"), F.lit(source).alias("source"), title.alias("title"),
        clean.alias("description"), start.alias("start_date"), _named(F.col("e.occurrence.localEndDateTime")).alias("end_date"), categorize(title, clean).alias("category"),
        or_else(at["city"], or_else("e.campusName", F.lit("Lake Forest"))).alias("city"), or_else("e.location", "e.campusName").alias("location_name"), address.alias("address"),
        at["latitude"].alias("latitude"), at["longitude"].alias("longitude"), _named(F.col("e.photoUrl")).alias("image_url"),
        F.when(F.coalesce("e.isPaid", F.lit(False)), F.concat(F.lit("$"), cost)).otherwise("Free").alias("price"), "ord",
    )
    return conform(first_by(rows, "source_id"))


def ongoing_search(payloads: DataFrame, source: str, cities: list[str], inside: str, outside: str, now: datetime, days: int = 60) -> DataFrame:
    """Search results that aren't over: those that began earlier start today; the metro is `inside` if the venue's city is one of the cities."""
    e = _items(payloads, """_source:struct<id:string,name:string,description:string,summary:string,starttime:string,endtime:string,allday:boolean,recurring_id:string,moreinfo:string,
      ticketurl:string,venue:struct<name:string,city:string,address:string,latitude:double,longitude:double>,geo:array<double>,tags:array<struct<name:string>>,
      multimedia:array<struct<id:string,image:string>>>""", "events").select("ord", F.col("e._source").alias("e"))  # fmt: skip
    today = F.lit(datetime(now.year, now.month, now.day)).cast("timestamp")
    start, end = parse_timestamp(F.col("e.starttime")), parse_timestamp(F.col("e.endtime"))
    begin = F.when((start < today) & (end > today), today).otherwise(start)
    title = F.trim(_text("e.name"))
    e = e.filter((title != "") & start.isNotNull() & F.coalesce(end >= today, F.lit(True)) & (begin <= F.lit(now + timedelta(days=days))))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    near = F.lower(_text("e.venue.city")).isin([c.lower() for c in cities])
    text = clean_description(strip_html(_text(or_else("e.description", "e.summary"))))
    number = lambda i, c: F.coalesce(F.nullif(F.get("e.geo", F.lit(i)), F.lit(0.0)), F.col(c))
    picture, link = F.get("e.multimedia", F.lit(0)), or_else("e.moreinfo", _named(F.col("e.ticketurl")))
    return conform(e.select(
        F.concat(F.lit(f"{source}:"), F.col("e.id")).alias("source_id"), F.lit(source).alias("source"), title.alias("title"), text.alias("description"), iso(begin).alias("start_date"), iso(end).alias("end_date"),
        F.col("e.allday").alias("is_all_day"), categorize(title, text).alias("category"), F.coalesce(_named(F.col("e.venue.city")), F.when(near, inside).otherwise(outside)).alias("city"),
        _named(F.col("e.venue.name")).alias("location_name"), _named(F.col("e.venue.address")).alias("address"), number(1, "e.venue.latitude").alias("latitude"), number(0, "e.venue.longitude").alias("longitude"),
        link.alias("external_url"), link.alias("website_url"), or_else(picture["image"], picture["id"]).alias("image_url"), (_text("e.recurring_id") != "").alias("is_recurring"),
        F.array_compact(F.transform("e.tags", lambda t: _named(t["name"]))).alias("tags"), F.when(near, inside).otherwise(outside).alias("metro"), "ord",
    ))


def read_records(records: DataFrame) -> DataFrame:
    """Listings from store records (record_name, fields): times in milliseconds or texts, flags as numbers, empty texts as missing; none without title or start."""
    names = records.select("fields.*").columns
    had = lambda n: F.col(f"fields.{n}") if n in names else F.lit(None).cast("string")
    time = lambda n: F.coalesce(F.date_format(F.timestamp_millis(had(n).try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss"), had(n).cast("string"))
    maybe = {n: _named(had(n)) for n in ("price", "age_range", "website_url", "phone", "contact_email", "status")}
    flags = {n: F.coalesce(had(n).try_cast("int") != 0, had(n).try_cast("boolean"), F.lit(False)) for n in ("is_all_day", "is_featured", "is_recurring")}
    plain = {n: had(n) for n in ("source_id", "source", "title", "description", "category", "city", "address", "latitude", "longitude", "location_name", "image_url", "external_url", "metro")}
    tags = had("tags") if "tags" in names else F.array().cast("array<string>")
    rows = records.select("record_name", *[c.alias(n) for n, c in {**plain, **maybe, **flags}.items()], time("start_date").alias("start_date"), time("end_date").alias("end_date"), tags.alias("tags"))
    return conform(rows.filter("title is not null and start_date is not null"), category=or_else("category", F.lit("Other")))
