"""API readers on hand-made answers: what is kept, what is missing, what isn't JSON."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from listwright import rules
from listwright.operators import repair
from listwright.sources import apis

NOW = datetime(2024, 1, 13, 9, 30)


def payloads(spark, *items, **more):
    rows = [(i, x if isinstance(x, str) or x is None else json.dumps(x), *more.values()) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, ", ".join(["ord long", "payload string", *[f"{n} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in more.items()]]))


def test_unreadable_and_empty_answers(spark):
    bad = payloads(spark, None, "", "no json", "[]", "{}", {"events": None}, {"events": []}, {"events": [None]})
    assert apis.review_events(bad).count() == apis.sale_events(bad).count() == apis.ongoing_search(bad, "s", ["x"], "a", "b", NOW).filter("title <> ''").count() == 0
    assert apis.dated_programs(bad, "p", [], NOW).count() == apis.day_groups(bad, "d", [1], ["x"], NOW).count() == 0
    assert apis.library_events(bad.withColumn("calendar_id", F.lit(1)), apis.Library("X")).count() == 0


def test_review_prices(spark):
    p = payloads(spark, {"events": [{"id": "a", "name": "A", "cost": 3, "cost_max": 4.5}, {"id": "b", "name": "B", "cost": 0}, {"id": "c", "name": "C", "is_free": True, "cost": 9}, {"id": "d", "is_canceled": True}]})
    assert [(r.source_id, r.price, r.tags) for r in apis.review_events(p).orderBy("ord").collect()] == [("yelp:a", "$3.00-$4.50", ["paid"]), ("yelp:b", None, ["paid"]), ("yelp:c", "Free", ["free"])]


def test_branches(spark):
    library = apis.Library("Orange", {"main": "Santa Ana", "el modena": "El Modena"}, {7: "Brea"})
    rows = [("main", 1), ("el modena", 1), ("main street", 1), ("modena", 1), ("hall", 7), ("hall", 1), ("", 7), (None, None)]
    found = spark.createDataFrame(rows, "n string, c long").select(apis.branch_city(F.col("n"), F.col("c"), library)).collect()
    assert [r[0] for r in found] == ["Santa Ana", "El Modena", "Santa Ana", "El Modena", "Brea", "Orange", "Santa Ana", "Orange"]


def test_dates_in_the_window(spark):
    item = {"EventItemOccurrenceId": 5, "Name": "Fair", "Campus": "Irvine", "EventDates": [{"StartDateTime": f"2024-{d}T10:00:00"} for d in ("01-12", "01-13", "03-13", "03-14")]}
    online = item | {"EventItemOccurrenceId": 6, "LocationDescription": "On ZOOM"}
    service = item | {"EventItemOccurrenceId": 7, "Description": "<p>A <b>Bible study</b></p>"}
    rows = apis.dated_programs(payloads(spark, [item, online, service, {"Name": "No dates"}]), "p", ["kids"], NOW).orderBy("ord").collect()
    assert [(r.source_id, r.is_recurring) for r in rows] == [("p:5-2024-01-13", True)]


def test_schedule_takes_one_of_a_kind_and_date(spark):
    day = {"date": "2024-01-20", "type": "TICKETED_EVENT", "openingTime": "2024-01-20T19:00:00-08:00", "closingTime": "2024-01-21T01:00:00-08:00"}
    p = payloads(spark, {"schedule": [day, day | {"type": "OPERATING"}, {"date": "2024-01-20", "type": "EXTRA_HOURS"}]}, {"schedule": [day, day | {"date": "2023-01-20"}]}, park_id="12345678-9", name="P", city="C", address="A", latitude=1.0, longitude=2.0, metro="m", url="u")
    rows = apis.park_schedule(p, NOW).orderBy("ord").collect()
    assert [r.source_id for r in rows] == ["themeparks:12345678:ticketed:2024-01-20", "themeparks:12345678:extra:2024-01-20"]
    assert rows[0].description == "Special ticketed event at P. Hours: 7:00 PM - 1:00 AM. Separate admission required." and rows[1].is_all_day and not rows[0].is_all_day


def test_records(spark):
    rows = [("a", ("T", 1704067200000, None, 1, "")), ("b", (None, 1, None, 0, "")), ("c", ("U", None, None, None, None))]
    found = apis.read_records(spark.createDataFrame(rows, "record_name string, fields struct<title:string,start_date:long,end_date:long,is_all_day:int,price:string>")).collect()
    assert [(r.title, r.start_date, r.is_all_day, r.price, r.category) for r in found] == [("T", "2024-01-01T00:00:00", True, None, "Other")]


def test_first_value_of_a_link(spark):
    rows = [(1, None, None), (2, "u", None), (3, "u", "b"), (4, "u", "a"), (5, "", "z"), (6, "v", None), (7, "u", None)]
    found = repair.same_link(spark.createDataFrame(rows, "ord long, external_url string, price string"), "price").orderBy("ord").collect()
    assert [r.price for r in found] == [None, "b", "b", "a", "z", None, "b"]


def test_rule_tables_are_whole():
    assert len(rules.RELIGIOUS) == 86 and len(rules.LIBRARY_ADULT) == 72 and len(rules.MEETUPS) == 7
