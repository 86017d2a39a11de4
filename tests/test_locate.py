"""The cascade of places against a plain loop over listings, and what it does to them."""

import random

from listwright.operators import locate

FIELDS = "ord long, title string, description string, location_name string, address string, city string, metro string, latitude double, longitude double, image_url string, website_url string"
PLACES = "query string, latitude double, longitude double, address string, photo_url string"


def listing(ord_, **more):
    base = {"title": "Fair", "description": "", "location_name": None, "address": None, "city": "Irvine", "metro": "orange-county", "latitude": None, "longitude": None, "image_url": None, "website_url": None}
    return (ord_, *{**base, **more}.values())


def located(spark, rows, places=(), streets=()):
    df = spark.createDataFrame(rows, FIELDS)
    p = None if places is None else spark.createDataFrame([(*x, *[None] * (5 - len(x))) for x in places], PLACES)
    return {r.ord: r for r in locate.locate(df, p, spark.createDataFrame(list(streets), "query string, latitude double, longitude double")).collect()}


def test_each_strategy_decides(spark):
    here, far = (33.6, -117.8), (40.7, -74.0)
    rows = [
        listing(0, location_name="Zoo"), listing(1, address="5 A Street"), listing(2, location_name="Yard"), listing(3, description="Meet at 77 Elm Street, Brea, CA 92821 now", city="Brea"), listing(4, title="Songs at the Oak Park", city="Tustin"),
        listing(5, description="Held at Lake Pavilion", city=""), listing(6, city="Stanton"), listing(7, city="Nowhere"), listing(8, location_name="Zoo", metro="mars", city="Mars"), listing(9, location_name="Far Hall"),
    ]
    streets = [("5 a street, IRVINE", *here), ("Yard, Irvine, CA", *here), ("77 Elm Street, Brea, CA 92821, Brea", *here), ("Oak Park, Irvine, CA", *here), ("Lake Pavilion, Irvine, CA", *here), ("Stanton, CA", *here), ("Far Hall, Irvine, CA", *far), ("Irvine, CA", *here), ("Zoo, Mars", 1.0, 1.0)]
    got = located(spark, rows, [("Zoo, Irvine, CA", *here, "1 Zoo Way, Irvine, CA 92602")], streets)
    assert {i: r.strategy for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: None, 8: 2, 9: 6}
    assert got[0].address == "1 Zoo Way, Irvine, CA 92602" and got[3].address == "77 Elm Street, Brea, CA 92821" and got[8].latitude == 1.0
    assert located(spark, rows, None, streets)[0].strategy == 6  # without the service of places


def test_answers_of_places_must_name_the_city(spark):
    zoo = [listing(0, location_name="Zoo", city="Tustin"), listing(1, location_name="Zoo", city="Orange County"), listing(2, location_name="Zoo", title="Day in Costa Mesa", city="OC")]
    places = [("Zoo, Tustin, CA", 33.6, -117.8, "2 B St, Irvine, CA 92602, USA", "photo"), ("zoo, orange county, ca", 33.6, -117.8, "3 C St, Lake Forest, CA 92630, USA", "photo"), ("Zoo, Costa Mesa, CA", 33.7, -117.9, "4 D St, Costa Mesa, CA")]
    got = located(spark, zoo, places)
    assert got[0].strategy is None  # the answer lies in another city
    assert (got[1].city, got[1].image_url, got[1].strategy) == ("Lake Forest", "photo", 0)
    assert (got[2].city, got[2].latitude) == ("Costa Mesa", 33.7)
    again = located(spark, [listing(0, location_name="Zoo", city="Tustin")], [("Zoo, Tustin, CA", 33.6, -117.8, "2 B St, Irvine, CA 92602, USA"), ("Zoo, Irvine, CA", 33.61, -117.81, "2 B St, Irvine, CA 92602, USA")])
    assert again[0].latitude == 33.61  # in the metro's city, any city will do


def test_a_place_is_asked_for_once(spark):
    rows = [listing(3, title="Later at Oak Park", location_name=""), listing(1, title="First at Elm Park"), listing(2, latitude=0.0, longitude=0.0, location_name="", image_url="own"), listing(4, latitude=33.0, longitude=-117.0), listing(5, latitude=60.0, longitude=10.0, city="X"), listing(6, latitude=60.0, city="X")]
    got = located(spark, rows, [("Elm Park, Irvine, CA", 33.6, -117.8, None, "photo")], [("Oak Park, Irvine, CA", 33.9, -117.9)])
    assert [got[i].latitude for i in (1, 2, 3, 4)] == [33.6, 33.6, 33.6, 33.0] and got[2].image_url == "own" and got[1].image_url == "photo"
    assert got[5].latitude is None and got[5].longitude is None and got[6].latitude == 60.0  # wrong coordinates go, if both are there


def test_many_listings_of_one_place(spark):
    rng = random.Random(1)
    rows = [listing(i, location_name="Zoo" if rng.random() < 0.9 else f"Z{i}") for i in range(3000)]
    got = located(spark, rows, [], [("zoo, irvine, ca", 33.6, -117.8), ("zoo, irvine, ca", 34.6, -117.8)])
    assert len(got) == 3000 and {r.latitude for r in got.values()} == {33.6, None}


def test_venue_search(spark):
    rows = [listing(0, description="at 5 Oak Road"), listing(1, location_name="Zoo"), listing(2, description="@ Big Barn"), listing(3, location_name="Zo", description="x"), listing(4, description=None, location_name="Zoo", metro="mars")]
    streets = [("5 oak road", 1.0, 2.0), ("Zoo, Irvine, CA", 3.0, 4.0), ("Big Barn, Irvine, CA", 5.0, 6.0), ("zoo, mars", 7.0, 8.0)]
    found = locate.venue_search(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(streets, "query string, latitude double, longitude double"))
    assert sorted((r.ord, r.strategy, r.found_latitude, r.found_address) for r in found.collect()) == [(0, 1, 1.0, "5 Oak Road"), (1, 2, 3.0, None), (2, 3, 5.0, None), (3, None, None, None), (4, 2, 7.0, None)]
