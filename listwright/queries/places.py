"""Queries of the cascade that finds coordinates."""

from __future__ import annotations

from listwright import rules
from listwright.operators import locate
from listwright.queries.registry import LISTINGS, listings, query

# Listings that lack coordinates, and say something of their place in titles and texts; and what two services answer.  Both once for SQL and DataFrames.
_ASKING = """select ord, metro, address, image_url, website_url,
  case ord % 9 when 0 then 'Storytime at Oak Park' when 1 then 'Tustin Farmers Market' when 2 then 'Fair - Elm Museum' when 3 then 'Place: Bay Hall' when 4 then concat('Songs in Costa Mesa ', ord % 5) else title end as title,
  case ord % 7 when 0 then '' when 1 then 'Orange County' when 2 then 'Irvine' when 3 then 'Tustin' when 4 then 'la' else city end as city,
  case ord % 8 when 0 then 'Meet at 77 Elm Street, Brea, CA 92821 today' when 1 then 'Held at Lake Pavilion' when 2 then 'From Anaheim, CA 92805 on' when 3 then null else description end as description,
  case when ord % 10 = 6 then '' else location_name end as location_name,
  case when ord % 4 <> 1 then null when ord % 8 = 1 then cast(0 as double) else latitude end as latitude, case when ord % 8 = 1 then cast(0 as double) else longitude end as longitude from """
_ANSWERS = """
  select lower(concat(address, ', ', case when city <> '' then concat(city, '') else 'irvine' end)) as query, 'streets' as service, 33.0e0 + cast(length(address) as double) / 64e0 as latitude, -117.9e0 as longitude, cast(null as {s}) as address, cast(null as {s}) as photo_url
    from (select distinct address, city from asking where address is not null and length(address) % 2 = 0) a
  union all select * from (values
    ('hall 1, irvine, ca', 'streets', 33.6e0, -117.8e0, null, null), ('hall 2, los angeles, ca', 'streets', 34.1e0, -118.2e0, null, null), ('hall 4, irvine, ca', 'streets', 40.7e0, -74.0e0, null, null),
    ('77 elm street, brea, ca 92821, tustin', 'streets', 33.9e0, -117.9e0, null, null), ('77 elm street, brea, ca 92821', 'streets', 33.91e0, -117.91e0, null, null), ('anaheim, ca 92805, irvine', 'streets', 33.8e0, -117.9e0, null, null),
    ('anaheim, ca 92805', 'streets', 33.81e0, -117.9e0, null, null), ('oak park, los angeles, ca', 'streets', 34.0e0, -118.4e0, null, null), ('bay hall, irvine, ca', 'streets', 33.5e0, -117.6e0, null, null),
    ('lake pavilion, irvine, ca', 'streets', 33.55e0, -117.65e0, null, null), ('lake pavilion, los angeles, ca', 'streets', 34.05e0, -118.25e0, null, null), ('tustin, ca', 'streets', 33.7e0, -117.8e0, null, null), ('en, ca', 'streets', 33.75e0, -117.7e0, null, null),
    ('fr, ca', 'streets', 51.5e0, 0.1e0, null, null), ('hall 1, tustin, ca', 'places', 33.72e0, -117.81e0, '5 A St, Tustin, CA 92780, USA', 'https://p.example.org/1'), ('hall 2, irvine, ca', 'places', 33.65e0, -117.75e0, '6 B St, Lake Forest, CA 92630, USA', null),
    ('tustin farmers market, tustin, ca', 'places', 33.74e0, -117.82e0, '7 C St, Tustin, Orange County, California, 92780, USA', 'https://p.example.org/2'), ('elm museum, orange county, ca', 'places', 33.77e0, -117.83e0, '8 D St, CA 92780, Stanton, USA', 'https://p.example.org/3'),
    ('hall 5, la, ca', 'places', 34.02e0, -118.3e0, '9 E St, Venice, CA', 'https://p.example.org/4'), ('hall 3, los angeles, ca', 'places', 34.03e0, -118.31e0, 'Downtown', null), ('songs in costa mesa 1, costa mesa, ca', 'places', 33.66e0, -117.91e0, '1 F St, Costa Mesa, CA 92626', null)
  ) v"""  # fmt: skip


def _asking(spark, d: str):
    listings(spark, d)
    made = spark.sql(f"{_ASKING} ({LISTINGS.format(s='string').replace('from documents', 'from documents_of_listings')}) l")
    made.createOrReplaceTempView("asking_of_listings")
    answers = spark.sql(_ANSWERS.format(s="string").replace("from asking", "from asking_of_listings"))
    return made, answers


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(text: str, pattern: str) -> str:
    return f"nullif(trim(regexp_extract({text}, {_q(pattern)}, 1)), '')"


def _list(values) -> str:
    return ", ".join(_q(v) for v in values)


def _pick(column: str, table: dict[str, str]) -> str:
    return f"case {column} {' '.join(f"when '{k}' then '{v}'" for k, v in table.items())} end"


_TITLE_CITY = "case " + " ".join(f"when regexp_matches(lower(title), '(?:^|\\bat\\b|\\bin\\b|\\s[-–]\\s)\\s*{r'\s+'.join(c.lower().split())}') then '{c}'" for c in rules.TITLE_CITIES) + " end"
_BOX = " or ".join(f"(metro = '{m}' and not (latitude between {a - 0.5} and {b + 0.5} and longitude between {c - 0.5} and {d + 0.5}))" for m, (a, b, c, d) in rules.METRO_BOXES.items())
_VALID = "(latitude is not null and longitude is not null and (latitude <> 0 or longitude <> 0) and latitude between 24 and 50 and longitude between -130 and -65)"
_GENERIC = f"lower(trim(%s)) in ({_list(rules.GENERIC_CITIES)})"
_PLACE_KEY = "lower(concat_ws('|', coalesce(location_name, ''), coalesce(address, ''), coalesce(city, ''), coalesce(metro, '')))"
_ANSWER = "answers as (select service, query, arg_min(latitude, latitude) as latitude, arg_min(longitude, latitude) as longitude, arg_min(address, latitude) as found, arg_min(photo_url, latitude) as photo from all_answers group by service, query)"
_HEAD = f"with asking as ({_ASKING} {{listings}}), all_answers as ({_ANSWERS.format(s='varchar')}), {_ANSWER}"


@query("locate", f"""{_HEAD},
lost as (select *, {_PLACE_KEY} as spot from asking where not coalesce({_VALID}, false)),
firsts as (select * from lost qualify row_number() over (partition by spot order by ord) = 1),
f1 as (select *, nullif(city, '') as c, nullif(location_name, '') as n, coalesce(description, '') as text, coalesce({_pick('metro', rules.METRO_CITIES)}, city) as mc,
  case when nullif(city, '') is null or {_GENERIC % 'city'} then coalesce({_TITLE_CITY}, nullif(city, '')) else city end as own,
  coalesce({_first('title', rules.VENUE_AT)}, {_first('title', rules.VENUE_COLON)}, {_first('title', rules.VENUE_DASH)}) as tv from firsts),
f2 as (select *, coalesce(own || ', CA', mc) as sc, coalesce({_first('text', rules.STREET_IN_TEXT)}, {_first('text', rules.ZIP_IN_TEXT)}) as st, {_first('text', rules.VENUE_IN_TEXT)} as dv, case when not {_GENERIC % 'own'} then own end as named from f1),
q as (
  select spot, metro, 0 as strategy, 0 as pos, 'places' as service, n || ', ' || nullif(address, '') || ', ' || sc as query, named as must, null as own_address from f2
  union all select spot, metro, 0, 1, 'places', n || ', ' || sc, named, null from f2
  union all select spot, metro, 0, 2, 'places', tv || ', ' || sc, named, null from f2 where tv is distinct from n
  union all select spot, metro, 0, 3, 'places', title || ', ' || sc, named, null from f2
  union all select spot, metro, 0, 4, 'places', n || ', ' || mc, null, null from f2 where sc <> mc
  union all select spot, metro, 1, 5, 'streets', concat_ws(', ', address, c), null, null from f2 where length(address) > 5
  union all select spot, metro, 2, 6, 'streets', n || ', ' || mc, null, null from f2 where length(n) > 2
  union all select spot, metro, 3, 7, 'streets', concat_ws(', ', st, c), null, st from f2 where st is not null
  union all select spot, metro, 4, 8, 'streets', tv || ', ' || mc, null, null from f2
  union all select spot, metro, 5, 9, 'streets', dv || ', ' || mc, null, null from f2
  union all select spot, metro, 6, 10, 'streets', concat_ws(', ', c, {_pick('metro', rules.METRO_STATES)}), null, null from f2 where length(c) > 2),
hits as (select q.*, a.latitude, a.longitude, coalesce(own_address, found) as address, photo from q join answers a on q.service = a.service and lower(q.query) = a.query
  where (must is null or coalesce(found, '') = '' or contains(lower(found), lower(must))) and not coalesce({_BOX}, false)),
best as (select * from hits qualify row_number() over (partition by spot order by pos) = 1),
j as (select l.*, b.strategy, b.query as asked, b.latitude as blat, b.longitude as blon, b.address as baddress, b.photo, coalesce({_VALID.replace('latitude', 'l.latitude').replace('longitude', 'l.longitude')}, false) as ok, b.spot is not null as hit
  from asking l left join best b on not coalesce({_VALID.replace('latitude', 'l.latitude').replace('longitude', 'l.longitude')}, false) and {_PLACE_KEY.replace('location_name', 'l.location_name').replace('address', 'l.address').replace('city', 'l.city').replace('metro', 'l.metro')} = b.spot),
p as (select *, list_filter(list_transform(string_split(baddress, ', '), lambda x: trim(x)), lambda x: x <> '') as parts from j)
select ord, case when hit then blat when ok or latitude is null or longitude is null then latitude end as latitude, case when hit then blon when ok or latitude is null or longitude is null then longitude end as longitude,
  case when coalesce(address, '') <> '' then address else coalesce(baddress, address) end as address, strategy, asked,
  case when hit and {_GENERIC % "coalesce(city, '')"} and len(parts) >= 3 then coalesce(list_filter(parts[2:], lambda x: not regexp_matches(x, '^[0-9]|^[A-Z]{{2}}(\\s+[0-9]{{5}}|$)') and lower(x) not in ({_list(rules.STATE_NAMES)}) and x not in ('USA', 'United States'))[1], city) else city end as city,
  case when coalesce(image_url, '') = '' and not coalesce(website_url <> '' and not contains(website_url, 'google.com/search') and not contains(website_url, 'mommypoppins.com') and not contains(website_url, 'macaronikid.com'), false) then coalesce(photo, image_url) else image_url end as image_url
from p""")  # fmt: skip
def _(l, spark, d):
    """Coordinates, addresses, cities and pictures of places, by seven ranked strategies and two answer tables."""
    made, answers = _asking(spark, d)
    found = locate.locate(made, answers.filter("service = 'places'"), answers.filter("service = 'streets'"))
    return found.select("ord", "latitude", "longitude", "address", "strategy", "asked", "city", "image_url")


@query("venue_search", f"""{_HEAD},
f as (select *, nullif(location_name, '') as n, coalesce(description, '') as text, coalesce({_pick('metro', rules.METRO_CITIES)}, metro) as mc from asking),
g as (select *, coalesce({_first('text', rules.STREET_IN_TEXT)}, {_first('text', rules.ZIP_IN_TEXT)}) as st, {_first('text', rules.VENUE_HINT)} as dv from f),
q as (select ord, 1 as strategy, st as query, st as own_address from g union all select ord, 2, n || ', ' || mc, null from g where length(n) > 2 union all select ord, 3, dv || ', ' || mc, null from g),
best as (select q.*, a.latitude, a.longitude from q join answers a on a.service = 'streets' and lower(q.query) = a.query qualify row_number() over (partition by ord order by strategy) = 1)
select l.ord, b.latitude as found_latitude, b.longitude as found_longitude, b.own_address as found_address, b.strategy from asking l left join best b on l.ord = b.ord""")  # fmt: skip
def _(l, spark, d):
    """A venue's place, by an address in the text, its name, or a venue in the text."""
    made, answers = _asking(spark, d)
    return locate.venue_search(made, answers.filter("service = 'streets'")).select("ord", "found_latitude", "found_longitude", "found_address", "strategy")
