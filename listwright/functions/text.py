"""Text projections of listings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web pages use it, the no-break space included.
WS = r"[\s\x{00A0}\x{FEFF}]"

# Cities that a title may begin with.
LEADING_CITIES = (
    "san diego", "los angeles", "orange county", "anaheim", "long beach", "irvine", "santa ana", "pasadena", "glendale", "burbank", "costa mesa",
    "huntington beach", "newport beach", "laguna beach", "fullerton", "torrance", "santa monica", "san juan capistrano", "dana point", "san clemente",
    "mission viejo", "lake forest", "tustin", "yorba linda", "brea", "la habra", "placentia", "buena park", "garden grove", "westminster", "fountain valley",
    "cypress", "stanton", "la palma", "cerritos", "lakewood", "downey", "whittier", "pomona", "ontario", "rancho cucamonga", "riverside", "temecula",
    "carlsbad", "oceanside", "escondido", "encinitas", "del mar",
)

# Entities and what they stand for, in the order in which they are decoded.
NUMBERED = (("&#039;", "'"), ("&#8211;", "–"), ("&#8212;", "—"), ("&#8216;", "'"), ("&#8217;", "'"), ("&#8220;", "“"), ("&#8221;", "”"))
NAMED = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&rdquo;", "”"), ("&ldquo;", "“"),
    ("&ndash;", "–"), ("&mdash;", "—"),
)
PLAIN = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def _swap(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")  # $ would match before a line separator at the end too


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, f"{WS}+", " "))


def decode_entities(text: Column) -> Column:
    """Named and numeric HTML entities (decimal, below 65536) as characters."""
    text = _swap(text, NUMBERED)
    pieces = F.split(text, "&#(?=[0-9]+;)")
    code = lambda p: F.regexp_extract(p, "^([0-9]+);", 1)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.concat(_char(code(p)), F.regexp_replace(p, "^[0-9]+;", "")))
    whole = F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))
    return trimmed(_swap(F.when(F.size(pieces) > 1, whole).otherwise(text), NAMED))


def _char(number: Column) -> Column:
    """The character of a decimal number modulo 65536."""
    n = F.pmod(F.coalesce(number.try_cast("long"), F.lit(0)), F.lit(65536))
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def clean_description(raw: Column, longest: int = 500) -> Column:
    """Without tags, a few entities decoded, white space collapsed, cut."""
    return F.substring(collapsed(_swap(F.regexp_replace(raw, "<[^>]*>", ""), PLAIN)), 1, longest)


def strip_html(raw: Column) -> Column:
    """Text of HTML with line breaks for br and p, and at most two in a row."""
    text = F.regexp_replace(F.regexp_replace(raw, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n")
    text = _swap(F.regexp_replace(text, "<[^>]+>", ""), PLAIN)
    return trimmed(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normal_title(title: Column) -> Column:
    """A title as far as it counts for comparison; the order of the steps matters."""
    t = F.regexp_replace(F.lower(title), r"\s*\([^)]*\)", "")
    t = F.regexp_replace(t, r"\s+(?:in|at)\s+[\w\s]+$", "")
    t = F.regexp_replace(t, rf"^(?:{'|'.join(LEADING_CITIES)})\s+", "")
    t = F.regexp_replace(t, r"\s+20\d{2}$", "")
    t = F.regexp_replace(t, r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def dedup_key(title: Column, start: Column, city: Column) -> Column:
    """day:city:title; listings with equal keys are the same."""
    return F.concat_ws(":", F.substring(start, 1, 10), F.regexp_replace(F.lower(city), r"\s+", ""), normal_title(title))


def slug(text: Column, longest: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, longest)


def record_name(source_id: Column) -> Column:
    return F.regexp_replace(source_id, "[^a-zA-Z0-9_-]", "_")


def text_hash(text: Column) -> Column:
    """The 32-bit hash 31 * h + character code, as a signed number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c != 0), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + 2**31, F.lit(2**32)) - 2**31)


def search_url(*parts: Column, longest: int = 150) -> Column:
    """A web search for the words; spaces as %20, parentheses kept."""
    words = F.substring(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), 1, longest)
    coded = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("+", "%20"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%27", "'"), ("%7E", "~")), F.url_encode(words))
    return F.concat(F.lit("https://www.google.com/search?q="), coded)


def city_of_address(address: Column) -> Column:
    """The first part after the street that is no ZIP code, state, country or number."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    ok = lambda p: (p != "") & ~p.rlike(r"^\d{5}(-\d{4})?$") & ~p.rlike(r"^[A-Z]{2}(\s+\d{5}(-\d{4})?)?$") & ~F.lower(p).isin("usa", "us", "united states") & ~p.rlike(r"^\d+$")
    return F.get(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ok), F.lit(0))


def parse_time(text: Column) -> Column:
    """Clock time HH:MM of `10:00 AM`, `9:30a` or `4 pm`; null if there is none."""
    pattern = r"(?i)(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m?"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    minute = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("00"))
    late = F.lower(F.regexp_extract(text, pattern, 3)) == "p"
    h24 = F.when(late & (hour < 12), hour + 12).when(~late & (hour == 12), 0).otherwise(hour)
    return F.when(hour.isNotNull(), F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), minute))


def parse_timestamp(text: Column) -> Column:
    """A timestamp from any accepted form (with or without zone, with a space, date only); else null."""
    return F.try_to_timestamp(text)


def clean_tags(tags: Column, unwanted: list[str]) -> Column:
    return F.filter(tags, lambda t: ~F.lower(t).isin([u.lower() for u in unwanted]))
