"""The listing table: its schema, and the projection that makes any input fit it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS: list[tuple[str, T.DataType]] = [
    ("source_id", T.StringType()), ("source", T.StringType()), ("title", T.StringType()), ("description", T.StringType()),
    ("start_date", T.StringType()), ("end_date", T.StringType()), ("is_all_day", T.BooleanType()), ("category", T.StringType()),
    ("city", T.StringType()), ("address", T.StringType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType()),
    ("location_name", T.StringType()), ("image_url", T.StringType()), ("external_url", T.StringType()),
    ("is_featured", T.BooleanType()), ("is_recurring", T.BooleanType()), ("tags", T.ArrayType(T.StringType())), ("metro", T.StringType()),
    ("price", T.StringType()), ("age_range", T.StringType()), ("website_url", T.StringType()), ("phone", T.StringType()),
    ("contact_email", T.StringType()), ("status", T.StringType()),
]

LISTING = T.StructType([T.StructField(n, t) for n, t in _FIELDS])

#: Fields that are empty text, false or an empty list where an input has none; all others become null.
_REQUIRED = {"source_id", "source", "title", "description", "start_date", "category", "city", "metro"}


def default_of(name: str, kind: T.DataType) -> Column:
    if name in _REQUIRED:
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(None).cast(kind)


def conform(df: DataFrame, **columns: Column | str) -> DataFrame:
    """A listing table from df: `columns` by field, else the column of that name, else the default.  `ord` is kept."""
    out = []
    for name, kind in _FIELDS:
        given = columns.get(name, F.col(name) if name in df.columns else None)
        given = F.col(given) if isinstance(given, str) else given
        value = default_of(name, kind) if given is None else F.coalesce(given.cast(kind), default_of(name, kind))
        out.append(value.alias(name))
    if "ord" in columns or "ord" in df.columns:
        out.append(columns.get("ord", F.col("ord")).alias("ord"))
    return df.select(*out)


def present(name: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c != "", F.lit(False))


def or_else(name: str | Column, other: str | Column) -> Column:
    """The value unless it is null or empty."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(c, F.lit("")), F.col(other) if isinstance(other, str) else other)


#: Positions that one payload's items may have.
_POSITIONS = 1 << 32


def numbered(ord_: str | Column, pos: str | Column) -> Column:
    """A number for the item at a position of a row, in the order of both; no two items share one.  Larger positions end the run."""
    o, p = (F.col(c) if isinstance(c, str) else c for c in (ord_, pos))
    fits = (p >= 0) & (p < F.lit(_POSITIONS))
    return F.when(p.isNull() | fits, o.cast("long") * F.lit(_POSITIONS) + p.cast("long")).otherwise(F.raise_error(F.lit("an item's position is too large to be numbered")).cast("long"))
