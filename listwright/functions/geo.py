"""Coordinates: validity, distance, boxes, nearest place.  0, 0 means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_MILE, RADIUS = 1609.34, 6371008.8


def has_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat != 0) | (lon != 0), F.lit(False)) & lat.isNotNull() & lon.isNotNull()


def in_country(lat: Column, lon: Column) -> Column:
    """Valid and inside the box 24..50, -130..-65."""
    return has_coordinates(lat, lon) & F.coalesce(lat.between(24, 50) & lon.between(-130, -65), F.lit(False))


def metres(lat: Column, lon: Column, to_lat: Column | float, to_lon: Column | float) -> Column:
    """Great-circle distance (within about 0.6 % of the geodesic one)."""
    to_lat, to_lon = (x if isinstance(x, Column) else F.lit(x) for x in (to_lat, to_lon))
    dlat, dlon = F.radians(to_lat - lat), F.radians(to_lon - lon)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_miles(lat: Column, lon: Column, of: tuple[float, float], miles: float) -> Column:
    """In the circle; a box around it is tested first, which a scan can use."""
    d = miles / 68.0
    box = lat.between(of[0] - d, of[0] + d)
    return has_coordinates(lat, lon) & F.coalesce(box & (metres(lat, lon, *of) <= miles * METRES_PER_MILE), F.lit(False))


def squared_degrees(lat: Column, lon: Column, to_lat, to_lon) -> Column:
    return F.pow(lat - to_lat, F.lit(2)) + F.pow(lon - to_lon, F.lit(2))
