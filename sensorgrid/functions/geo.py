"""Geographic expressions on longitude / latitude columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8

_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
_POINT = rf"POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)"


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(half))


def inverse_distance_weight(distance: Column, power: float = 1) -> Column:
    """`1 / distance ** power`; null at distance zero."""
    base = distance if power == 1 else F.pow(distance, F.lit(float(power)))
    return F.try_divide(F.lit(1.0), base)


def wkt_point(lon: Column, lat: Column) -> Column:
    """`POINT(lon lat)` text."""
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_lon(text: Column) -> Column:
    """Longitude of a WKT point, null when it is not one."""
    return empty_number(F.regexp_extract(text, _POINT, 1))


def wkt_lat(text: Column) -> Column:
    """Latitude of a WKT point, null when it is not one."""
    return empty_number(F.regexp_extract(text, _POINT, 2))


def _corners(text: Column) -> Column:
    """Corners `x y, x y, ...` as array<struct<x, y>>; further ordinates are dropped."""
    def corner(pair: Column) -> Column:
        numbers = F.split(F.trim(pair), r"\s+")
        return F.struct(
            F.get(numbers, F.lit(0)).try_cast("double").alias("x"),
            F.get(numbers, F.lit(1)).try_cast("double").alias("y"),
        )

    return F.transform(F.split(text, ","), corner)


def wkt_paths(text: Column) -> Column:
    """Paths of a WKT (multi)line: array<array<struct<x, y>>>; null when it is none."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), _corners)
    return F.when(text.rlike(r"(?i)^\s*(MULTI)?LINESTRING"), parts)


def wkt_rings(text: Column) -> Column:
    """Rings of a WKT (multi)polygon: array<struct<hole, points>>; null when it is none.

    The first ring behind two brackets is an outline, the others are holes. The closing
    corner, a copy of the first, is dropped.
    """
    def ring(part: Column) -> Column:
        points = _corners(F.regexp_extract(part, r"\(([^()]+)\)", 1))
        closed = F.element_at(points, 1) == F.element_at(points, -1)
        kept = F.slice(points, F.lit(1), F.size(points) - F.when(closed, 1).otherwise(0))
        return F.struct((~part.startswith("((")).alias("hole"), kept.alias("points"))

    found = F.regexp_extract_all(text, F.lit(r"\(?\([^()]+\)"), F.lit(0))
    return F.when(text.rlike(r"(?i)^\s*(MULTI)?POLYGON"), F.transform(found, ring))


def empty_number(text: Column) -> Column:
    """Double, with the empty string as null."""
    return F.nullif(text, F.lit("")).cast("double")
