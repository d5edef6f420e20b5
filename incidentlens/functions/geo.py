"""Geometry as column expressions: no UDFs, so everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

KM_PER_DEGREE = 111.0


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = rules.EARTH_KM) -> Column:
    """Great-circle distance in km between two coordinate pairs in degrees."""
    return arc_km(haversine(angles(lat1, lon1), angles(lat2, lon2)), radius_km)


def angles(lat, lon) -> list[Column]:
    """What a position adds to `haversine`: latitude and longitude in radians, and the cosine of the first."""
    return [F.radians(lat), F.radians(lon), F.cos(F.radians(lat))]


def haversine(one, other) -> Column:
    """Square of half the chord between two positions given by their `angles`."""
    half_lat = F.sin((other[0] - one[0]) / 2)
    half_lon = F.sin((other[1] - one[1]) / 2)
    return half_lat * half_lat + one[2] * other[2] * half_lon * half_lon


def arc_km(a: Column, radius_km: float = rules.EARTH_KM) -> Column:
    """Great-circle distance in km that belongs to a `haversine`."""
    return F.lit(2 * radius_km) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def arc_at_most(a: Column, km: float, radius_km: float = rules.EARTH_KM) -> Column:
    """Whether arc_km(a) <= km: the arc itself is taken only where `a` lies close to the limit."""
    limit = math.sin(min(km / (2 * radius_km), math.pi / 2)) ** 2
    return (a <= limit * (1 - 1e-9)) | (a <= limit * (1 + 1e-9)) & (arc_km(a, radius_km) <= km)


def in_box(lat: Column, lon: Column, box) -> Column:
    """Inside (lat_min, lat_max, lon_min, lon_max), ends included; null stays null.

    As a filter this is four plain comparisons, which reach the file scan.
    """
    lat_min, lat_max, lon_min, lon_max = box
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def quadrant(lat: Column, lon: Column, box) -> Column:
    """NE / NW / SE / SW by the middle of the box; the middle itself counts as north and east."""
    lat_min, lat_max, lon_min, lon_max = box
    north = F.when(lat >= (lat_min + lat_max) / 2, "N").otherwise("S")
    east = F.when(lon >= (lon_min + lon_max) / 2, "E").otherwise("W")
    return F.concat(north, east)


def floor_long(c: Column) -> Column:
    return F.floor(c).cast("long")


def degrees_north(km: float) -> float:
    """Latitude span of a distance, rounded outwards (111 km per degree is a little short)."""
    return km / KM_PER_DEGREE


def degrees_east(lat: Column, km: float) -> Column:
    """Longitude span of a distance at the far edge of its own latitude band."""
    edge = F.least(F.abs(lat) + F.lit(degrees_north(km)), F.lit(89.9))
    return F.lit(degrees_north(km)) / F.cos(F.radians(edge))


class CellGrid:
    """Latitude rows of fixed height; each row has its own column width.

    The width is set at the row's edge nearest the pole, so a cell is never narrower than `side_km`
    anywhere in the row and the grid works from the equator to high latitudes.
    """

    def __init__(self, side_km: float):
        self.side_km = side_km
        self.height = degrees_north(side_km)

    def row(self, lat: Column) -> Column:
        return floor_long(lat / F.lit(self.height))

    def width(self, row: Column) -> Column:
        far = F.greatest(F.abs(row), F.abs(row + 1)) * F.lit(self.height)
        return F.lit(self.height) / F.cos(F.radians(F.least(far, F.lit(89.9))))

    def col(self, lon: Column, row: Column) -> Column:
        return floor_long(lon / self.width(row))

    def rows_within(self, lat: Column, km: float) -> Column:
        d = F.lit(degrees_north(km))
        return F.sequence(self.row(lat - d), self.row(lat + d))

    def cols_within(self, lat: Column, lon: Column, row: Column, km: float) -> Column:
        d = degrees_east(lat, km)
        return F.sequence(self.col(lon - d, row), self.col(lon + d, row))

    def box(self, row: Column, col: Column):
        """(lat_min, lat_max, lon_min, lon_max) of a cell."""
        w = self.width(row)
        h = F.lit(self.height)
        return row * h, (row + 1) * h, col * w, (col + 1) * w


def box_distance_bounds(lat, lon, box, radius_km: float = rules.EARTH_KM):
    """Lower and upper bound of the distance from a point to any point of a small box."""
    lat_min, lat_max, lon_min, lon_max = box
    gap_lat = F.greatest(lat_min - lat, lat - lat_max, F.lit(0.0))
    gap_lon = F.greatest(lon_min - lon, lon - lon_max, F.lit(0.0))
    span_lat = F.greatest(F.abs(lat - lat_min), F.abs(lat - lat_max))
    span_lon = F.greatest(F.abs(lon - lon_min), F.abs(lon - lon_max))
    top = F.greatest(F.abs(lat_min), F.abs(lat_max))
    low = F.when(lat_min * lat_max <= 0, F.lit(0.0)).otherwise(
        F.least(F.abs(lat_min), F.abs(lat_max)))
    cos_here = F.cos(F.radians(lat))
    near = _arc_km(gap_lat, gap_lon, cos_here * F.cos(F.radians(top)), radius_km)
    far = _arc_km(span_lat, span_lon, cos_here * F.cos(F.radians(low)), radius_km)
    return near, far


def _arc_km(dlat, dlon, cos_product, radius_km):
    sin_lat = F.sin(F.radians(dlat) / 2)
    sin_lon = F.sin(F.radians(dlon) / 2)
    a = F.least(F.lit(1.0), sin_lat * sin_lat + cos_product * sin_lon * sin_lon)
    return F.lit(2 * radius_km) * F.asin(F.sqrt(a))


def city_box(city: str):
    return rules.CITY_BOXES[city][1:]


def linspace(low: float, high: float, n: int, index: Column) -> Column:
    """Value number `index` of `n` evenly spaced values, ends included."""
    return F.lit(low) + index * F.lit((high - low) / (n - 1))
