"""Distances on the sphere and light travel times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, LIGHT_M_S, LIGHTNING_M = 6_371_000.0, 299_792_458.0, 15_000.0
#: Corners (longitude, latitude) of the South Atlantic anomaly's outline.
ANOMALY = ((-74.3, -45), (-88.2, -28), (-96, -13), (-92, -9), (-70, -2.5), (-45, 3), (-33, 2.1), (-15, -15), (0.8, -18.8), (18.2, -23), (31, -31), (27.3, -39), (22, -45), (-74.3, -45))


def haversine(angle: Column) -> Column:
    return F.pow(F.sin(angle / 2), 2)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points given in degrees."""
    a = haversine(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * haversine(F.radians(lon2 - lon1))
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def arrival_ns(distance_m: Column, height1_m: Column, height2_m: Column) -> Column:
    """Nanoseconds that light takes between two heights above points so far apart."""
    a, b = height1_m + EARTH_M, height2_m + EARTH_M
    return F.round(F.sqrt(a * a + b * b - 2 * a * b * F.cos(distance_m / EARTH_M)) / LIGHT_M_S * 1e9).cast("long")


def radius_degrees(km: Column) -> Column:
    return km / (EARTH_M / 1000) * (180 / math.pi)


def display_longitude(lon: Column) -> Column:
    """Longitudes of 330 degrees and more on the left of the map."""
    return F.when(lon < 330, lon).otherwise(lon - 360)


def in_polygon(lon: Column, lat: Column, corners=ANOMALY) -> Column:
    """Whether a point lies inside: it crosses an odd number of edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners[:-1], corners[1:], strict=True):
        spans = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
        if y1 != y2:
            crossings += F.when(spans & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def _label(degrees: Column, side: Column) -> Column:
    return F.concat(F.floor(F.abs(degrees)).cast("string"), F.lit("°"), side)


def longitude_label(lon: Column) -> Column:
    """Whole degrees with W or E; the meridians of 0 and 180 have no side. Longitudes may be of any turn."""
    x = F.pmod(lon + 180, F.lit(360)) - 180
    return _label(x, F.when((x == 0) | (x == -180), "").when(x < 0, "W").otherwise("E"))


def latitude_label(lat: Column) -> Column:
    return _label(lat, F.when(lat < 0, "S").when(lat > 0, "N").otherwise(""))
