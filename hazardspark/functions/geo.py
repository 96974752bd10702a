"""Distances and projections as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, MERCATOR_M, DEGREE_M = 6371000.0, 6378137.0, 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_M * F.hypot(x, F.radians(lat2 - lat1))


def point_segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a segment on the plane around the point."""
    k = F.cos(F.radians(lat))
    x1, y1, x2, y2 = (lon1 - lon) * k * DEGREE_M, (lat1 - lat) * DEGREE_M, (lon2 - lon) * k * DEGREE_M, (lat2 - lat) * DEGREE_M
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / norm))).otherwise(0.0)
    return F.hypot(x1 + t * dx, y1 + t * dy)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / MERCATOR_M)))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _columns_of(row: Column, size: float) -> Column:
    """Cells in a row of the grid: as many of at least `size` degrees, stretched by the row's cosine where it is smallest, as fit round it."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(row * size - 90), F.abs((row + 1) * size - 90)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(far)) / size)).cast("long")


def _column_at(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180) / 360 * n).cast("long")


def on_sphere(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same place with a latitude from -90 to 90: one beyond a pole lies on the opposite meridian, as distances have it."""
    turn = F.pmod(lat + 90, F.lit(360.0))
    folded = F.when(turn <= 180, turn - 90).otherwise(270 - turn)
    return F.when(F.abs(lat) <= 90, lat).otherwise(folded), F.when((F.abs(lat) <= 90) | (turn <= 180), lon).otherwise(lon + 180)


def grid_cell(lat: Column, lon: Column, size: float) -> Column:
    """(cy, cx) of a grid on the sphere: rows `size` degrees high, columns that widen with the latitude and close at 180 degrees."""
    lat, lon = on_sphere(lat, lon)
    row = F.floor((lat + 90) / size).cast("long")
    n = _columns_of(row, size)
    return F.struct(row.alias("cy"), F.pmod(_column_at(lon, n), n).alias("cx"))


def grid_cover(lat: Column, lon: Column, radius_m: float, size: float) -> Column:
    """All cells (cy, cx) of that grid which the circle around a point touches, also over a pole or 180 degrees; each once."""
    lat, lon = on_sphere(lat, lon)
    r = radius_m / (EARTH_M * math.pi / 180) * (1 + 1e-9) + 1e-9
    reach = F.sin(F.radians(F.lit(min(r, 90.0)))) / F.cos(F.radians(lat))
    wide = F.when((F.abs(lat) + r < 90) & (reach < 1), F.degrees(F.asin(reach)) + 1e-9).otherwise(F.lit(180.0))
    first, last = F.floor((lat + 90 - r) / size), F.floor((lat + 90 + r) / size)
    rows = F.sequence(F.greatest(F.lit(0), first).cast("long"), F.least(F.floor(F.lit(180.0) / size), last).cast("long"))

    def columns(row):
        n = _columns_of(row, size)
        west, east = _column_at(lon - wide, n), _column_at(lon + wide, n)
        return F.transform(F.sequence(west, F.least(east, west + n - 1)), lambda x: F.struct(row.alias("cy"), F.pmod(x, n).alias("cx")))

    return F.flatten(F.transform(rows, columns))
