"""Great-circle and planar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def on_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """A place as a point of the unit sphere."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord(km: float) -> float:
    """The straight distance, on the unit sphere, of places ``km`` apart along a great circle."""
    return 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def covered(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a closed ring covers a point: crossings are odd, or the point lies on an edge."""
    crossings, border = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        a, b, c, d = (F.lit(float(v)) for v in (x1, y1, x2, y2))
        if y1 != y2:
            straddles = (b > y) != (d > y)
            crossings = crossings + F.when(straddles & (x < (c - a) * (y - b) / (d - b) + a), 1).otherwise(0)
        inside_box = x.between(F.least(a, c), F.greatest(a, c)) & y.between(F.least(b, d), F.greatest(b, d))
        border = border | (((c - a) * (y - b) - (d - b) * (x - a) == 0) & inside_box)
    return (crossings % 2 == 1) | border


def window_cells(metres: float, resolution: float) -> tuple[int, bool]:
    """Side of a square window in cells: odd, at least 3, and whether that minimum was applied."""
    side = 2 * math.floor((metres / resolution - 1) / 2 + 0.5) + 1
    return max(3, side), side < 3


def radius_cells(metres: float, resolution: float) -> int:
    return max(1, math.floor(metres / resolution + 0.5))
