"""Coordinates: cyclic codes, Web-Mercator metres, cells and areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Web-Mercator sphere and mean Earth radius in metres.
MERCATOR_RADIUS = 6378137.0
EARTH_RADIUS = 6371008.8


def cyclic_coords(lon: Column, lat: Column) -> dict[str, Column]:
    turn = F.lit(2 * math.pi / 360)
    return {
        "lon_sin": F.sin(lon * turn),
        "lon_cos": F.cos(lon * turn),
        "lat_sin": F.sin(lat * turn),
        "lat_cos": F.cos(lat * turn),
    }


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = F.lit(MERCATOR_RADIUS)
    x = F.radians(lon) * r
    y = F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0))) * r
    return x, y


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = F.lit(MERCATOR_RADIUS)
    lon = F.degrees(x / r)
    lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / r)) - F.lit(math.pi / 2))
    return lon, lat


def snap(value: Column, size: float) -> Column:
    """Integer index of the size-wide interval that holds ``value``."""
    return F.floor(value / F.lit(float(size))).cast("bigint")


def cell_area(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """True area (m²) of a lon/lat rectangle on the sphere."""
    return (
        F.lit(EARTH_RADIUS**2)
        * F.radians(lon1 - lon0)
        * (F.sin(F.radians(lat1)) - F.sin(F.radians(lat0)))
    )
