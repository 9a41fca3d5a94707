"""Transverse Mercator for UTM zone 43N on WGS84, as column expressions.

Series of Krueger in the third flattening, to fourth order (sub-millimetre in the zone).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ellipsoid and the zone.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
CENTRAL_MERIDIAN = 75.0
SCALE = 0.9996
FALSE_EASTING = 500000.0

N = FLATTENING / (2 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRIC = 2 * math.sqrt(N) / (1 + N)

# Series coefficients, order 1 to 4.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
INVERSE = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def to_utm43n(lon: Column, lat: Column) -> Column:
    """STRUCT<x,y> in metres for a longitude and latitude in degrees."""
    sine = F.sin(F.radians(lat))
    conformal = F.sinh(F.atanh(sine) - ECCENTRIC * F.atanh(ECCENTRIC * sine))
    offset = F.radians(lon - CENTRAL_MERIDIAN)
    xi = F.atan2(conformal, F.cos(offset))
    eta = F.atanh(F.sin(offset) / F.sqrt(1 + conformal * conformal))
    x, y = eta, xi
    for j, a in enumerate(FORWARD, start=1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = SCALE * RECTIFYING_RADIUS
    return F.struct((FALSE_EASTING + k * x).alias("x"), (k * y).alias("y"))


def from_utm43n(x: Column, y: Column) -> Column:
    """STRUCT<lon,lat> in degrees for projected metres."""
    k = SCALE * RECTIFYING_RADIUS
    xi, eta = y / k, (x - FALSE_EASTING) / k
    xi0, eta0 = xi, eta
    for j, b in enumerate(INVERSE, start=1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = conformal
    for j, d in enumerate(LATITUDE, start=1):
        lat = lat + d * F.sin(2 * j * conformal)
    lon = F.lit(CENTRAL_MERIDIAN) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def project_geometry(geom: Column) -> Column:
    """Forward-project every vertex of a geometry column."""
    parts = F.transform(geom["parts"], lambda part: F.transform(part, lambda p: to_utm43n(p["x"], p["y"])))
    return F.struct(geom["type"].alias("type"), parts.alias("parts"))
