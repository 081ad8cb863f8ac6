"""Coordinates as column expressions: slippy tiles, UTM, the affine of a raster."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: metres of a degree, of latitude or at the equator, and as the compound filter takes one of longitude.
METRES, METRES_LON = 111320.0, 105000.0

_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third order.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    return F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_lon(x: Column, zoom: Column) -> Column:
    """West edge of a tile."""
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column) -> Column:
    """North edge of a tile."""
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180.0) / 6.0).cast("int") + 1))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (false northing on the south)."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6.0 - 183.0))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + _K0 * _RADIUS * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + _K0 * _RADIUS * north


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi = (north - F.when(south, 10000000.0).otherwise(0.0)) / (_K0 * _RADIUS)
    eta = (east - 500000.0) / (_K0 * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def to_geo(px: Column, py: Column, min_x: Column, max_y: Column, res_x: Column, res_y: Column) -> tuple[Column, Column]:
    return min_x + px * res_x, max_y - py * res_y


def to_pixel(x: Column, y: Column, min_x: Column, max_y: Column, res_x: Column, res_y: Column) -> tuple[Column, Column]:
    """Column and row, truncated towards zero."""
    return ((x - min_x) / res_x).cast("int"), ((max_y - y) / res_y).cast("int")


def is_geographic(crs: Column, min_x: Column, min_y: Column) -> Column:
    named = F.upper(crs).contains("4326") | F.upper(crs).contains("WGS84")
    return named | (min_x.between(-180, 180) & min_y.between(-90, 90))
