"""Points, lines and map projections as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pix2world(r: Column, c: Column, g: Column) -> Column:
    """struct(x, y) of pixel (r, c) under the georeference g (xtr, xscale, xshear, ytr, yshear, yscale)."""
    return F.struct((g.xscale * c + g.xshear * r + g.xtr).alias("x"), (g.yshear * c + g.yscale * r + g.ytr).alias("y"))


def world2pix(x: Column, y: Column, g: Column) -> Column:
    """struct(c, r): the inverse of pix2world, column first."""
    det = g.xscale * g.yscale - g.xshear * g.yshear
    dx, dy = x - g.xtr, y - g.ytr
    return F.struct(((g.yscale * dx - g.xshear * dy) / det).alias("c"), ((g.xscale * dy - g.yshear * dx) / det).alias("r"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def point_along(d: Column, x0: Column, y0: Column, x1: Column, y1: Column, compat: bool = True) -> Column:
    """struct(x, y) at distance d from (x0, y0) towards (x1, y1). compat: on axis-parallel segments d is always added, whichever way the
    segment runs."""
    n = distance(x0, y0, x1, y1)
    x, y = x0 + d * (x1 - x0) / n, y0 + d * (y1 - y0) / n
    if not compat:
        return F.struct(x.alias("x"), y.alias("y"))
    flat, steep = y0 == y1, x0 == x1
    return F.struct(F.when(steep, x0).when(flat, x0 + d).otherwise(x).alias("x"), F.when(steep, y0 + d).when(flat, y0).otherwise(y).alias("y"))


def extend_start(d: float, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(x, y): the start moved back by d along the line."""
    n = distance(x0, y0, x1, y1)
    return F.struct((x0 - d * (x1 - x0) / n).alias("x"), (y0 - d * (y1 - y0) / n).alias("y"))


#: WGS84 and the transverse Mercator series to the third order.
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def lonlat_to_utm(lon: Column, lat: Column, epsg: int) -> Column:
    """struct(x, y) in metres of the zone 326zz (north) or 327zz (south)."""
    centre = math.radians((epsg % 100) * 6 - 183)
    north0 = 10_000_000.0 if epsg // 100 == 327 else 0.0
    s = 2 * math.sqrt(_N) / (1 + _N)
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - s * F.atanh(s * sin))
    dl = F.radians(lon) - centre
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_E0 + _K0 * _R * east).alias("x"), (north0 + _K0 * _R * north).alias("y"))


def utm_to_lonlat(x: Column, y: Column, epsg: int) -> Column:
    """struct(lon, lat) in degrees."""
    north0 = 10_000_000.0 if epsg // 100 == 327 else 0.0
    xi, eta = (y - north0) / (_K0 * _R), (x - _E0) / (_K0 * _R)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.lit(float((epsg % 100) * 6 - 183)) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def lonlat_to_mercator(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres of the web's spherical projection."""
    return F.struct((_A * F.radians(lon)).alias("x"), (_A * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"))


def mercator_to_lonlat(x: Column, y: Column) -> Column:
    """struct(lon, lat) in degrees."""
    return F.struct(F.degrees(x / _A).alias("lon"), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2).alias("lat"))


def _is_utm(epsg: int) -> bool:
    return epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60


def reproject(x: Column, y: Column, source: int, target: int) -> Column:
    """struct(x, y) of points in another projection; x is the longitude and y the latitude of 4326. Known are 4326, 3857 and the UTM zones 326zz and
    327zz, other codes are an error."""
    for epsg in (source, target):
        if epsg not in (4326, 3857) and not _is_utm(epsg):
            raise ValueError(f"unknown projection: {epsg}")
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    lon, lat = x, y
    if source != 4326:
        at = mercator_to_lonlat(x, y) if source == 3857 else utm_to_lonlat(x, y, source)
        lon, lat = at.lon, at.lat
    if target == 4326:
        return F.struct(lon.alias("x"), lat.alias("y"))
    return lonlat_to_mercator(lon, lat) if target == 3857 else lonlat_to_utm(lon, lat, target)
