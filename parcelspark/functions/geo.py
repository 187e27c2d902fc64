"""Projection WGS84 (lon, lat in degrees) -> Lambert-93 (EPSG:2154) as column expressions.

Lambert conformal conic with two standard parallels on the GRS80 ellipsoid; the constants of
the projection are computed once in Python from its defining parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: defining parameters of Lambert-93 -----------------------------------------
GRS80_A = 6378137.0
GRS80_INV_F = 298.257222101
LAT_1, LAT_2, LAT_0, LON_0 = 49.0, 44.0, 46.5, 3.0   # degrees
FALSE_EASTING, FALSE_NORTHING = 700000.0, 6600000.0
# ---------------------------------------------------------------------------------------------

_F = 1.0 / GRS80_INV_F
E = math.sqrt(2 * _F - _F * _F)


def _m(phi):
    return math.cos(phi) / math.sqrt(1 - (E * math.sin(phi)) ** 2)


def _t(phi):
    return math.tan(math.pi / 4 - phi / 2) / ((1 - E * math.sin(phi)) / (1 + E * math.sin(phi))) ** (E / 2)


_p1, _p2, _p0 = (math.radians(v) for v in (LAT_1, LAT_2, LAT_0))
N = (math.log(_m(_p1)) - math.log(_m(_p2))) / (math.log(_t(_p1)) - math.log(_t(_p2)))
F_CONST = _m(_p1) / (N * _t(_p1) ** N)
RHO_0 = GRS80_A * F_CONST * _t(_p0) ** N


def lambert93(lon, lat) -> tuple[Column, Column]:
    """(x, y) in metres for lon / lat columns in degrees."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    phi = F.radians(lat)
    esin = F.lit(E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - esin) / (1 + esin), F.lit(E / 2))
    rho = F.lit(GRS80_A * F_CONST) * F.pow(t, F.lit(N))
    theta = F.lit(N) * F.radians(lon - F.lit(LON_0))
    return (F.lit(FALSE_EASTING) + rho * F.sin(theta),
            F.lit(FALSE_NORTHING + RHO_0) - rho * F.cos(theta))


def bbox_centre_area(minx="minx", miny="miny", maxx="maxx", maxy="maxy") -> tuple[Column, Column, Column]:
    """Centre x, centre y and non-negative area of a bounding box."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return ((c(minx) + c(maxx)) / 2.0, (c(miny) + c(maxy)) / 2.0,
            F.greatest((c(maxx) - c(minx)) * (c(maxy) - c(miny)), F.lit(0.0)))
