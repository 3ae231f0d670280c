"""Projection and coordinate expressions; constants fold before the plan is built."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the projection
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257223563
LATITUDE_OF_ORIGIN, CENTRAL_LONGITUDE = 38.0, 126.0
STANDARD_PARALLELS = (30.0, 60.0)
COORDINATE_SCALE_KM = 100.0


def lcc_constants() -> dict[str, float]:
    """Cone, radius factor and origin radius of the two-parallel conformal conic."""
    f = 1.0 / INVERSE_FLATTENING
    ecc = math.sqrt(f * (2.0 - f))

    def m(phi):
        return math.cos(phi) / math.sqrt(1.0 - (ecc * math.sin(phi)) ** 2)

    def t(phi):
        s = ecc * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) * ((1 + s) / (1 - s)) ** (ecc / 2)

    a, b = (math.radians(p) for p in STANDARD_PARALLELS)
    cone = math.log(m(a) / m(b)) / math.log(t(a) / t(b))
    scale = SEMI_MAJOR * m(a) / (cone * t(a) ** cone)
    return {"ecc": ecc, "cone": cone, "scale": scale, "origin": scale * t(math.radians(LATITUDE_OF_ORIGIN)) ** cone}


def project_lcc(lat: Column, lon: Column) -> tuple[Column, Column]:
    """PR27: metres east and north."""
    k = lcc_constants()
    phi = F.radians(lat)
    s = F.lit(k["ecc"]) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(k["ecc"] / 2))
    radius = F.lit(k["scale"]) * F.pow(t, F.lit(k["cone"]))
    theta = F.lit(k["cone"]) * F.radians(lon - CENTRAL_LONGITUDE)
    return radius * F.sin(theta), F.lit(k["origin"]) - radius * F.cos(theta)


def shared_coord(metres: Column, centre_metres: Column) -> Column:
    """PR28: offset from the grid centre in units of 100 km."""
    return (metres - centre_metres) / (1000.0 * COORDINATE_SCALE_KM)
