"""Column expressions of geodesy, angles and rotations. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius of the haversine, metres a degree of latitude, WGS-84, UTM.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
UTM_SCALE, UTM_FALSE_EAST, UTM_FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


def haversine_3d(lat1: Column, lon1: Column, alt1: Column, lat2: Column, lon2: Column, alt2: Column) -> Column:
    """Metres between two positions: great-circle distance and difference of altitude."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    ground = F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.sqrt(ground * ground + (alt2 - alt1) * (alt2 - alt1))


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> list[Column]:
    """Flat-earth east, north, up in metres from an origin, as columns x, y, z."""
    east = (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0))
    return [east.alias("x"), ((lat - lat0) * METRES_PER_DEGREE).alias("y"), (alt - alt0).alias("z")]


def enu_inverse(x: Column, y: Column, lat0: Column, lon0: Column) -> list[Column]:
    """Latitude and longitude of flat-earth offsets."""
    return [(lat0 + y / METRES_PER_DEGREE).alias("latitude"), (lon0 + x / (METRES_PER_DEGREE * F.cos(F.radians(lat0)))).alias("longitude")]


def utm_zone(lon: Column) -> Column:
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm(lat: Column, lon: Column, zone: Column | None = None) -> list[Column]:
    """Easting and northing by Krüger's series to the third order (well under a millimetre within a zone)."""
    zone = utm_zone(lon) if zone is None else zone
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    sine = F.sin(F.radians(lat))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    sinh = lambda x: (F.exp(x) - F.exp(-x)) / 2
    cosh = lambda x: (F.exp(x) + F.exp(-x)) / 2
    t = sinh(atanh(sine) - e * atanh(e * sine))
    away = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(away)), atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * cosh(2 * j * eta)
    k = UTM_SCALE * radius
    return [(UTM_FALSE_EAST + k * east).alias("easting"), (F.when(lat < 0, UTM_FALSE_NORTH).otherwise(0.0) + k * north).alias("northing")]


def yaw_between(left: Column, right: Column, a: Column) -> Column:
    """left moved by the share a of the shortest arc to right; not wrapped afterwards."""
    return left + a * (F.pmod(right - left + 180, F.lit(360.0)) - 180)


def between(left: Column, right: Column, a: Column) -> Column:
    return left + a * (right - left)


def rotation_of(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rows of the rotation matrix of a quaternion, taken as it is (not normalised)."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def pose_centre(q: list[Column], t: list[Column]) -> list[Column]:
    """Camera centre of a world-to-camera pose: minus the transposed rotation times the translation."""
    r = rotation_of(*q)
    return [(-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2])).alias(c) for i, c in enumerate("xyz")]


def similarity(x: Column, y: Column, z: Column, scale: Column, rotation: Column, translation: Column) -> list[Column]:
    """scale * R p + t; rotation is array<array<double>>, translation array<double>."""
    return [(scale * (rotation[i][0] * x + rotation[i][1] * y + rotation[i][2] * z) + translation[i]).alias(c) for i, c in enumerate("xyz")]


def quantised(value: Column, top: int) -> Column:
    """A colour share cut to [0, 1] as a whole number up to top, truncating."""
    return (F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * top).cast("int")

