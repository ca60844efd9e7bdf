"""Places on Earth and in the sky, and calibration curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude and longitude (radians) and height (m) of geocentric metres, by one step of Bowring's formula."""
    a, b = WGS84_A, WGS84_A * (1 - WGS84_F)
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(t), F.lit(3)), p - e2 * a * F.pow(F.cos(t), F.lit(3)))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), F.lit(2)))
    return lat, F.atan2(y, x), p / F.cos(lat) - n


def sidereal(jd: Column, lon: Column) -> Column:
    """Local mean sidereal time in radians, by the IAU 1982 polynomial."""
    d = jd - 2451545.0
    t = d / 36525.0
    degrees = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    return F.radians(F.pmod(degrees, F.lit(360.0))) + lon


def elevation(x: Column, y: Column, z: Column, ra: Column, dec: Column, jd: Column) -> Column:
    """A source's elevation in radians; ra and dec in radians."""
    lat, lon, _ = geodetic(x, y, z)
    h = sidereal(jd, lon) - ra
    h = F.atan2(F.sin(h), F.cos(h))
    s = F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(h)
    return F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)))


def elevation_gain(poly: Column, el: Column) -> Column:
    """The polynomial (lowest power first) at an elevation in degrees; 1 without coefficients."""
    return F.when(F.size(poly) == 0, 1.0).otherwise(F.aggregate(F.reverse(poly), F.lit(0.0), lambda acc, c: acc * el + c))


def log_ratio_weight(v1: Column, w1: Column, v0: Column, w0: Column) -> Column:
    """The weight of ln(v1 / v0) from squared moduli and weights; 0 where either says nothing."""
    p1, p0 = v1 * w1, v0 * w0
    return F.when((p1 > 0) & (p0 > 0), 1 / (1 / p1 + 1 / p0)).otherwise(0.0)
