"""Geometry and kinematics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def heading(vx: Column, vy: Column) -> Column:
    return F.atan2(vy, vx)


def heading_from_degrees(degrees: Column) -> Column:
    return wrap(F.radians(degrees))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def polar(x: Column, y: Column, x0: float, y0: float) -> tuple[Column, Column]:
    return distance(x, y, F.lit(float(x0)), F.lit(float(y0))), F.atan2(y - y0, x - x0)


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def angular_velocity(vx: Column, vy: Column, ax: Column, ay: Column) -> Column:
    return (vx * ay - vy * ax) / (speed(vx, vy) + F.lit(1e-6))


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Into a frame turned by ``angle``."""
    return x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def seconds_to_frame(t: Column, step: float = 0.1) -> Column:
    """Ceil to a tenth of a second, then round half to even."""
    return F.bround(F.ceil(t * 10) / F.lit(10.0) / F.lit(step), 0).cast("int")


def feet(value: Column) -> Column:
    return value * F.lit(0.3048)


# WGS 84 and the transverse Mercator scale.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """UTM easting and northing (northern, no false northing) by the Krueger series of third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    zone = F.floor((lon + 180) / 6) + 1 if zone is None else zone
    away = F.radians(lon - (zone * 6 - 183))
    phi = F.radians(lat)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return F.lit(500000.0) + F.lit(K0 * radius) * east, F.lit(K0 * radius) * north


def utm_inverse(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude of UTM coordinates of the northern hemisphere, by the inverse series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / F.lit(K0 * radius), (east - F.lit(500000.0)) / F.lit(K0 * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        y = y - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * j))
    return F.degrees(phi), F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def enu_to_ecef(e: Column, n: Column, u: Column, lat: float, lon: float, height: float = 0.0) -> tuple[Column, Column, Column]:
    """Local east, north, up about a point (degrees) to earth-centred coordinates."""
    e2 = FLATTENING * (2 - FLATTENING)
    p, q = math.radians(lat), math.radians(lon)
    curve = A / math.sqrt(1 - e2 * math.sin(p) ** 2)
    x0, y0, z0 = (curve + height) * math.cos(p) * math.cos(q), (curve + height) * math.cos(p) * math.sin(q), (curve * (1 - e2) + height) * math.sin(p)
    x = F.lit(x0) - e * math.sin(q) - n * (math.sin(p) * math.cos(q)) + u * (math.cos(p) * math.cos(q))
    y = F.lit(y0) + e * math.cos(q) - n * (math.sin(p) * math.sin(q)) + u * (math.cos(p) * math.sin(q))
    z = F.lit(z0) + n * math.cos(p) + u * math.sin(p)
    return x, y, z


def transform4(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> tuple[Column, ...]:
    """A 4x4 homogeneous transform given as literals."""
    return tuple(x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + float(r[3]) for r in matrix[:3])
