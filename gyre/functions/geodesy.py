"""Map projections as Column expressions (forward: degrees to map units; inverse: back), after Snyder's formulas.

A projection is ``(x, y) = name(lat, lon, ...)``; rotation, scale and centre are
applied by ``forward`` and ``inverse``.  Iterated inverses are unrolled series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS, ECC = 6378.273, 0.081816153  # km; Hughes ellipsoid (fixed values)


@dataclass(frozen=True)
class MapSpec:
    """lat0 is the pole of polar maps or the centre; lat1 the true latitude; angles in degrees, radius in km."""

    lat0: float = 90.0
    lon0: float = 0.0
    lat1: float = 60.0
    lat2: float = 30.0
    rotation: float = 0.0
    scale: float = 1.0
    radius: float = RADIUS
    ecc: float = ECC
    x0: float = 0.0
    y0: float = 0.0


def rad(c: Column) -> Column:
    return F.radians(c)


def wrap_closed(angle: Column, low: float) -> Column:
    """Into [low, low + 360]: a value at the upper end stays."""
    x = F.pmod(angle - low, F.lit(360.0))
    return F.when(angle == low + 360, angle).otherwise(x + low)


def wrap(angle: Column, low: float) -> Column:
    """Into [low, low + 360)."""
    return F.pmod(angle - low, F.lit(360.0)) + low


def within(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inside map bounds; west > east means that the map lies across 180 degrees."""
    across = (lon >= west) | (lon <= east) if west > east else (lon >= west) & (lon <= east)
    return (lat >= south) & (lat <= north) & across


def dist_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.228) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _t(phi: Column, e: float) -> Column:
    es = e * F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))


def polar_stereographic(lat: Column, lon: Column, m: MapSpec) -> tuple[Column, Column]:
    """Ellipsoid, true at lat1, pole of lat0's sign."""
    sign = 1.0 if m.lat0 >= 0 else -1.0
    phi1 = math.radians(abs(m.lat1))
    es = m.ecc * math.sin(phi1)
    if abs(phi1 - math.pi / 2) < 1e-10:
        k = 2 * m.radius / math.sqrt((1 + m.ecc) ** (1 + m.ecc) * (1 - m.ecc) ** (1 - m.ecc))
    else:
        t1 = math.tan(math.pi / 4 - phi1 / 2) / ((1 - es) / (1 + es)) ** (m.ecc / 2)
        k = m.radius * math.cos(phi1) / math.sqrt(1 - es * es) / t1
    rho = F.lit(k) * _t(rad(lat * sign), m.ecc)
    lam = rad(lon - m.lon0)
    return rho * F.sin(lam), -sign * rho * F.cos(lam)


def conformal_to_geographic(chi: Column, e: float) -> Column:
    """Latitude from the conformal latitude, by the series to the eighth power of e."""
    e2 = e * e
    c = [e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280]
    out = chi
    for k, v in enumerate(c, 1):
        out = out + v * F.sin(2 * k * chi)
    return out


def polar_stereographic_inverse(x: Column, y: Column, m: MapSpec) -> tuple[Column, Column]:
    sign = 1.0 if m.lat0 >= 0 else -1.0
    phi1 = math.radians(abs(m.lat1))
    es = m.ecc * math.sin(phi1)
    if abs(phi1 - math.pi / 2) < 1e-10:
        k = 2 * m.radius / math.sqrt((1 + m.ecc) ** (1 + m.ecc) * (1 - m.ecc) ** (1 - m.ecc))
    else:
        k = m.radius * math.cos(phi1) / math.sqrt(1 - es * es) / (math.tan(math.pi / 4 - phi1 / 2) / ((1 - es) / (1 + es)) ** (m.ecc / 2))
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) / k)
    lat = sign * F.degrees(conformal_to_geographic(chi, m.ecc))
    return lat, wrap(F.degrees(F.atan2(x, -sign * y)) + m.lon0, -180.0)


def polar_stereographic_sphere(lat, lon, m: MapSpec):
    s = 1.0 if m.lat0 >= 0 else -1.0
    rho = m.radius * (1 + math.sin(math.radians(abs(m.lat1)))) * F.tan(math.pi / 4 - rad(lat * s) / 2)
    return rho * F.sin(rad(lon - m.lon0)), -s * rho * F.cos(rad(lon - m.lon0))


def azimuthal_equal_area(lat, lon, m: MapSpec):
    p, l, p0 = rad(lat), rad(lon - m.lon0), math.radians(m.lat0)
    k = m.radius * F.sqrt(2 / (1 + math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(l)))
    return k * F.cos(p) * F.sin(l), k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(l))


def azimuthal_equal_area_inverse(x, y, m: MapSpec):
    p0, rho = math.radians(m.lat0), F.sqrt(x * x + y * y)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * m.radius)))
    lat = F.when(rho == 0, F.lit(m.lat0)).otherwise(F.degrees(F.asin(F.cos(c) * math.sin(p0) + y * F.sin(c) * math.cos(p0) / rho)))
    lon = F.degrees(F.atan2(x * F.sin(c), rho * math.cos(p0) * F.cos(c) - y * math.sin(p0) * F.sin(c)))
    return lat, wrap(lon + m.lon0, -180.0)


def cylindrical_equal_area(lat, lon, m: MapSpec):
    c = math.cos(math.radians(m.lat1))
    return m.radius * c * rad(lon - m.lon0), m.radius * F.sin(rad(lat)) / c


def cylindrical_equidistant(lat, lon, m: MapSpec):
    return m.radius * math.cos(math.radians(m.lat1)) * rad(lon - m.lon0), m.radius * rad(lat)


def mercator(lat, lon, m: MapSpec):
    return m.radius * rad(lon - m.lon0), m.radius * F.log(F.tan(math.pi / 4 + rad(lat) / 2))


def mercator_inverse(x, y, m: MapSpec):
    return F.degrees(math.pi / 2 - 2 * F.atan(F.exp(-y / m.radius))), wrap(F.degrees(x / m.radius) + m.lon0, -180.0)


def orthographic(lat, lon, m: MapSpec):
    """Null on the far side."""
    p, l, p0 = rad(lat), rad(lon - m.lon0), math.radians(m.lat0)
    near = math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(l) >= 0
    return F.when(near, m.radius * F.cos(p) * F.sin(l)), F.when(near, m.radius * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(l)))


def sinusoidal(lat, lon, m: MapSpec):
    return m.radius * rad(lon - m.lon0) * F.cos(rad(lat)), m.radius * rad(lat)


def lambert_conformal(lat, lon, m: MapSpec):
    """Ellipsoid, true at lat1 and lat2."""
    e, r1, r2 = m.ecc, math.radians(m.lat1), math.radians(m.lat2)

    def mt(p):
        s = e * math.sin(p)
        return math.cos(p) / math.sqrt(1 - s * s), math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    (m1, t1), (m2, t2) = mt(r1), mt(r2)
    n = math.sin(r1) if abs(r1 - r2) < 1e-12 else (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2))
    f = m1 / (n * t1**n)
    rho0 = 0.0 if abs(m.lat0) >= 90 else m.radius * f * mt(math.radians(m.lat0))[1] ** n
    rho, theta = m.radius * f * F.pow(_t(rad(lat), e), F.lit(n)), n * rad(lon - m.lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers(lat, lon, m: MapSpec):
    """Sphere, true at lat1 and lat2."""
    r1, r2, r0 = (math.radians(v) for v in (m.lat1, m.lat2, m.lat0))
    n = (math.sin(r1) + math.sin(r2)) / 2
    c = math.cos(r1) ** 2 + 2 * n * math.sin(r1)
    rho, theta = m.radius * F.sqrt(c - 2 * n * F.sin(rad(lat))) / n, n * rad(lon - m.lon0)
    return rho * F.sin(theta), m.radius * math.sqrt(c - 2 * n * math.sin(r0)) / n - rho * F.cos(theta)


def transverse_mercator(lat, lon, m: MapSpec):
    """Sphere."""
    b = F.cos(rad(lat)) * F.sin(rad(lon - m.lon0))
    return 0.5 * m.radius * F.log((1 + b) / (1 - b)), m.radius * (F.atan2(F.tan(rad(lat)), F.cos(rad(lon - m.lon0))) - math.radians(m.lat0))


def mollweide(lat, lon, m: MapSpec, steps: int = 10):
    """Newton's steps for theta + sin(theta) = pi sin(lat) run over an array, so the expression stays small."""
    target = math.pi * F.sin(rad(lat))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), 2 * F.asin(F.lit(2.0) * rad(lat) / math.pi), lambda t, _: t - (t + F.sin(t) - target) / F.greatest(1 + F.cos(t), F.lit(1e-9)))
    half = F.when(F.abs(lat) >= 90, F.signum(lat) * math.pi / 2).otherwise(theta / 2)
    return m.radius * 2 * math.sqrt(2) / math.pi * rad(lon - m.lon0) * F.cos(half), m.radius * math.sqrt(2) * F.sin(half)


def _q(phi: Column, e: float) -> Column:
    """Snyder's q of the authalic latitude."""
    s = F.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _q_of(phi: float, e: float) -> float:
    s = math.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def authalic_to_geographic(beta: Column, e: float) -> Column:
    """Latitude from the authalic latitude, by the series to the sixth power of e."""
    e2 = e * e
    c = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    out = beta
    for k, v in enumerate(c, 1):
        out = out + v * F.sin(2 * k * beta)
    return out


def _m(phi: float, e: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _authalic(m: MapSpec) -> tuple[float, float, float, float]:
    """(q of the pole, authalic latitude of the centre, radius of the sphere of equal area, stretch that keeps the scale at the centre)."""
    qp, p0 = _q_of(math.pi / 2, m.ecc), math.radians(m.lat0)
    b0 = math.asin(max(-1.0, min(1.0, _q_of(p0, m.ecc) / qp)))
    rq = m.radius * math.sqrt(qp / 2)
    return qp, b0, rq, m.radius * _m(p0, m.ecc) / (rq * math.cos(b0))


def azimuthal_equal_area_ellipsoid(lat, lon, m: MapSpec):
    """About a pole or any other centre."""
    if abs(m.lat0) == 90:
        s = 1.0 if m.lat0 > 0 else -1.0
        rho = m.radius * F.sqrt(F.greatest(_q_of(math.pi / 2, m.ecc) - _q(rad(lat * s), m.ecc), F.lit(0.0)))
        return rho * F.sin(rad(lon - m.lon0)), -s * rho * F.cos(rad(lon - m.lon0))
    qp, b0, rq, stretch = _authalic(m)
    b, lam = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(rad(lat), m.ecc) / qp))), rad(lon - m.lon0)
    k = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(lam)))
    return k * stretch * F.cos(b) * F.sin(lam), k / stretch * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(lam))


def azimuthal_equal_area_ellipsoid_inverse(x, y, m: MapSpec):
    unit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    if abs(m.lat0) == 90:
        s, qp = (1.0 if m.lat0 > 0 else -1.0), _q_of(math.pi / 2, m.ecc)
        beta = F.asin(unit(1 - (x * x + y * y) / (m.radius**2 * qp)))
        return s * F.degrees(authalic_to_geographic(beta, m.ecc)), wrap(F.degrees(F.atan2(x, -s * y)) + m.lon0, -180.0)
    _, b0, rq, stretch = _authalic(m)
    x, y = x / stretch, y * stretch
    rho = F.hypot(x, y)
    c = 2 * F.asin(unit(rho / (2 * rq)))
    beta = F.when(rho == 0, b0).otherwise(F.asin(unit(F.cos(c) * math.sin(b0) + y * F.sin(c) * math.cos(b0) / F.greatest(rho, F.lit(1e-300)))))
    lam = F.when(rho == 0, 0.0).otherwise(F.atan2(x * F.sin(c), rho * math.cos(b0) * F.cos(c) - y * math.sin(b0) * F.sin(c)))
    return F.degrees(authalic_to_geographic(beta, m.ecc)), wrap(F.degrees(lam) + m.lon0, -180.0)


def cylindrical_equal_area_ellipsoid(lat, lon, m: MapSpec):
    k = _m(math.radians(m.lat1), m.ecc)
    return m.radius * k * rad(lon - m.lon0), m.radius * _q(rad(lat), m.ecc) / (2 * k)


def cylindrical_equal_area_ellipsoid_inverse(x, y, m: MapSpec):
    k, qp = _m(math.radians(m.lat1), m.ecc), _q_of(math.pi / 2, m.ecc)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * y * k / (m.radius * qp))))
    return F.degrees(authalic_to_geographic(beta, m.ecc)), wrap(F.degrees(x / (m.radius * k)) + m.lon0, -180.0)


def cylindrical_equal_area_inverse(x, y, m: MapSpec):
    c = math.cos(math.radians(m.lat1))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * c / m.radius)))), wrap(F.degrees(x / (m.radius * c)) + m.lon0, -180.0)


def cylindrical_equidistant_inverse(x, y, m: MapSpec):
    return F.degrees(y / m.radius), wrap(F.degrees(x / (m.radius * math.cos(math.radians(m.lat1)))) + m.lon0, -180.0)


def sinusoidal_inverse(x, y, m: MapSpec):
    lat = y / m.radius
    return F.degrees(lat), wrap(F.degrees(F.when(F.abs(F.cos(lat)) > 1e-12, x / (m.radius * F.cos(lat))).otherwise(0.0)) + m.lon0, -180.0)


def mollweide_inverse(x, y, m: MapSpec):
    t = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / (m.radius * math.sqrt(2)))))
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * t + F.sin(2 * t)) / math.pi)))
    lon = F.when(F.abs(F.cos(t)) > 1e-12, math.pi * x / (2 * m.radius * math.sqrt(2) * F.cos(t))).otherwise(0.0)
    return F.degrees(lat), wrap(F.degrees(lon) + m.lon0, -180.0)


def polar_stereographic_sphere_inverse(x, y, m: MapSpec):
    s = 1.0 if m.lat0 >= 0 else -1.0
    k = m.radius * (1 + math.sin(math.radians(abs(m.lat1))))
    return s * F.degrees(math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) / k)), wrap(F.degrees(F.atan2(x, -s * y)) + m.lon0, -180.0)


def _albers_constants(m: MapSpec) -> tuple[float, float, float]:
    r1, r2, r0 = (math.radians(v) for v in (m.lat1, m.lat2, m.lat0))
    n = (math.sin(r1) + math.sin(r2)) / 2
    c = math.cos(r1) ** 2 + 2 * n * math.sin(r1)
    return n, c, m.radius * math.sqrt(c - 2 * n * math.sin(r0)) / n


def albers_inverse(x, y, m: MapSpec):
    n, c, rho0 = _albers_constants(m)
    rho2 = x * x + (rho0 - y) * (rho0 - y)
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (c - rho2 * (n / m.radius) ** 2) / (2 * n))))
    s = math.copysign(1.0, n)
    return F.degrees(lat), wrap(F.degrees(F.atan2(s * x, s * (rho0 - y)) / n) + m.lon0, -180.0)


def _albers_ellipsoid_constants(m: MapSpec) -> tuple[float, float, float]:
    r1, r2, r0 = (math.radians(v) for v in (m.lat1, m.lat2, m.lat0))
    m1, m2, q0, q1, q2 = _m(r1, m.ecc), _m(r2, m.ecc), _q_of(r0, m.ecc), _q_of(r1, m.ecc), _q_of(r2, m.ecc)
    n = math.sin(r1) if abs(r1 - r2) < 1e-12 else (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return n, c, m.radius * math.sqrt(c - n * q0) / n


def albers_ellipsoid(lat, lon, m: MapSpec):
    n, c, rho0 = _albers_ellipsoid_constants(m)
    rho, theta = m.radius * F.sqrt(c - n * _q(rad(lat), m.ecc)) / n, n * rad(lon - m.lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_ellipsoid_inverse(x, y, m: MapSpec):
    n, c, rho0 = _albers_ellipsoid_constants(m)
    q = (c - (x * x + (rho0 - y) * (rho0 - y)) * (n / m.radius) ** 2) / n
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _q_of(math.pi / 2, m.ecc))))
    s = math.copysign(1.0, n)
    return F.degrees(authalic_to_geographic(beta, m.ecc)), wrap(F.degrees(F.atan2(s * x, s * (rho0 - y)) / n) + m.lon0, -180.0)


def lambert_conformal_inverse(x, y, m: MapSpec):
    n, f, rho0 = _lambert_constants(m)
    s = math.copysign(1.0, n)
    rho = s * F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    chi = math.pi / 2 - 2 * F.atan(F.pow(rho / (m.radius * f), F.lit(1 / n)))
    return F.degrees(conformal_to_geographic(chi, m.ecc)), wrap(F.degrees(F.atan2(s * x, s * (rho0 - y)) / n) + m.lon0, -180.0)


def _lambert_constants(m: MapSpec) -> tuple[float, float, float]:
    e, r1, r2 = m.ecc, math.radians(m.lat1), math.radians(m.lat2)

    def t(p):
        s = e * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    n = math.sin(r1) if abs(r1 - r2) < 1e-12 else (math.log(_m(r1, e)) - math.log(_m(r2, e))) / (math.log(t(r1)) - math.log(t(r2)))
    f = _m(r1, e) / (n * t(r1) ** n)
    return n, f, 0.0 if abs(m.lat0) >= 90 else m.radius * f * t(math.radians(m.lat0)) ** n


def transverse_mercator_inverse(x, y, m: MapSpec):
    d = y / m.radius + math.radians(m.lat0)
    h = x / m.radius
    return F.degrees(F.asin(F.sin(d) / F.cosh(h))), wrap(F.degrees(F.atan2(F.sinh(h), F.cos(d))) + m.lon0, -180.0)


def _arc(e2: float) -> list[float]:
    """Coefficients of the meridian arc by multiples of the latitude."""
    return [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072]


def transverse_mercator_ellipsoid(lat, lon, m: MapSpec, k0: float = 0.9996):
    """Series to the sixth power of the longitude difference."""
    e2 = m.ecc**2
    ep = e2 / (1 - e2)
    p, p0, c = rad(lat), math.radians(m.lat0), _arc(e2)
    n, t = m.radius / F.sqrt(1 - e2 * F.sin(p) * F.sin(p)), F.tan(p) * F.tan(p)
    cc, a = ep * F.cos(p) * F.cos(p), rad(wrap(lon - m.lon0, -180.0)) * F.cos(p)
    arc = m.radius * (c[0] * p + c[1] * F.sin(2 * p) + c[2] * F.sin(4 * p) + c[3] * F.sin(6 * p))
    arc0 = m.radius * (c[0] * p0 + sum(v * math.sin(2 * k * p0) for k, v in enumerate(c[1:], 1)))
    x = k0 * n * (a + (1 - t + cc) * F.pow(a, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep) * F.pow(a, F.lit(5)) / 120)
    y = k0 * (arc - arc0 + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep) * F.pow(a, F.lit(6)) / 720))
    return x, y


def transverse_mercator_ellipsoid_inverse(x, y, m: MapSpec, k0: float = 0.9996):
    e2 = m.ecc**2
    ep, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    p0, c = math.radians(m.lat0), _arc(e2)
    arc0 = m.radius * (c[0] * p0 + sum(v * math.sin(2 * k * p0) for k, v in enumerate(c[1:], 1)))
    mu = (arc0 + y / k0) / (m.radius * c[0])
    p = mu
    for k, v in enumerate((3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512), 1):
        p = p + v * F.sin(2 * k * mu)
    s2 = 1 - e2 * F.sin(p) * F.sin(p)
    n, r, t, cc = m.radius / F.sqrt(s2), m.radius * (1 - e2) / F.pow(s2, F.lit(1.5)), F.tan(p) * F.tan(p), ep * F.cos(p) * F.cos(p)
    d = x / (n * k0)
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * cc - 4 * cc * cc - 9 * ep) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * cc + 45 * t * t - 252 * ep - 3 * cc * cc) * F.pow(d, F.lit(6)) / 720)
    lon = (d - (1 + 2 * t + cc) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * cc + 28 * t - 3 * cc * cc + 8 * ep + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / F.cos(p)
    return F.degrees(lat), wrap(F.degrees(lon) + m.lon0, -180.0)


def utm(lat, lon, radius: float = 6378.137, ecc: float = 0.0818191908426215) -> tuple[Column, Column, Column]:
    """(zone, easting, northing) in units of the radius' kilometres; southern northings are moved by 10000."""
    zone = utm_zone(lon)
    x, y = transverse_mercator_ellipsoid(lat, lon - (zone * 6 - 183), MapSpec(lat0=0.0, lon0=0.0, radius=radius, ecc=ecc))
    return zone, x + 500.0, F.when(lat < 0, y + 10000.0).otherwise(y)


#: Lobes of the interrupted map: (west, east, centre) in degrees, north and south (fixed values).
LOBES_NORTH = ((-180.0, -40.0, -100.0), (-40.0, 180.0, 30.0))
LOBES_SOUTH = ((-180.0, -100.0, -160.0), (-100.0, -20.0, -60.0), (-20.0, 80.0, 20.0), (80.0, 180.0, 140.0))
SEAM = 40.736666666666665  # where both projections have one scale


def homolosine(lat, lon, m: MapSpec):
    """Interrupted: sinusoidal up to the seam, Mollweide beyond, each lobe about its own meridian."""
    l = wrap(lon - m.lon0, -180.0)

    def centre(lobes) -> Column:
        out = F.lit(lobes[-1][2])
        for west, east, mid in lobes[-2::-1]:
            out = F.when(l < east, mid).otherwise(out)
        return out

    mid = F.when(lat >= 0, centre(LOBES_NORTH)).otherwise(centre(LOBES_SOUTH))
    own = MapSpec(lon0=0.0, radius=m.radius)
    sx, sy = sinusoidal(lat, l - mid, own)
    mx, my = mollweide(lat, l - mid, own)
    shift = homolosine_shift(m.radius)
    x = F.when(F.abs(lat) <= SEAM, sx).otherwise(mx)
    y = F.when(F.abs(lat) <= SEAM, sy).otherwise(my - F.signum(lat) * shift)
    return x + m.radius * rad(mid), y


def integerized_sinusoidal(lat, lon, m: MapSpec, rows: int = 1080):
    """Sinusoidal with a whole, even number of cells in each row of latitude."""
    row = F.least(F.floor((90 - lat) / 180 * rows), F.lit(rows - 1))
    mid = F.radians(90 - (row + 0.5) * 180 / rows)
    cells = 2 * F.floor(rows * F.cos(mid) + 0.5)
    return m.radius * rad(wrap(lon - m.lon0, -180.0)) * cells / (2 * rows), m.radius * rad(lat)


def orthographic_inverse(x, y, m: MapSpec):
    """Null beyond the disc's edge."""
    rho, p0 = F.hypot(x, y), math.radians(m.lat0)
    c = F.asin(F.least(F.lit(1.0), rho / m.radius))
    lat = F.when(rho == 0, F.lit(p0)).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(c) * math.sin(p0) + y * F.sin(c) * math.cos(p0) / rho))))
    lon = F.atan2(x * F.sin(c), rho * math.cos(p0) * F.cos(c) - y * math.sin(p0) * F.sin(c))
    on = rho <= m.radius
    return F.when(on, F.degrees(lat)), F.when(on, wrap(F.degrees(lon) + m.lon0, -180.0))


def homolosine_shift(radius: float) -> float:
    """How far the outer parts are moved so that both meet at the seam."""
    t = math.radians(SEAM)
    z = t
    for _ in range(20):
        z -= (z + math.sin(z) - math.pi * math.sin(t)) / (1 + math.cos(z))
    return radius * (math.sqrt(2) * math.sin(z / 2) - t)


def homolosine_inverse(x, y, m: MapSpec):
    """Null in the gaps between lobes."""
    l = F.degrees(x / m.radius)

    def lobe(lobes, k: int) -> Column:
        out = F.lit(lobes[-1][k])
        for one in lobes[-2::-1]:
            out = F.when(l < one[1], one[k]).otherwise(out)
        return out

    west, east, mid = (F.when(y >= 0, lobe(LOBES_NORTH, k)).otherwise(lobe(LOBES_SOUTH, k)) for k in range(3))
    own = MapSpec(lon0=0.0, radius=m.radius)
    dx = x - m.radius * rad(mid)
    inner = F.abs(y) <= m.radius * math.radians(SEAM)
    lat1, lon1 = sinusoidal_inverse(dx, y, own)
    lat2, lon2 = mollweide_inverse(dx, y + F.signum(y) * homolosine_shift(m.radius), own)
    lat, lon = F.when(inner, lat1).otherwise(lat2), F.when(inner, lon1).otherwise(lon2) + mid
    on = (lon >= west - 1e-9) & (lon <= east + 1e-9)
    return F.when(on, lat), F.when(on, wrap(lon + m.lon0, -180.0))


def integerized_sinusoidal_inverse(x, y, m: MapSpec, rows: int = 1080):
    lat = F.round(F.degrees(y / m.radius), 10)  # so that latitudes between two rows go to the row that the forward map takes
    row = F.least(F.floor((90 - lat) / 180 * rows), F.lit(rows - 1))
    cells = 2 * F.floor(rows * F.cos(F.radians(90 - (row + 0.5) * 180 / rows)) + 0.5)
    return lat, F.when(cells > 0, wrap(F.degrees(x / m.radius) * (2 * rows) / cells + m.lon0, -180.0)).otherwise(F.lit(m.lon0))


def utm_inverse(zone, east, north, south, radius: float = 6378.137, ecc: float = 0.0818191908426215) -> tuple[Column, Column]:
    """(lat, lon) of a zone's easting and northing; ``south``: whether 10000 was added."""
    lat, lon = transverse_mercator_ellipsoid_inverse(east - 500.0, F.when(south, north - 10000.0).otherwise(north), MapSpec(lat0=0.0, lon0=0.0, radius=radius, ecc=ecc))
    return lat, wrap(lon + zone * 6 - 183, -180.0)


FORWARD = {
    f.__name__: f
    for f in (
        polar_stereographic, polar_stereographic_sphere, azimuthal_equal_area, azimuthal_equal_area_ellipsoid, cylindrical_equal_area, cylindrical_equal_area_ellipsoid, cylindrical_equidistant, mercator,
        mollweide, orthographic, sinusoidal, lambert_conformal, albers, albers_ellipsoid, transverse_mercator, transverse_mercator_ellipsoid, homolosine, integerized_sinusoidal,
    )
}
INVERSE = {
    f.__name__.removesuffix("_inverse"): f
    for f in (
        polar_stereographic_inverse, polar_stereographic_sphere_inverse, azimuthal_equal_area_inverse, azimuthal_equal_area_ellipsoid_inverse, cylindrical_equal_area_inverse, cylindrical_equal_area_ellipsoid_inverse,
        cylindrical_equidistant_inverse, mercator_inverse, mollweide_inverse, sinusoidal_inverse, lambert_conformal_inverse, albers_inverse, albers_ellipsoid_inverse, transverse_mercator_inverse, transverse_mercator_ellipsoid_inverse, orthographic_inverse, homolosine_inverse, integerized_sinusoidal_inverse,
    )
}


def rotate(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c + y * s, y * c - x * s


def forward(name: str, lat: Column, lon: Column, m: MapSpec) -> tuple[Column, Column]:
    """Project, rotate, scale, move to the centre."""
    x, y = rotate(*FORWARD[name](lat, lon, m), m.rotation)
    return x / m.scale - m.x0, y / m.scale - m.y0


#: Degrees below 180 within which a longitude counts as -180 (a tenth of a millimetre on the ground).
END = 1e-9


def inverse(name: str, x: Column, y: Column, m: MapSpec) -> tuple[Column, Column]:
    """Places of map coordinates, longitudes in [-180, 180); one at the end of the longitudes is at -180, on whichever side of it rounding left it."""
    lat, lon = INVERSE[name](*rotate((x + m.x0) * m.scale, (y + m.y0) * m.scale, -m.rotation), m)
    return lat, F.when(lon.between(180.0 - END, 180.0), -180.0).otherwise(lon)


def utm_zone(lon: Column) -> Column:
    return (F.floor((wrap(lon, -180.0) + 180) / 6) + 1).cast("int")


def grid_forward(x: Column, y: Column, origin: tuple[float, float], cells_per_unit: float, shape: tuple[int, int]) -> tuple[Column, Column]:
    """(column, row) of map coordinates; null beyond half a cell outside the grid."""
    r, s = origin[0] + x * cells_per_unit, origin[1] - y * cells_per_unit
    ok = (r >= -0.5) & (r < shape[1] - 0.5) & (s >= -0.5) & (s < shape[0] - 0.5)
    return F.when(ok, r), F.when(ok, s)


def east_north_to_xy(name: str, lat: Column, lon: Column, u: Column, v: Column, m: MapSpec) -> tuple[Column, Column]:
    """An east-north vector in map axes: both ends of one second's way are projected, the speed is kept; zero at the pole."""
    metres = m.radius * 1000
    lat2 = lat + F.degrees(v / metres)
    lon2 = lon + F.degrees(u / (metres * F.cos(rad(lat))))
    (x1, y1), (x2, y2) = forward(name, lat, lon, m), forward(name, lat2, lon2, m)
    dx, dy = x2 - x1, y2 - y1
    size, speed = F.sqrt(dx * dx + dy * dy), F.sqrt(u * u + v * v)
    ok = (F.abs(lat) < 90) & (size > 0)
    return F.when(ok, dx / size * speed).otherwise(0.0), F.when(ok, dy / size * speed).otherwise(0.0)


#: North of this latitude, in degrees, a wave direction says nothing (fixed value).
NO_DIRECTION = 89.5


def wave_direction_to_xy(name: str, lat: Column, lon: Column, direction: Column, m: MapSpec, coming: bool = True, way: float = 10.0) -> tuple[Column, Column]:
    """The unit vector in map axes of where waves go, from their direction in degrees from north: where they come from (``coming``) or go to.

    Both ends of a way of some metres on the ellipsoid are projected; zero where there is no direction, or near the pole.
    """
    sign, metres = -1.0 if coming else 1.0, m.radius * 1000
    east, north = way * sign * F.sin(rad(direction)), way * sign * F.cos(rad(direction))
    across = metres * F.cos(rad(lat))
    along = F.hypot(metres * F.sin(rad(lat)), metres * math.sqrt(1 - m.ecc**2) * F.cos(rad(lat)))
    ok = direction.isNotNull() & ~F.isnan(direction.cast("double")) & (lat <= NO_DIRECTION)
    (x1, y1), (x2, y2) = forward(name, lat, lon, m), forward(name, lat + F.degrees(north / along), lon + F.degrees(east / F.when(ok, across)), m)
    dx, dy = x2 - x1, y2 - y1
    size = F.hypot(dx, dy)
    ok = ok & (size > 0)
    return F.when(ok, dx / size).otherwise(0.0), F.when(ok, dy / size).otherwise(0.0)


def from_cartesian(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(lat, lon) of places in space, whatever their distance from the middle; longitudes from 0 to 360."""
    return F.degrees(F.asin(z / F.sqrt(x * x + y * y + z * z))), wrap(F.degrees(F.atan2(y, x)), 0.0)


def to_data_axes(name: str, x: Column, y: Column, m: MapSpec, cut: float | None = None, turn: float = 0.0) -> tuple[Column, Column]:
    """Map coordinates as a dataset has them: (lon, lat) with longitudes from its branch cut on, or turned by degrees into the axes of its own map."""
    if cut is None:
        return rotate(x, y, turn)
    lat, lon = inverse(name, x, y, m)
    return wrap(lon, cut), lat
