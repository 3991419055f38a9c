"""Map projections as column expressions, and the .prj texts (WKT) that name them.

Ellipsoidal Albers, Lambert conformal (one or two parallels), transverse Mercator and Mercator, both ways; geographic
coordinates pass. Coordinates stay on the file's datum: no shift between datums is made.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Crs:
    """A projection by name, its parameters (degrees and map units), the ellipsoid, and metres (or degrees) a unit."""

    kind: str
    a: float = 6378137.0
    f: float = 1 / 298.257223563
    unit: float = 1.0
    params: dict[str, float] = field(default_factory=dict)

    def get(self, *names: str, default: float = 0.0) -> float:
        return next((self.params[n] for n in names if n in self.params), default)


def _parsed(text: str) -> list:
    """A WKT text as nested lists: [keyword, values and lists ...]."""
    tokens = re.findall(r'"[^"]*"|[\[\](),]|[^\s\[\](),"]+', text)
    stack: list[list] = [[]]
    for t in tokens:
        if t in "[(":
            stack.append([stack[-1].pop()])
        elif t in "])":
            done = stack.pop()
            stack[-1].append(done)
        elif t != ",":
            stack[-1].append(t.strip('"'))
    return stack[0][0]


def _child(node: list, name: str) -> list | None:
    return next((x for x in node if isinstance(x, list) and x[0].upper() == name), None)


def from_wkt(text: str) -> Crs:
    """The projection of a .prj text; one that isn't known is an error."""
    root = _parsed(text)
    geographic = root if root[0].upper() == "GEOGCS" else _child(root, "GEOGCS")
    if geographic is None:
        raise ValueError("neither projected nor geographic: " + text[:80])
    _, _, a, flat = _child(_child(geographic, "DATUM"), "SPHEROID")[:4]
    a, f = float(a), 0.0 if float(flat) == 0 else 1 / float(flat)
    unit = float((_child(root, "UNIT") or ["", "", 1.0])[2])
    if root is geographic:
        return Crs("geographic", a, f, math.degrees(unit))
    name = _child(root, "PROJECTION")[1].lower()
    params = {x[1].lower(): float(x[2]) for x in root if isinstance(x, list) and x[0].upper() == "PARAMETER"}
    kinds = [("albers", "albers"), ("lambert_conformal", "lambert"), ("transverse_mercator", "transverse"), ("mercator", "mercator")]
    kind = next((k for n, k in kinds if n in name), None)
    if kind is None:
        raise ValueError(f"unknown projection {name}")
    return Crs(kind, a, 0.0 if "auxiliary_sphere" in name or "popular" in name else f, unit, params)


class _Conic:
    """Constants of a projection, from its parameters; angles in radians."""

    def __init__(self, c: Crs) -> None:
        rad = lambda *n, default=0.0: math.radians(c.get(*n, default=default))
        self.a, self.e2 = c.a, c.f * (2 - c.f)
        self.e = math.sqrt(self.e2)
        self.lon0 = rad("central_meridian", "longitude_of_center", "longitude_of_origin")
        self.lat0 = rad("latitude_of_origin", "latitude_of_center")
        self.p1 = rad("standard_parallel_1", default=math.degrees(self.lat0))
        self.p2 = rad("standard_parallel_2", default=math.degrees(self.p1))
        self.k0 = c.get("scale_factor", default=1.0)
        self.east, self.north = c.get("false_easting") * c.unit, c.get("false_northing") * c.unit

    def m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - self.e2 * math.sin(phi) ** 2)

    def q(self, s):
        """Of the sine of a latitude (a number or a column): the authalic measure of Albers."""
        if self.e == 0:
            return 2 * s
        log = math.log if isinstance(s, float) else F.log
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def t(self, phi: float) -> float:
        s = self.e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def t_of(self, phi: Column) -> Column:
        s = self.e * F.sin(phi)
        return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))

    def latitude_of(self, t: Column) -> Column:
        """The latitude of an isometric measure, by repetition."""
        start = math.pi / 2 - 2 * F.atan(t)
        if self.e == 0:
            return start

        def step(phi: Column, _: Column) -> Column:
            s = self.e * F.sin(phi)
            return math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.e / 2)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)


def _albers(k: _Conic) -> tuple[float, float, float]:
    q1, q2 = k.q(math.sin(k.p1)), k.q(math.sin(k.p2))
    n = math.sin(k.p1) if abs(k.p1 - k.p2) < 1e-12 else (k.m(k.p1) ** 2 - k.m(k.p2) ** 2) / (q2 - q1)
    c = k.m(k.p1) ** 2 + n * q1
    return n, c, k.a * math.sqrt(c - n * k.q(math.sin(k.lat0))) / n


def _lambert(k: _Conic) -> tuple[float, float, float]:
    n = math.sin(k.p1) if abs(k.p1 - k.p2) < 1e-12 else math.log(k.m(k.p1) / k.m(k.p2)) / math.log(k.t(k.p1) / k.t(k.p2))
    f = k.k0 * k.m(k.p1) / (n * k.t(k.p1) ** n)
    return n, f, k.a * f * k.t(k.lat0) ** n


def _kruger(c: Crs) -> tuple[float, float, list[float], list[float], list[float]]:
    """Radius and series of the transverse Mercator projection to the fourth power of the third flattening."""
    n = c.f / (2 - c.f)
    radius = c.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4]
    return n, radius, alpha, beta, delta


def _origin(c: Crs, k: _Conic) -> float:
    """The northing of the latitude of origin on the central meridian, in radii."""
    n, _, alpha, _, _ = _kruger(c)
    g = 2 * math.sqrt(n) / (1 + n)
    s = math.sin(k.lat0)
    xi = math.atan(math.sinh(math.atanh(s) - g * math.atanh(g * s)))
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha))


def _wrapped(lon: Column) -> Column:
    return lon - 2 * math.pi * F.floor((lon + math.pi) / (2 * math.pi))


def project(lon: Column, lat: Column, c: Crs) -> tuple[Column, Column]:
    """(x, y) in the map's units of places in degrees."""
    if c.kind == "geographic":
        return lon / c.unit, lat / c.unit
    k, phi = _Conic(c), F.radians(lat)
    lam = _wrapped(F.radians(lon) - k.lon0)
    if c.kind in ("albers", "lambert"):
        n, f, rho0 = _albers(k) if c.kind == "albers" else _lambert(k)
        rho = k.a * F.sqrt(f - n * k.q(F.sin(phi))) / n if c.kind == "albers" else k.a * f * F.pow(k.t_of(phi), F.lit(n))
        x, y = rho * F.sin(n * lam), rho0 - rho * F.cos(n * lam)
    elif c.kind == "mercator":
        scale = k.a * (k.m(k.p1) if "standard_parallel_1" in c.params else k.k0)
        x, y = scale * lam, -scale * F.log(k.t_of(phi))
    else:
        n, radius, alpha, _, _ = _kruger(c)
        g = 2 * math.sqrt(n) / (1 + n)
        t = F.sinh(F.atanh(F.sin(phi)) - g * F.atanh(g * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x = k.k0 * radius * (eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha)))
        y = k.k0 * radius * (xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha)) - _origin(c, k))
    return (x + k.east) / c.unit, (y + k.north) / c.unit


def unproject(x: Column, y: Column, c: Crs) -> tuple[Column, Column]:
    """(lon, lat) in degrees of places in the map's units."""
    if c.kind == "geographic":
        return x * c.unit, y * c.unit
    k = _Conic(c)
    x, y = x * c.unit - k.east, y * c.unit - k.north
    if c.kind in ("albers", "lambert"):
        n, f, rho0 = _albers(k) if c.kind == "albers" else _lambert(k)
        sign = math.copysign(1.0, n)
        rho = sign * F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        lam = F.atan2(sign * x, sign * (rho0 - y)) / n
        if c.kind == "lambert":
            phi = k.latitude_of(F.pow(rho / (k.a * f), F.lit(1 / n)))
        else:
            q = (f - (rho * n / k.a) * (rho * n / k.a)) / n

            def step(p: Column, _: Column) -> Column:
                s = F.sin(p)
                w = 1 - k.e2 * s * s
                return p + w * w / (2 * F.cos(p)) * (q - k.q(s)) / (1 - k.e2)

            phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 2))), step)
    elif c.kind == "mercator":
        scale = k.a * (k.m(k.p1) if "standard_parallel_1" in c.params else k.k0)
        lam, phi = x / scale, k.latitude_of(F.exp(-y / scale))
    else:
        _, radius, _, beta, delta = _kruger(c)
        xi, eta = y / (k.k0 * radius) + _origin(c, k), x / (k.k0 * radius)
        xi1 = xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta))
        eta1 = eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta))
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        phi = chi + sum(d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta))
        lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(_wrapped(lam + k.lon0)), F.degrees(phi)
