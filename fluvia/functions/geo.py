"""Spherical geometry as column expressions. Longitudes and latitudes are degrees, lengths metres.

Everything stays in built-in functions, so that it is part of whole-stage code generation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The radius of distances and areas, and that of Cartesian coordinates.
RADIUS, RADIUS_XYZ = 6378137.0, 6371000.0


def _l(x: float) -> Column:
    return F.lit(float(x))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return _l(2 * RADIUS) * F.asin(F.sqrt(F.least(a, _l(1))))


def unit_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return tuple(_l(RADIUS_XYZ) * c for c in unit_xyz(lon, lat))


def to_lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """The direction of a vector of any length above 0."""
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def midpoint(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    a, b = unit_xyz(lon1, lat1), unit_xyz(lon2, lat2)
    return to_lonlat(*[p + q for p, q in zip(a, b, strict=True)])


def angle3(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lon3: Column, lat3: Column) -> Column:
    """Degrees at the middle point between the chords to the other two; null where a chord has no length."""
    a, o, b = unit_xyz(lon1, lat1), unit_xyz(lon2, lat2), unit_xyz(lon3, lat3)
    u, v = [p - q for p, q in zip(a, o, strict=True)], [p - q for p, q in zip(b, o, strict=True)]
    dot = sum(p * q for p, q in zip(u, v, strict=True))
    norm = F.sqrt(sum(p * p for p in u)) * F.sqrt(sum(p * p for p in v))
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(_l(-1), F.least(_l(1), dot / norm)))))


def fold_longitude(lon: Column) -> Column:
    """From [0, 360) to (-180, 180]; values of [-180, 0) stay."""
    return lon - (lon / 180).cast("int") * 360


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    east, north = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, _l(360))


def direct_point(lon: Column, lat: Column, azimuth: Column, distance: Column) -> tuple[Column, Column]:
    """Where one gets by going ``distance`` on the great circle of initial ``azimuth``, on the sphere of RADIUS."""
    a, t, s = F.radians(lat), F.radians(azimuth), distance / RADIUS
    lat2 = F.asin(F.sin(a) * F.cos(s) + F.cos(a) * F.sin(s) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(s) * F.cos(a), F.cos(s) - F.sin(a) * F.sin(lat2))
    return F.pmod(F.degrees(lon2) + 540, _l(360)) - 180, F.degrees(lat2)


def point_edge_distance(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """From a point to an edge: to the great circle where the foot lies between the ends, else to the nearer end."""
    d1, d2 = haversine(lon1, lat1, lon, lat), haversine(lon2, lat2, lon, lat)
    length = haversine(lon1, lat1, lon2, lat2)
    cross = F.abs(F.asin(F.sin(d1 / RADIUS) * F.sin(F.radians(bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2)))) * RADIUS)
    first = F.cos(F.radians(bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2))) > 0
    second = F.cos(F.radians(bearing(lon2, lat2, lon, lat) - bearing(lon2, lat2, lon1, lat1))) > 0
    return F.when(length == 0, d1).when(first & second, cross).otherwise(F.least(d1, d2))


def point_on_edge(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """1 where the point lies strictly inside the edge: nearly straight (178 degrees) and a detour below one metre."""
    d1, d2 = haversine(lon1, lat1, lon, lat), haversine(lon2, lat2, lon, lat)
    on = (angle3(lon1, lat1, lon, lat, lon2, lat2) > 178) & (d1 + d2 - haversine(lon1, lat1, lon2, lat2) < 1.0) & (d1 > 0) & (d2 > 0)
    return F.coalesce(on, F.lit(False)).cast("int")


def ring_area(ring: Column) -> Column:
    """Spherical area of an array of (lon, lat) structs, closed or open, by the trapezoids of its edges in sine of latitude."""
    n = F.size(ring)

    def term(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.pmod(i + 1, n) + 1)
        return F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"])))

    return F.abs(F.aggregate(F.transform(ring, term), _l(0), lambda a, x: a + x)) * (RADIUS * RADIUS / 2)


def hexagon_edge(area: Column) -> Column:
    return F.sqrt(2 * area / (3 * math.sqrt(3)))


def metre_to_degree(metres: Column, lat: Column) -> Column:
    return F.degrees(metres / (RADIUS * F.cos(F.radians(lat))))


def potentiometric(bed: Column, ice: Column, ice_density: float = 917.0, missing: float = -9999.0) -> Column:
    return F.when((bed == missing) | (ice == missing), _l(missing)).otherwise(bed + ice * (ice_density / 1000.0))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Crossing number of the ring's edges to the east of the point; points on the lower or left boundary are inside."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.pmod(i + 1, n) + 1)
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        return F.when(spans & (lon < p["lon"] + (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"])), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def vertex_key(lon: Column, lat: Column) -> Column:
    """A key of equality up to 1e-9 degrees; the exact coordinates stay beside it."""
    return F.struct(F.round(lon * 1e9).cast("long").alias("x"), F.round(lat * 1e9).cast("long").alias("y"))


def plane_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lon3: Column, lat3: Column) -> Column:
    """How far the middle point lies from the plane through all three on the unit sphere; null where they span no plane.

    It lies on that plane, so that this is 0 but for rounding.
    """
    a, o, b = unit_xyz(lon1, lat1), unit_xyz(lon2, lat2), unit_xyz(lon3, lat3)
    u, v = [p - q for p, q in zip(o, a, strict=True)], [p - q for p, q in zip(b, a, strict=True)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(sum(x * x for x in n))
    return F.when(size > 0, F.abs(sum(x * p for x, p in zip(n, u, strict=True))) / size)


def same_vertex(lon1: Column, lat1: Column, lon2: Column, lat2: Column, tolerance: float = 1e-9) -> Column:
    """Whether both coordinates differ by less than ``tolerance`` degrees."""
    return (F.abs(lon1 - lon2) < tolerance) & (F.abs(lat1 - lat2) < tolerance)


def tolerance_keys(lon: Column, lat: Column, tolerance: float = 1e-9) -> tuple[Column, Column]:
    """(key, keys): a point's square of ``tolerance`` degrees, and the nine squares in which points equal to it may lie.

    Points on either side of a border are joined by key and keys, with ``same_vertex`` after.
    """
    x, y = F.floor(lon / tolerance), F.floor(lat / tolerance)
    square = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    return square(0, 0), F.array(*[square(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def sum_vector(points: Column) -> tuple[Column, Column]:
    """(lon, lat) of the normalised sum of the n-vectors of an array of (lon, lat) structs."""
    axis = lambda i: F.aggregate(points, _l(0), lambda s, p: s + unit_xyz(p["lon"], p["lat"])[i])
    return to_lonlat(axis(0), axis(1), axis(2))


def triangle_area(ring: Column) -> Column:
    """Area of a spherical triangle, an array of three (lon, lat) structs, by its spherical excess."""
    a, b, c = [unit_xyz(F.get(ring, i)["lon"], F.get(ring, i)["lat"]) for i in range(3)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    triple = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return F.abs(2 * F.atan2(triple, 1 + dot(a, b) + dot(b, c) + dot(a, c))) * (RADIUS * RADIUS)


# The axes of the WGS 84 ellipsoid.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def _let(values: dict[str, Column], then) -> Column:
    """``then`` of a struct of values that are computed once, however often it uses them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


def _geodesic(lon: Column, lat: Column, azimuth: Column, distance: Column) -> Column:
    """``geodesic_point`` as a struct (lon, lat)."""
    f, b = FLATTENING, MAJOR * (1 - FLATTENING)

    def aimed(g: Column) -> Column:
        sin_alpha = F.cos(g["u"]) * F.sin(g["a"])
        return _let({"g": g, "s1": F.atan2(F.tan(g["u"]), F.cos(g["a"])), "sa": sin_alpha, "c2": 1 - sin_alpha * sin_alpha}, scaled)

    def scaled(h: Column) -> Column:
        uu = h["c2"] * ((MAJOR * MAJOR - b * b) / (b * b))
        big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        return _let({"h": h, "b": big_b, "s": h["g"]["d"] / (b * big_a)}, walked)

    def walked(k: Column) -> Column:
        def step(v: Column, _: Column) -> Column:
            c, s, sm = F.cos(2 * k["h"]["s1"] + v), F.sin(v), F.cos(v)
            return k["s"] + k["b"] * s * (c + k["b"] / 4 * (sm * (2 * c * c - 1) - k["b"] / 6 * c * (4 * s * s - 3) * (4 * c * c - 3)))

        return _let({"k": k, "v": F.aggregate(F.sequence(F.lit(1), F.lit(8)), k["s"], step)}, placed)

    def placed(x: Column) -> Column:
        h, v = x["k"]["h"], x["v"]
        u, alpha, sa = h["g"]["u"], h["g"]["a"], h["sa"]
        flat = F.sin(u) * F.sin(v) - F.cos(u) * F.cos(v) * F.cos(alpha)
        lat2 = F.atan2(F.sin(u) * F.cos(v) + F.cos(u) * F.sin(v) * F.cos(alpha), (1 - f) * F.sqrt(sa * sa + flat * flat))
        turn = F.atan2(F.sin(v) * F.sin(alpha), F.cos(u) * F.cos(v) - F.sin(u) * F.sin(v) * F.cos(alpha))
        c, cm = h["c2"] * (f / 16) * (4 + f * (4 - 3 * h["c2"])), F.cos(2 * h["s1"] + v)
        lon2 = turn - (1 - c) * f * sa * (v + c * F.sin(v) * (cm + c * F.cos(v) * (2 * cm * cm - 1)))
        return F.struct((F.pmod(h["g"]["lon"] + F.degrees(lon2) + 180, _l(360)) - 180).alias("lon"), F.degrees(lat2).alias("lat"))

    return _let({"lon": lon, "a": F.radians(azimuth), "u": F.atan((1 - f) * F.tan(F.radians(lat))), "d": distance}, aimed)


def geodesic_point(lon: Column, lat: Column, azimuth: Column, distance: Column) -> tuple[Column, Column]:
    """Where one gets by going ``distance`` on the geodesic of initial ``azimuth`` on the WGS 84 ellipsoid, by Vincenty's direct formula."""
    p = _geodesic(lon, lat, azimuth, distance)
    return p["lon"], p["lat"]


def circle(lon: Column, lat: Column, metres: Column, points: int = 36) -> Column:
    """``points`` places at ``metres`` round a place, from the north eastwards, each 360 div ``points`` degrees on."""

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: _geodesic(lon, lat, i * float(360 // points), metres))


def circle_places(lon: np.ndarray, lat: np.ndarray, metres: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """``circle`` of arrays of places in numpy, a row of longitudes and of latitudes a place: for what is worked on in Python anyway."""
    f, b = FLATTENING, MAJOR * (1 - FLATTENING)
    a = np.radians(np.arange(points) * float(360 // points))[None, :]
    u = np.arctan((1 - f) * np.tan(np.radians(lat)))[:, None]
    sin_a, cos_a, sin_u, cos_u = np.sin(a), np.cos(a), np.sin(u), np.cos(u)
    s1, sa = np.arctan2(np.tan(u), cos_a), cos_u * sin_a
    c2 = 1 - sa * sa
    uu = c2 * ((MAJOR * MAJOR - b * b) / (b * b))
    big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    start = metres / (b * big_a)
    v = start
    for _ in range(8):
        c, s, sm = np.cos(2 * s1 + v), np.sin(v), np.cos(v)
        v = start + big_b * s * (c + big_b / 4 * (sm * (2 * c * c - 1) - big_b / 6 * c * (4 * s * s - 3) * (4 * c * c - 3)))
    s, sm = np.sin(v), np.cos(v)
    flat = sin_u * s - cos_u * sm * cos_a
    lat2 = np.arctan2(sin_u * sm + cos_u * s * cos_a, (1 - f) * np.sqrt(sa * sa + flat * flat))
    turn = np.arctan2(s * sin_a, cos_u * sm - sin_u * s * cos_a)
    c, cm = c2 * (f / 16) * (4 + f * (4 - 3 * c2)), np.cos(2 * s1 + v)
    lon2 = turn - (1 - c) * f * sa * (v + c * s * (cm + c * sm * (2 * cm * cm - 1)))
    return np.mod(lon[:, None] + np.degrees(lon2) + 180, 360) - 180, np.degrees(lat2)


def blend(near: Column, far: Column, distance: Column, centre: float, width: float) -> Column:
    """``near`` passing into ``far`` around a distance of ``centre``, over about ``width``."""
    beta = 0.5 + 0.5 * F.tanh((distance - centre) * (math.pi / width))
    return beta * far + (1 - beta) * near


def on_ellipsoid(x: Column, y: Column, z: Column, radii: tuple[float, float, float]) -> tuple[Column, Column]:
    """(lon, lat) of a vector of any length carried out to the ellipsoid of ``radii``."""
    ax, ay, az = x / radii[0], y / radii[1], z / radii[2]
    size = F.sqrt(ax * ax + ay * ay + az * az)
    return F.degrees(F.atan2(ay, ax)), F.degrees(F.asin(az / size))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    return F.radians(lon) * RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def without_flat_corners(ring: Column, degrees: float = 175.0) -> Column:
    """A ring without the corners whose angle is above ``degrees``; the sides' ends are compared round the ring."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, F.pmod(i, n) + 1)
    return F.filter(ring, lambda p, i: ~F.coalesce(angle3(at(i - 1)["lon"], at(i - 1)["lat"], p["lon"], p["lat"], at(i + 1)["lon"], at(i + 1)["lat"]) > degrees, F.lit(False)))


def ring_position(lon: Column, lat: Column, ring: Column) -> Column:
    """1 where a point lies inside a ring of any shape, 0 on its border, -1 outside. On the border is within 5e-14 of a side's length."""
    n = F.size(ring)

    def touches(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.pmod(i + 1, n) + 1)
        dx, dy, px, py = q["lon"] - p["lon"], q["lat"] - p["lat"], lon - p["lon"], lat - p["lat"]
        size, along = dx * dx + dy * dy, px * dx + py * dy
        return (F.abs(px * dy - py * dx) <= size * 5e-14) & (along >= 0) & (along <= size)

    return F.when(F.exists(F.transform(ring, touches), lambda x: x), 0).when(point_in_ring(lon, lat, ring), 1).otherwise(-1)


def side_at(lon: Column, lat: Column, ring: Column) -> Column:
    """The first side of a ring (from 0) on which a point lies, -1 if on none: within 1e-12 degrees of the side's line and box."""
    n = F.size(ring)

    def on(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.pmod(i + 1, n) + 1)
        dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
        off = F.abs((lon - p["lon"]) * dy - (lat - p["lat"]) * dx) <= 1e-12 * F.sqrt(dx * dx + dy * dy)
        return off & lon.between(F.least(p["lon"], q["lon"]) - 1e-12, F.greatest(p["lon"], q["lon"]) + 1e-12) & lat.between(F.least(p["lat"], q["lat"]) - 1e-12, F.greatest(p["lat"], q["lat"]) + 1e-12)

    return (F.coalesce(F.array_position(F.transform(ring, on), True), F.lit(0)) - 1).cast("int")
