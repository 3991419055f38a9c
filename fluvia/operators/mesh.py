"""Structured meshes as arithmetic over ``spark.range``: one row a cell, no driver loop, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


def _grid(spark: SparkSession, nrow: int, ncol: int) -> DataFrame:
    d = spark.range(nrow * ncol).withColumnRenamed("id", "__i")
    return d.select((F.col("__i") + 1).alias("cell_id"), (F.floor(F.col("__i") / ncol) + 1).alias("row"), (F.col("__i") % ncol + 1).alias("col"))


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for x, y in points])


def _neighbors(offsets: Column, nrow: int, ncol: int) -> Column:
    """Cell ids of (dr, dc) structs that lie on the grid, in ascending order."""
    row, col = F.col("row"), F.col("col")
    inside = F.filter(offsets, lambda o: (row + o["r"]).between(1, nrow) & (col + o["c"]).between(1, ncol))
    return F.array_sort(F.transform(inside, lambda o: ((row + o["r"] - 1) * ncol + col + o["c"]).cast("long")))


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in pairs])


AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def latlon(spark: SparkSession, lon0: float, lat0: float, step: float, nrow: int, ncol: int) -> DataFrame:
    """Cells of ``step`` degrees numbered by rows from the lower left, with the eight neighbours that exist."""
    x, y = F.lit(lon0) + (F.col("col") - 1) * F.lit(step), F.lit(lat0) + (F.col("row") - 1) * F.lit(step)
    d = _grid(spark, nrow, ncol).withColumn("ring", _ring((x, y), (x + step, y), (x + step, y + step), (x, y + step)))
    return d.withColumn("lon", x + step / 2).withColumn("lat", y + step / 2).withColumn("neighbors", _neighbors(_offsets(AROUND), nrow, ncol))


def square(spark: SparkSession, x0: float, y0: float, size: float, nrow: int, ncol: int) -> DataFrame:
    """The same layout in projected metres."""
    return latlon(spark, x0, y0, size, nrow, ncol).withColumnsRenamed({"lon": "x", "lat": "y"})


def hexagon(spark: SparkSession, x0: float, y0: float, resolution: float, nrow: int, ncol: int) -> DataFrame:
    """Pointy hexagons of the area of a square of ``resolution``; odd rows start at ``x0``, even rows half a cell later."""
    edge = math.sqrt(2 * resolution * resolution / (3 * math.sqrt(3)))
    wide = edge * math.sqrt(3)
    even = F.col("row") % 2 == 0
    x = F.lit(x0) + (F.col("col") - 1) * F.lit(wide) + F.when(even, wide / 2).otherwise(0.0)
    y = F.lit(y0) + (F.col("row") - 1) * F.lit(1.5 * edge)
    corners = [(0.0, edge), (wide / 2, edge / 2), (wide / 2, -edge / 2), (0.0, -edge), (-wide / 2, -edge / 2), (-wide / 2, edge / 2)]
    d = _grid(spark, nrow, ncol).withColumn("ring", _ring(*[(x + dx, y + dy) for dx, dy in corners])).withColumn("x", x).withColumn("y", y)
    sides = [(0, -1), (0, 1)]
    offsets = F.when(even, _offsets([*sides, (-1, 0), (-1, 1), (1, 0), (1, 1)])).otherwise(_offsets([*sides, (-1, -1), (-1, 0), (1, -1), (1, 0)]))
    return d.withColumn("neighbors", _neighbors(offsets, nrow, ncol))


def hexagon_flat(spark: SparkSession, x0: float, y0: float, resolution: float, nrow: int, ncol: int) -> DataFrame:
    """Flat-topped hexagons of the area of a square of ``resolution``; even columns lie half a cell lower, the first corner is to the right."""
    edge = math.sqrt(2 * resolution * resolution / (3 * math.sqrt(3)))
    high = edge * math.sqrt(3)
    even = F.col("col") % 2 == 0
    x = F.lit(x0) + (F.col("col") - 1) * F.lit(1.5 * edge)
    y = F.lit(y0) + (F.col("row") - 1) * F.lit(high) - F.when(even, high / 2).otherwise(0.0)
    corners = [(edge, 0.0), (edge / 2, high / 2), (-edge / 2, high / 2), (-edge, 0.0), (-edge / 2, -high / 2), (edge / 2, -high / 2)]
    d = _grid(spark, nrow, ncol).withColumn("ring", _ring(*[(x + dx, y + dy) for dx, dy in corners])).withColumn("x", x).withColumn("y", y)
    column = [(-1, 0), (1, 0)]
    offsets = F.when(even, _offsets([*column, (-1, -1), (0, -1), (-1, 1), (0, 1)])).otherwise(_offsets([*column, (0, -1), (1, -1), (0, 1), (1, 1)]))
    return d.withColumn("neighbors", _neighbors(offsets, nrow, ncol))


def unprojected(cells: DataFrame) -> DataFrame:
    """Cells (ring, x, y in spherical Mercator metres) in degrees: ring, lon, lat."""
    ring = F.transform("ring", lambda p: F.struct(geo.from_mercator(p["lon"], p["lat"])[0].alias("lon"), geo.from_mercator(p["lon"], p["lat"])[1].alias("lat")))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return cells.withColumn("ring", ring).withColumn("lon", lon).withColumn("lat", lat).drop("x", "y")


def cells_by_edge(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, cell_id): the cells that have a given edge (edge, p, q: (lon, lat) structs), either way round."""
    n = F.size("ring")
    corner = lambda p: F.struct(F.round(p["lon"] * 1e6).cast("long").alias("x"), F.round(p["lat"] * 1e6).cast("long").alias("y"))
    sides = F.transform("ring", lambda p, i: F.array_sort(F.array(corner(p), corner(F.element_at("ring", F.pmod(i + 1, n) + 1)))))
    own = cells.select("cell_id", F.explode(sides).alias("__side"))
    return edges.select("edge", F.array_sort(F.array(corner(F.col("p")), corner(F.col("q")))).alias("__side")).join(own, "__side").select("edge", "cell_id")


def faces_of(resolution: float) -> int:
    """Cells along a face of a cubed sphere for cells of about ``resolution`` metres: a quarter of the circumference, whole cells."""
    return max(1, int(2 * math.pi * geo.RADIUS / 4 / resolution))


def triangular(spark: SparkSession, x0: float, y0: float, resolution: float, nrow: int, ncol: int) -> DataFrame:
    """Equilateral triangles of the area of a square of ``resolution``, pointing up and down in turn; no neighbours."""
    edge = math.sqrt(4 * resolution * resolution / math.sqrt(3))
    high = edge * math.sqrt(3) / 2
    x = F.lit(x0) + (F.col("col") - 1) * F.lit(edge / 2)
    y = F.lit(y0) + (F.col("row") - 1) * F.lit(high)
    up = (F.col("row") + F.col("col")) % 2 == 0
    ring = F.when(up, _ring((x, y), (x + edge, y), (x + edge / 2, y + high))).otherwise(_ring((x, y + high), (x + edge, y + high), (x + edge / 2, y)))
    return _grid(spark, nrow, ncol).withColumn("ring", ring)


def shared_edges(cells: DataFrame) -> DataFrame:
    """(a, b): pairs of cells, a < b, that share an undirected edge: an equi-join on the edge's two rounded corners."""
    n = F.size("ring")
    corner = lambda p: F.struct(F.round(p["lon"] * 1e6).cast("long").alias("x"), F.round(p["lat"] * 1e6).cast("long").alias("y"))
    edges = F.transform("ring", lambda p, i: F.array_sort(F.array(corner(p), corner(F.element_at("ring", F.pmod(i + 1, n) + 1)))))
    e = cells.select("cell_id", F.explode(edges).alias("edge"))
    return e.select(F.col("cell_id").alias("a"), "edge").join(e.select(F.col("cell_id").alias("b"), "edge"), "edge").where("a < b").select("a", "b").distinct()


def neighbor_distance(cells: DataFrame, distance) -> DataFrame:
    """(cell_id, neighbor, distance): the id self-join on the exploded neighbour lists."""
    d = cells.select("cell_id", "lon", "lat", F.explode("neighbors").alias("neighbor"))
    other = cells.select(F.col("cell_id").alias("neighbor"), F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
    j = d.join(other, "neighbor")
    return j.select("cell_id", "neighbor", distance(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat")).alias("distance"))


def fill_holes(grid: DataFrame, kept: DataFrame) -> DataFrame:
    """(cell_id, filled): the ``kept`` cells, and each cell of ``grid`` that is the only missing neighbour of a kept one."""
    near = grid.join(kept.select("cell_id"), "cell_id", "left_semi").select("cell_id", F.explode("neighbors").alias("neighbor"))
    missing = near.join(kept.select(F.col("cell_id").alias("neighbor")), "neighbor", "left_anti")
    holes = missing.groupBy("cell_id").agg(F.count("*").alias("n"), F.min("neighbor").alias("neighbor")).where("n = 1")
    return kept.select("cell_id", F.lit(0).alias("filled")).unionByName(holes.select(F.col("neighbor").alias("cell_id"), F.lit(1).alias("filled")).distinct())


def compose_spacing(cells: DataFrame, masks: list[tuple[DataFrame, float]], default: float) -> DataFrame:
    """(cell_id, spacing): the least of ``default`` and the resolutions of the masks (cell_id) that hold the cell."""
    d = cells.select("cell_id", F.lit(float(default)).alias("spacing"))
    for mask, resolution in masks:
        d = d.join(mask.select("cell_id").distinct().withColumn("__in", F.lit(float(resolution))), "cell_id", "left")
        d = d.select("cell_id", F.least("spacing", F.coalesce("__in", F.col("spacing"))).alias("spacing"))
    return d


def cubed_sphere(spark: SparkSession, n: int) -> DataFrame:
    """Six faces of ``n`` by ``n`` cells of equal angles: (cell_id, face, lon, lat, ring)."""
    d = spark.range(6 * n * n).select((F.col("id") + 1).alias("cell_id"), F.floor(F.col("id") / (n * n)).alias("face"), (F.col("id") % n).alias("i"), (F.floor(F.col("id") / n) % n).alias("j"))
    one, face = F.lit(1.0), F.col("face")

    def place(di: float, dj: float) -> tuple[Column, Column]:
        a, b = [F.tan((F.col(k) + x) * (math.pi / 2 / n) - math.pi / 4) for k, x in (("i", di), ("j", dj))]
        sides = [(one, a, b), (-a, one, b), (-one, -a, b), (a, -one, b), (-b, a, one), (b, a, -one)]
        return geo.to_lonlat(*[F.element_at(F.array(*[side[axis] for side in sides]), (face + 1).cast("int")) for axis in range(3)])

    lon, lat = place(0.5, 0.5)
    return d.select("cell_id", "face", lon.alias("lon"), lat.alias("lat"), _ring(place(0, 0), place(1, 0), place(1, 1), place(0, 1)).alias("ring"))


def _circumcentre(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The place as far from three others, structs (x, y, z): in the plane z = 0, or along the normal of a sphere's triangle."""
    u = [b[k] - a[k] for k in "xyz"]
    v = [c[k] - a[k] for k in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    uu, vv, nn = (sum(p * q for p, q in zip(m, w, strict=True)) for m, w in ((u, u), (v, v), (n, n)))
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    mixed = [uu * q - vv * p for p, q in zip(u, v, strict=True)]
    out = cross(mixed, n)
    return tuple(a[k] + o / (2 * nn) for k, o in zip("xyz", out, strict=True))


def dual(triangles: DataFrame, points: DataFrame, sphere: bool = True) -> DataFrame:
    """Cells round the points of a triangulation: (cell_id, lon, lat, ring, neighbors, open).

    ``triangles`` has (triangle, a, b, c), ids of ``points`` (id, lon, lat), or (id, x, y) in a plane as lon and lat. The
    corners of a cell are the circumcentres of its triangles, counterclockwise round the point by their angle; neighbours
    are the points of its triangles, in ascending order. A cell at the border, whose triangles don't close round it, is
    open: its ring ends at the first and the last circumcentre. A point of no triangle has no cell.
    """
    lon, lat = F.col("lon"), F.col("lat")
    x, y, z = geo.unit_xyz(lon, lat) if sphere else (lon, lat, F.lit(0.0))
    at = points.select("id", F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("at"))
    t = triangles.select("triangle", "a", "b", "c")
    for k in "abc":
        t = t.join(at.select(F.col("id").alias(k), F.col("at").alias("at_" + k)), k)
    cx, cy, cz = _circumcentre(F.col("at_a"), F.col("at_b"), F.col("at_c"))
    place = geo.to_lonlat(cx, cy, cz) if sphere else (cx, cy)
    t = t.select("triangle", "a", "b", "c", F.struct(place[0].alias("lon"), place[1].alias("lat")).alias("p"))
    d = t.withColumn("id", F.explode(F.array("a", "b", "c"))).join(points.select("id", "lon", "lat"), "id")
    if sphere:
        # on the plane that touches the sphere at the point, east and north
        px, py, pz = geo.unit_xyz(F.col("p.lon"), F.col("p.lat"))
        a, b = F.radians("lon"), F.radians("lat")
        east = -F.sin(a) * px + F.cos(a) * py
        north = -F.sin(b) * F.cos(a) * px - F.sin(b) * F.sin(a) * py + F.cos(b) * pz
    else:
        east, north = F.col("p.lon") - F.col("lon"), F.col("p.lat") - F.col("lat")
    d = d.withColumn("angle", F.atan2(north, east))
    others = F.filter(F.array("a", "b", "c"), lambda k: k != F.col("id"))
    g = d.groupBy("id", "lon", "lat").agg(F.array_sort(F.collect_list(F.struct("angle", "triangle", "p"))).alias("r"), F.flatten(F.collect_list(others)).alias("o"))  # some triangles a point
    # at a border two neighbours are in one triangle only, and so there are more neighbours than triangles
    near = F.array_sort(F.array_distinct("o"))
    gap = F.size(near) > F.size("r")
    n = F.size("r")
    step = F.transform("r", lambda v, i: F.pmod(F.element_at("r", F.pmod(i + 1, n) + 1)["angle"] - v["angle"], F.lit(2 * math.pi)))
    last = (F.array_position(step, F.array_max(step)) - 1).cast("int")  # the widest turn is the gap
    turned = F.when(gap, F.concat(F.slice("r", last + 2, n), F.slice("r", F.lit(1), last + 1))).otherwise(F.col("r"))
    return g.select(F.col("id").alias("cell_id"), "lon", "lat", F.transform(turned, lambda v: v["p"]).alias("ring"), near.alias("neighbors"), gap.alias("open"))
