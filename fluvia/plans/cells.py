"""Cells of any shape under lines and boundaries, and imported meshes, as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import importers, mesh, network, overlay
from ..sources import files
from . import base, grids
from .iterate import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
XY = ("lon1", "lat1", "lon2", "lat2")
GRID = (-81.25, 34.0, 0.5, 25, 25)
#: Half a degree as the side of a square of equal area, from the middle of the walks' mesh.
HEX = (-81.0, 34.25, 0.5, 34, 26)


def hexagons(spark):
    return mesh.hexagon(spark, *HEX)


_edge = "(sqrt(CAST(0.5 AS DOUBLE)/(3*sqrt(CAST(3 AS DOUBLE)))))"
_wide = f"({_edge}*sqrt(CAST(3 AS DOUBLE)))"
HEXES = f"hx AS (SELECT i + 1 AS cell_id, CAST(-81 AS DOUBLE) + CAST(i % 26 AS DOUBLE)*{_wide} + CASE WHEN ((i - i % 26)/26 + 1) % 2 = 0 THEN {_wide}/2 ELSE 0 END AS x, CAST(34.25 AS DOUBLE) + CAST((i - i % 26)/26 AS DOUBLE)*CAST(1.5 AS DOUBLE)*{_edge} AS y FROM range({34 * 26}) t(i))"


def walk_edges(spark, sf_dir):
    e = network.split_to_edges(base.walks(spark, sf_dir), "line", ["pos"])
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("line").orderBy("pos")))


def walk_parts(spark, sf_dir):
    return overlay.edges_in_rings(walk_edges(spark, sf_dir), hexagons(spark), 1.0)


# A hexagon is where six half-planes meet: n . (p - centre) <= wide / 2 for normals 60 degrees apart.
_normals = ", ".join(f"(cos(radians({a}::DOUBLE)), sin(radians({a}::DOUBLE)))" for a in range(0, 360, 60))
PARTS = f"""{base.WALKS}, {HEXES},
q AS (SELECT line, pos, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM w8 WINDOW w AS (PARTITION BY line ORDER BY pos)),
s AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos) AS seq FROM q WHERE lon2 IS NOT NULL AND (lon1 <> lon2 OR lat1 <> lat2)),
nn AS (SELECT * FROM (VALUES {_normals}) v(nx, ny)),
hp AS (SELECT s.*, cell_id, nx*(lon2-lon1)+ny*(lat2-lat1) AS d, {_wide}/2 - (nx*(lon1-x)+ny*(lat1-y)) AS r
  FROM s JOIN hx ON abs((lon1+lon2)/2-x) <= abs(lon2-lon1)/2 + {_wide}/2 AND abs((lat1+lat2)/2-y) <= abs(lat2-lat1)/2 + {_edge} CROSS JOIN nn),
cl AS (SELECT line, pos, seq, lon1, lat1, lon2, lat2, cell_id, greatest(0, max(CASE WHEN d < 0 THEN r/d END)) AS t0, least(1, min(CASE WHEN d > 0 THEN r/d END)) AS t1, bool_and(d <> 0 OR r >= 0) AS ok FROM hp GROUP BY ALL),
pt AS (SELECT *, {base.HAVERSINE.format("(lon1+t0*(lon2-lon1))", "(lat1+t0*(lat2-lat1))", "(lon1+t1*(lon2-lon1))", "(lat1+t1*(lat2-lat1))")} AS length FROM cl WHERE ok AND t1 - t0 > 1e-12)"""


def _parts(spark, sf_dir):
    """The parts of each edge in each hexagon."""
    d = walk_parts(spark, sf_dir).where("t1 - t0 > 1e-12")
    return d.select("line", "pos", "cell_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), F.round(geo.haversine(*overlay.part_ends()), 2).alias("length"))


QUERIES["topo_intersect_mesh"] = _parts
ORACLES["topo_intersect_mesh"] = f"WITH {PARTS} SELECT line, pos, cell_id, round(t0, 6) + 0 AS t0, round(t1, 6) AS t1, round(length, 2) AS length FROM pt"
QUERIES["topo_intersect_boxes"], ORACLES["topo_intersect_boxes"] = grids.QUERIES["topo_intersect_mesh"], grids.ORACLES["topo_intersect_mesh"]
QUERIES["topo_reaches"] = lambda s, d: overlay.reaches(walk_parts(s, d).where("t1 - t0 > 1e-12")).select("line", "cell_id", C("reach").cast("long").alias("reach"), C("first").cast("long").alias("first"), C("last").cast("long").alias("last"), F.round("length", 1).alias("length"))
ORACLES["topo_reaches"] = f"""WITH {PARTS}, b AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(t1) OVER w = 1 AND t0 = 0 THEN 0 ELSE 1 END AS new FROM pt WINDOW w AS (PARTITION BY line, cell_id ORDER BY seq)),
c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY line, cell_id ORDER BY seq) AS BIGINT) AS reach FROM b)
SELECT line, cell_id, reach, min(seq) AS first, max(seq) AS last, round(sum(length), 1) AS length FROM c GROUP BY line, cell_id, reach"""
QUERIES["topo_outlet_check"] = lambda s, d: overlay.outlet_cell(walk_parts(s, d).where("t1 - t0 > 1e-12"), walk_edges(s, d).select("line", (C("line") * 37 % 101).alias("segment")).distinct())
ORACLES["topo_outlet_check"] = f"WITH {PARTS}, m AS (SELECT line FROM (SELECT DISTINCT line FROM s) ORDER BY line*37 % 101 DESC, line DESC LIMIT 1) SELECT line, cell_id FROM pt JOIN m USING (line) ORDER BY seq DESC, t1 DESC LIMIT 1"

# Cells that are no convex ring: an L (two boxes) for nations of even number, a box with a hole for the others.
_BOX = "CAST(-81 AS DOUBLE) + CAST((n_nationkey*7) % 23 AS DOUBLE)/2 + 0.0137::DOUBLE", "CAST(35 AS DOUBLE) + CAST((n_nationkey*5) % 19 AS DOUBLE)/2 + 0.0071::DOUBLE"
_HOLES = [[(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]


def holed(spark, sf_dir):
    k = C("n_nationkey")
    x, y = -81 + (k * 7 % 23) / 2.0 + 0.0137, 35 + (k * 5 % 19) / 2.0 + 0.0071
    angled, border, hole = [F.array(*[F.struct((x + a / 2).alias("lon"), (y + b / 2).alias("lat")) for a, b in ring]) for ring in _HOLES]
    return base.table(spark, sf_dir, "nation").select(k.alias("cell_id"), F.when(k % 2 == 0, F.array(angled)).otherwise(F.array(border, hole)).alias("rings"))


def _holed_parts(spark, sf_dir):
    """For each edge and cell the parts of the edge inside, and their share of it."""
    d = overlay.edges_in_polygons(walk_edges(spark, sf_dir), holed(spark, sf_dir), 1.0).where("t1 - t0 > 1e-12")
    return d.groupBy("line", "pos", "cell_id").agg(F.count("*").alias("parts"), F.round(F.sum(C("t1") - C("t0")), 6).alias("share"))


def _boxed(name: str, x1: float, y1: float, x2: float, y2: float) -> str:
    """(t0, t1) of the part of an edge in a box of the cell at (x, y), for the boxes of nations that have it."""
    def near(d, at, low, high, first):
        a, b = (low, high) if first else (high, low)
        return f"CASE WHEN {d} > 0 THEN ({a} - {at})/{d} WHEN {d} < 0 THEN ({b} - {at})/{d} WHEN {at} BETWEEN {low} AND {high} THEN {0 if first else 1} ELSE {2 if first else -1} END"

    bx = f"(x+{x1}::DOUBLE)", f"(x+{x2}::DOUBLE)", f"(y+{y1}::DOUBLE)", f"(y+{y2}::DOUBLE)"
    t0 = f"greatest(0::DOUBLE, {near('(lon2-lon1)', 'lon1', bx[0], bx[1], True)}, {near('(lat2-lat1)', 'lat1', bx[2], bx[3], True)})"
    t1 = f"least(1::DOUBLE, {near('(lon2-lon1)', 'lon1', bx[0], bx[1], False)}, {near('(lat2-lat1)', 'lat1', bx[2], bx[3], False)})"
    return f"{t0} AS {name}0, {t1} AS {name}1"


QUERIES["topo_intersect_polygons"] = _holed_parts
ORACLES["topo_intersect_polygons"] = f"""WITH {base.WALKS}, q AS (SELECT line, pos, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM w8 WINDOW w AS (PARTITION BY line ORDER BY pos)),
s AS (SELECT * FROM q WHERE lon2 IS NOT NULL AND (lon1 <> lon2 OR lat1 <> lat2)), nc AS (SELECT n_nationkey AS cell_id, {_BOX[0]} AS x, {_BOX[1]} AS y FROM nation),
j AS (SELECT * FROM s JOIN nc ON least(lon1, lon2) <= x + 2 AND greatest(lon1, lon2) >= x AND least(lat1, lat2) <= y + 2 AND greatest(lat1, lat2) >= y),
b AS (SELECT *, {_boxed("a", 0, 0, 2, 1)}, {_boxed("b", 0, 1, 1, 2)}, {_boxed("o", 0, 0, 2, 2)}, {_boxed("i", 0.5, 0.5, 1.5, 1.5)} FROM j),
k AS (SELECT line, pos, cell_id, a0, a1, b0, b1, a1 - a0 > 1e-12 AS ina, b1 - b0 > 1e-12 AS inb, o0, o1, CASE WHEN i1 > i0 THEN i0 ELSE o1 END AS i0, CASE WHEN i1 > i0 THEN i1 ELSE o1 END AS i1 FROM b),
r AS (SELECT line, pos, cell_id, CAST(ina AS BIGINT) + CAST(inb AS BIGINT) - CASE WHEN ina AND inb AND (abs(a1 - b0) < 1e-9 OR abs(b1 - a0) < 1e-9) THEN 1 ELSE 0 END AS parts, CASE WHEN ina THEN a1 - a0 ELSE 0 END + CASE WHEN inb THEN b1 - b0 ELSE 0 END AS share FROM k WHERE cell_id % 2 = 0
UNION ALL SELECT line, pos, cell_id, CASE WHEN i0 - o0 > 1e-12 THEN 1 ELSE 0 END + CASE WHEN o1 - i1 > 1e-12 THEN 1 ELSE 0 END, greatest(i0 - o0, 0) + greatest(o1 - i1, 0) FROM k WHERE cell_id % 2 = 1 AND o1 > o0)
SELECT line, pos, cell_id, CAST(parts AS BIGINT) AS parts, round(share, 6) AS share FROM r WHERE parts > 0"""

# Boundaries: diamonds |x - cx| + |y - cy| <= r, one a nation.
DIAMONDS = "dm AS (SELECT n_nationkey AS polygon, CAST(-81 AS DOUBLE) + CAST((n_nationkey*7) % 23 AS DOUBLE)/2 + 0.125 AS cx, CAST(35 AS DOUBLE) + CAST((n_nationkey*5) % 19 AS DOUBLE)/2 + 0.0625 AS cy, 0.75 + CAST(n_nationkey % 4 AS DOUBLE)/2 AS r FROM nation)"
DISTANCE = "(greatest(x1-cx, 0, cx-x1-0.5) + greatest(y1-cy, 0, cy-y1-0.5))"
FARTHEST = "(greatest(abs(x1-cx), abs(x1+0.5-cx)) + greatest(abs(y1-cy), abs(y1+0.5-cy)))"


def diamonds(spark, sf_dir):
    k = C("n_nationkey")
    n = base.table(spark, sf_dir, "nation")
    cx, cy, r = -81 + (k * 7 % 23) / 2.0 + 0.125, 35 + (k * 5 % 19) / 2.0 + 0.0625, 0.75 + (k % 4) / 2.0
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return n.select(k.alias("polygon"), F.array(p(cx + r, cy), p(cx, cy + r), p(cx - r, cy), p(cx, cy - r)).alias("ring"))


def boundaries(spark, sf_dir):
    """The diamonds written as GeoJSON and read back, as sides."""
    path = shared_path(spark, "boundary")
    files.write_rings(diamonds(spark, sf_dir), path, ["polygon"])
    return overlay.ring_edges(files.read_rings(spark, path, collection=False).select(C("properties")["polygon"].cast("int").alias("polygon"), "ring"), "polygon")


def grid(spark):
    return mesh.latlon(spark, *GRID)


QUERIES["src_boundary"] = lambda s, d: boundaries(s, d).groupBy("polygon").agg(F.min("lon1").alias("x1"), F.max("lon1").alias("x2"), F.min("lat1").alias("y1"), F.max("lat1").alias("y2"), F.count("*").alias("sides"))
ORACLES["src_boundary"] = f"WITH {DIAMONDS} SELECT polygon, cx-r AS x1, cx+r AS x2, cy-r AS y1, cy+r AS y2, CAST(4 AS BIGINT) AS sides FROM dm"
QUERIES["prd_within_or_intersects"] = lambda s, d: overlay.cells_in_boundary(grid(s), boundaries(s, d), 1.0)
ORACLES["prd_within_or_intersects"] = f"WITH {base.CELLS}, {DIAMONDS} SELECT cell_id, polygon FROM c5 JOIN dm ON {DISTANCE} <= r"
QUERIES["prd_overlaps"] = lambda s, d: overlay.boundary_cells(grid(s), boundaries(s, d), 1.0)
ORACLES["prd_overlaps"] = f"WITH {base.CELLS}, {DIAMONDS} SELECT cell_id, polygon FROM c5 JOIN dm ON {DISTANCE} < r AND {FARTHEST} > r"
QUERIES["topo_burn_boundary"] = lambda s, d: grid(s).select("cell_id").join(overlay.boundary_cells(grid(s), boundaries(s, d), 1.0).groupBy("cell_id").agg(F.max("polygon").alias("polygon")), "cell_id", "left").select("cell_id", F.coalesce("polygon", F.lit(-1)).alias("basin"), C("polygon").isNotNull().alias("boundary"))
ORACLES["topo_burn_boundary"] = f"WITH {base.CELLS}, {DIAMONDS} SELECT cell_id, coalesce(max(polygon), -1) AS basin, max(polygon) IS NOT NULL AS boundary FROM c5 LEFT JOIN dm ON {DISTANCE} < r AND {FARTHEST} > r GROUP BY cell_id"
QUERIES["geo_cell_bound"] = lambda s, d: hexagons(s).select("cell_id", *[F.round(c, 6).alias(n) for c, n in zip(overlay.ring_box(C("ring")), ("x1", "y1", "x2", "y2"), strict=True)])
ORACLES["geo_cell_bound"] = f"WITH {HEXES} SELECT cell_id, round(x-{_wide}/2, 6) AS x1, round(y-{_edge}, 6) AS y1, round(x+{_wide}/2, 6) AS x2, round(y+{_edge}, 6) AS y2 FROM hx"
QUERIES["geo_line_bound"] = lambda s, d: base.walks(s, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).select("line", *[c.alias(n) for c, n in zip(overlay.ring_box(C("p")), ("x1", "y1", "x2", "y2"), strict=True)])
ORACLES["geo_line_bound"] = f"WITH {base.WALKS} SELECT line, min(lon) AS x1, min(lat) AS y1, max(lon) AS x2, max(lat) AS y2 FROM w8 GROUP BY line"


def _bounded(spark, sf_dir, cells):
    """The cells that meet a boundary, with neighbours among them and the corners left to the ocean."""
    return overlay.restrict(cells, overlay.cells_in_boundary(cells, boundaries(spark, sf_dir), 1.0))


KEPT = f"{grids.NEAR}, {DIAMONDS}, kp AS (SELECT DISTINCT cell_id FROM c5 JOIN dm ON {DISTANCE} <= r)"
QUERIES["mesh_latlon"] = lambda s, d: _bounded(s, d, grid(s)).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "neighbors", "ocean")
ORACLES["mesh_latlon"] = f"WITH {KEPT} SELECT c5.cell_id, round(x1+0.25, 6) AS lon, round(y1+0.25, 6) AS lat, coalesce(list(neighbor ORDER BY neighbor) FILTER (neighbor IS NOT NULL), []) AS neighbors, 4 - count(neighbor) AS ocean FROM c5 JOIN kp USING (cell_id) LEFT JOIN (SELECT * FROM n WHERE neighbor IN (FROM kp)) n ON n.cell_id = c5.cell_id GROUP BY c5.cell_id, x1, y1"
QUERIES["mesh_latlon_whole"], ORACLES["mesh_latlon_whole"] = grids.QUERIES["mesh_latlon"], grids.ORACLES["mesh_latlon"]
# A hexagon meets a diamond unless one of their sides' normals parts them; corners of both are compared along each.
_hexcorners = ", ".join(f"(sin(radians({a}::DOUBLE)), cos(radians({a}::DOUBLE)))" for a in range(0, 360, 60))
_axes = ", ".join(f"(cos(radians({a}::DOUBLE)), sin(radians({a}::DOUBLE)))" for a in (0, 60, 120, 45, 135))
HEXKEPT = f"""{HEXES}, {DIAMONDS}, ax AS (SELECT * FROM (VALUES {_axes}) v(nx, ny)), hc AS (SELECT * FROM (VALUES {_hexcorners}) v(kx, ky)),
hr AS (SELECT nx, ny, max(nx*kx+ny*ky)*{_edge} AS h FROM ax CROSS JOIN hc GROUP BY nx, ny),
kp AS (SELECT DISTINCT cell_id FROM hx JOIN dm ON abs(x-cx) + abs(y-cy) < r + 1 WHERE NOT EXISTS (SELECT 1 FROM hr WHERE abs(nx*(x-cx)+ny*(y-cy)) > h + r*greatest(abs(nx), abs(ny))))"""
QUERIES["mesh_hexagon_boundary"] = lambda s, d: _bounded(s, d, hexagons(s)).select("cell_id", F.size("neighbors").cast("long").alias("n"), "ocean")
ORACLES["mesh_hexagon_boundary"] = f"WITH {HEXKEPT}, k2 AS (SELECT hx.* FROM hx JOIN kp USING (cell_id)) SELECT a.cell_id, count(b.cell_id) AS n, 6 - count(b.cell_id) AS ocean FROM k2 a LEFT JOIN k2 b ON a.cell_id <> b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 1.1::DOUBLE*{_wide}*{_wide} GROUP BY a.cell_id"


def _flat(spark, sf_dir):
    """Flat-topped hexagons: every second column half a cell lower."""
    return mesh.hexagon_flat(spark, 0.0, 0.0, 5000.0, 20, 30).select("cell_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "neighbors", F.round(C("ring")[0]["lon"], 3).alias("corner"))


_fe, _fw = "sqrt(CAST(50000000 AS DOUBLE)/(3*sqrt(CAST(3 AS DOUBLE))))", "(sqrt(CAST(50000000 AS DOUBLE)/(3*sqrt(CAST(3 AS DOUBLE))))*sqrt(CAST(3 AS DOUBLE)))"
FLAT = f"h AS (SELECT i + 1 AS cell_id, CAST(i % 30 AS DOUBLE)*1.5::DOUBLE*{_fe} AS x, CAST((i - i % 30)/30 AS DOUBLE)*{_fw} - CASE WHEN (i % 30 + 1) % 2 = 0 THEN {_fw}/2 ELSE 0 END AS y FROM range(600) t(i))"
QUERIES["mesh_hexagon_flat"] = _flat
ORACLES["mesh_hexagon_flat"] = f"WITH {FLAT} SELECT a.cell_id, round(a.x, 3) AS x, round(a.y, 3) AS y, list(b.cell_id ORDER BY b.cell_id) AS neighbors, round(a.x + {_fe}, 3) AS corner FROM h a JOIN h b ON a.cell_id <> b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 1.1::DOUBLE*{_fw}*{_fw} GROUP BY a.cell_id, a.x, a.y"
QUERIES["mesh_square"] = lambda s, d: mesh.unprojected(mesh.square(s, -9_000_000.0, 4_000_000.0, 50_000.0, 20, 30)).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round(C("ring")[2]["lat"], 6).alias("top"), F.size("neighbors").cast("long").alias("n"))
ORACLES["mesh_square"] = """WITH g AS (SELECT i + 1 AS cell_id, i % 30 AS c, (i - i % 30)/30 AS r FROM range(600) t(i)), p AS (SELECT *, CAST(-9000000 + c*50000 + 25000 AS DOUBLE) AS x, CAST(4000000 + r*50000 + 25000 AS DOUBLE) AS y FROM g)
SELECT cell_id, round(degrees(x/6378137), 6) AS lon, round(degrees(2*atan(exp(y/6378137)) - pi()/2), 6) AS lat, round(degrees(2*atan(exp((y+25000)/6378137)) - pi()/2), 6) AS top,
  CAST((CASE WHEN c IN (0, 29) THEN 2 ELSE 3 END)*(CASE WHEN r IN (0, 19) THEN 2 ELSE 3 END)-1 AS BIGINT) AS n FROM p"""
QUERIES["mesh_square_metres"], ORACLES["mesh_square_metres"] = grids.QUERIES["mesh_square"], grids.ORACLES["mesh_square"]
_len = "sqrt(CAST(100000000 AS DOUBLE)/sqrt(CAST(3 AS DOUBLE)))"
_high = f"({_len}*sqrt(CAST(3 AS DOUBLE))/2)"
QUERIES["mesh_triangular"] = lambda s, d: mesh.triangular(s, 0.0, 0.0, 5000.0, 20, 30).select("cell_id", F.posexplode("ring").alias("pos", "p")).select("cell_id", C("pos").cast("long").alias("pos"), F.round("p.lon", 3).alias("x"), F.round("p.lat", 3).alias("y"))
ORACLES["mesh_triangular"] = f"""WITH t AS (SELECT i + 1 AS cell_id, i % 30 AS c, (i - i % 30)/30 AS r, pos FROM range(600) x(i), range(3) y(pos))
SELECT cell_id, pos, round((CAST(c AS DOUBLE)/2 + CASE pos WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.5 END)*{_len}, 3) AS x, round((CAST(r AS DOUBLE) + CASE WHEN ((r + c) % 2 = 0) = (pos = 2) THEN 1 ELSE 0 END)*{_high}, 3) AS y FROM t"""
QUERIES["lookup_cells_by_edge"] = lambda s, d: mesh.cells_by_edge(hexagons(s), hexagons(s).where("cell_id % 5 = 0").select(C("cell_id").alias("edge"), C("ring")[1].alias("p"), C("ring")[2].alias("q")))
ORACLES["lookup_cells_by_edge"] = f"WITH {HEXES} SELECT a.cell_id AS edge, b.cell_id FROM hx a JOIN hx b ON a.cell_id % 5 = 0 AND (b.cell_id = a.cell_id OR (abs(b.x-a.x-{_wide}) < 0.001 AND abs(b.y-a.y) < 0.001))"


# Imported meshes: the grid of the walks as arrays of cells, edges and vertices.
def mpas_tables(spark):
    """(cells, edges, vertices) of the grid as an MPAS file has them; vertex (c, r) of 26 by 26, edges named by their ends."""
    g = grid(spark)
    vertex = lambda dr, dc: ((C("row") - 1 + dr) * 26 + C("col") + dc).cast("long")
    corners = [vertex(0, 0), vertex(0, 1), vertex(1, 1), vertex(1, 0)]
    sides = [F.least(a, b) * 2 + (F.abs(a - b) == 1).cast("int") for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    inside = lambda dr, dc: F.when((C("row") + dr).between(1, 25) & (C("col") + dc).between(1, 25), (C("row") + dr - 1) * 25 + C("col") + dc).otherwise(0).cast("long")
    pad = F.lit(0).cast("long")
    cells = g.select(
        C("cell_id").alias("indexToCellID"), F.radians(F.pmod(C("lon") + 360, F.lit(360.0))).alias("lonCell"), F.radians("lat").alias("latCell"), F.array(*corners, pad).alias("verticesOnCell"),
        F.array(*sides, pad).alias("edgesOnCell"), F.array(inside(-1, 0), inside(0, 1), inside(1, 0), inside(0, -1), pad).alias("cellsOnCell"), F.lit(1.0).alias("areaCell"),
        (C("cell_id") * 1.0).alias("bed_elevation"), F.when(C("cell_id") % 3 == 0, C("cell_id") * 2.0).otherwise(0.0).alias("ice_thickness"),
    )
    k = spark.range(26 * 26).select((C("id") + 1).alias("indexToVertexID"), F.radians(F.lit(-81.25) + (C("id") % 26) / 2.0).alias("lonVertex"), F.radians(F.lit(34.0) + F.floor(C("id") / 26) / 2.0).alias("latVertex"))
    edges = cells.select(F.explode("edgesOnCell").alias("indexToEdgeID")).where("indexToEdgeID > 0").distinct().withColumn("dcEdge", C("indexToEdgeID") * 10.0)
    return cells, edges, k


def mpas_files(spark):
    """The grid written as tables of MPAS arrays, and read back."""
    path = shared_path(spark, "mpas")
    for name, t in zip(("cells", "edges", "vertices"), mpas_tables(spark), strict=True):
        t.write.parquet(f"{path}/{name}")
    return [spark.read.parquet(f"{path}/{name}") for name in ("cells", "edges", "vertices")]


def _mpas(spark, sf_dir):
    """The grid imported within the boundaries."""
    return importers.mpas(*mpas_files(spark), "global", boundaries(spark, sf_dir), 1.0)


_near4 = "CASE WHEN b.cell_id = a.cell_id - 25 THEN 0 WHEN b.cell_id = a.cell_id + 1 THEN 1 WHEN b.cell_id = a.cell_id + 25 THEN 2 ELSE 3 END"
_vid = "(a.r - 1 + {0})*26 + a.c + {1}"
_side = f"CASE WHEN b.cell_id = a.cell_id - 25 THEN ({_vid.format(0, 0)})*2 + 1 WHEN b.cell_id = a.cell_id + 1 THEN ({_vid.format(0, 1)})*2 WHEN b.cell_id = a.cell_id + 25 THEN ({_vid.format(1, 0)})*2 + 1 ELSE ({_vid.format(0, 0)})*2 END"
MPAS = f"""{grids.GRID}, {DIAMONDS}, kp AS (SELECT DISTINCT cell_id FROM c5 JOIN dm ON {DISTANCE} <= r),
nb AS (SELECT a.cell_id, b.cell_id AS neighbor, {_near4} AS pos, CAST({_side} AS DOUBLE)*10 AS distance FROM g a JOIN g b ON abs(a.r-b.r) + abs(a.c-b.c) = 1 WHERE a.cell_id IN (FROM kp) AND b.cell_id IN (FROM kp))"""
QUERIES["mesh_mpas"] = lambda s, d: _mpas(s, d).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("elevation", 4).alias("elevation"), "neighbors", "distances", F.size("ring").cast("long").alias("corners"))
ORACLES["mesh_mpas"] = f"""WITH {MPAS} SELECT g.cell_id, round(x1+0.25, 6) AS lon, round(y1+0.25, 6) AS lat, round(CASE WHEN g.cell_id % 3 = 0 THEN g.cell_id + g.cell_id*2*0.917::DOUBLE ELSE g.cell_id END, 4) AS elevation,
coalesce(list(neighbor ORDER BY pos) FILTER (neighbor IS NOT NULL), []) AS neighbors, coalesce(list(distance ORDER BY pos) FILTER (neighbor IS NOT NULL), []) AS distances, CAST(4 AS BIGINT) AS corners
FROM g JOIN kp USING (cell_id) LEFT JOIN nb ON nb.cell_id = g.cell_id GROUP BY g.cell_id, x1, y1"""
QUERIES["src_mpas_nc"] = lambda s, d: mpas_files(s)[0].select(C("indexToCellID").alias("cell_id"), F.expr("filter(verticesOnCell, x -> x > 0)").alias("corners"), F.size("edgesOnCell").cast("long").alias("width"))
ORACLES["src_mpas_nc"] = f"WITH {grids.GRID} SELECT cell_id, [CAST(x AS BIGINT) FOR x IN [(r-1)*26+c, (r-1)*26+c+1, r*26+c+1, r*26+c]] AS corners, CAST(5 AS BIGINT) AS width FROM g"
QUERIES["cvt_attr_cell"] = lambda s, d: importers.rings_by_vertex(mpas_tables(s)[0].withColumnRenamed("indexToCellID", "cell_id"), "verticesOnCell", mpas_tables(s)[2].where("indexToVertexID % 10 != 0").select(C("indexToVertexID").alias("vertex"), F.degrees("lonVertex").alias("lon"), F.degrees("latVertex").alias("lat"))).select("cell_id", F.round(C("ring")[2]["lon"], 6).alias("x"), F.round(C("ring")[2]["lat"], 6).alias("y"))
ORACLES["cvt_attr_cell"] = f"WITH {grids.GRID} SELECT cell_id, round(x1+0.5, 6) AS x, round(y1+0.5, 6) AS y FROM g WHERE ((r-1)*26+c) % 10 <> 0 AND ((r-1)*26+c+1) % 10 <> 0 AND (r*26+c) % 10 <> 0 AND (r*26+c+1) % 10 <> 0"


def _xyz(lon, lat, factor=2.0):
    x, y, z = geo.unit_xyz(lon, lat)
    return (x * factor).alias("x"), (y * factor).alias("y"), (z * factor).alias("z")


def _tin(spark, sf_dir):
    """A triangle round every second grid corner, from three cells each, within the boundaries; some lack a cell."""
    g = grid(spark)
    v = g.where("row < 25 AND col < 25").select(C("cell_id").alias("vertex"), *_xyz(C("lon") + 0.2, C("lat") + 0.2), F.array(C("cell_id"), C("cell_id") + 1, F.when(C("cell_id") % 9 == 0, 0).otherwise(C("cell_id") + 25)).alias("cellsOnVertex"))
    return importers.tin(v, g.select(C("cell_id").alias("cell"), *_xyz(C("lon"), C("lat"))))


QUERIES["mesh_tin"] = lambda s, d: _tin(s, d).select("cell_id", F.round("lon", 6).alias("lon"), F.round(C("ring")[1]["lon"], 6).alias("x"), F.round(C("ring")[2]["lat"], 6).alias("y"), F.round(C("area") / 1e6, 2).alias("km2"))
_r = [f"radians({x})" for x in ("x1+0.25", "y1+0.25", "x1+0.75", "y1+0.25", "x1+0.25", "y1+0.75")]
_vec = [[f"cos({b})*cos({a})", f"cos({b})*sin({a})", f"sin({b})"] for a, b in (_r[0:2], _r[2:4], _r[4:6])]
_d = lambda p, q: "(" + "+".join(f"{x}*{y}" for x, y in zip(p, q, strict=True)) + ")"
_side3 = [f"acos(least(1, {_d(_vec[i], _vec[j])}))" for i, j in ((1, 2), (0, 2), (0, 1))]
_s = f"(({'+'.join(_side3)})/2)"
_excess = f"4*atan(sqrt(greatest(0, tan({_s}/2)*" + "*".join(f"tan(({_s}-{a})/2)" for a in _side3) + ")))"
ORACLES["mesh_tin"] = f"WITH {grids.GRID} SELECT cell_id, round(x1+0.45, 6) AS lon, round(x1+0.75, 6) AS x, round(y1+0.75, 6) AS y, round({_excess}*6378137::DOUBLE*6378137/1000000, 2) AS km2 FROM g WHERE r < 25 AND c < 25 AND cell_id % 9 <> 0"
QUERIES["src_tin_nc"] = lambda s, d: _tin(s, d).select("cell_id", F.size("ring").cast("long").alias("corners"))
ORACLES["src_tin_nc"] = f"WITH {grids.GRID} SELECT cell_id, CAST(3 AS BIGINT) AS corners FROM g WHERE r < 25 AND c < 25 AND cell_id % 9 <> 0"


def _quads(spark, sf_dir):
    """The cubed sphere written as points and faces, and imported."""
    c = mesh.cubed_sphere(spark, 8)
    p = c.select("cell_id", F.posexplode("ring").alias("pos", "v")).withColumn("key", F.struct(*[F.round(x * 1e7).cast("long").alias(n) for n, x in zip("xyz", geo.unit_xyz(C("v.lon"), C("v.lat")), strict=True)]))
    names = p.groupBy("key").agg(F.min(F.struct("cell_id", "pos", "v")).alias("m")).select("key", (C("m.cell_id") * 10 + C("m.pos")).alias("point"), "m.v")
    faces = p.join(names.select("key", "point"), "key").groupBy(C("cell_id").alias("global_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "point"))).alias("l")).select("global_id", F.transform("l", lambda x: x["point"]).alias("connect"))
    return importers.quads(names.select("point", *_xyz(C("v.lon"), C("v.lat"), 1.0)), faces)


QUERIES["src_cubed_nc"] = lambda s, d: _quads(s, d).select("cell_id", F.size("ring").cast("long").alias("corners"), F.size("neighbors").cast("long").alias("n"))
ORACLES["src_cubed_nc"] = "SELECT i + 1 AS cell_id, CAST(4 AS BIGINT) AS corners, CAST(4 AS BIGINT) AS n FROM range(384) t(i)"


def _dggrid(spark, sf_dir):
    """The hexagons of odd number written as named features with all their neighbours, and imported."""
    path = shared_path(spark, "dggrid")
    named = hexagons(spark).select(C("cell_id").cast("string").alias("name"), F.to_json(F.transform("neighbors", lambda n: n.cast("string"))).alias("neighbors"), "ring").where("int(name) % 3 != 0")
    files.write_rings(named, path, ["name", "neighbors"])
    return importers.dggrid(spark, path, collection=False)


QUERIES["mesh_dggrid"] = QUERIES["src_dggrid_geojson"] = lambda s, d: _dggrid(s, d).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "neighbors", F.round(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), 1).alias("metres"))
ORACLES["mesh_dggrid"] = ORACLES["src_dggrid_geojson"] = f"""WITH {HEXES}, k AS (SELECT * FROM hx WHERE cell_id % 3 <> 0)
SELECT a.cell_id, round(a.x, 6) AS lon, round(a.y, 6) AS lat, coalesce(list(b.cell_id ORDER BY b.cell_id) FILTER (b.cell_id IS NOT NULL), []) AS neighbors, round(coalesce(sum({base.HAVERSINE.format('a.x', 'a.y', 'b.x', 'b.y')}), 0), 1) AS metres
FROM k a LEFT JOIN k b ON a.cell_id <> b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 1.1::DOUBLE*{_wide}*{_wide} GROUP BY a.cell_id, a.x, a.y"""
_n = mesh.faces_of(1.6e6)
QUERIES["mesh_cubedsphere"] = lambda s, d: importers.with_shared_neighbors(mesh.cubed_sphere(s, mesh.faces_of(1.6e6))).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.size("neighbors").cast("long").alias("n"), F.size("ring").cast("long").alias("corners"))
ORACLES["mesh_cubedsphere"] = f"""WITH g AS (SELECT k + 1 AS cell_id, (k - k % {_n * _n})/{_n * _n} AS f, tan((k % {_n} + 0.5)*pi()/{2 * _n} - pi()/4) AS a, tan((((k - k % {_n})/{_n})::BIGINT % {_n} + 0.5)*pi()/{2 * _n} - pi()/4) AS b FROM range({6 * _n * _n}) r(k)),
p AS (SELECT cell_id, CASE f WHEN 0 THEN 1 WHEN 1 THEN -a WHEN 2 THEN -1 WHEN 3 THEN a WHEN 4 THEN -b ELSE b END AS x, CASE f WHEN 0 THEN a WHEN 1 THEN 1 WHEN 2 THEN -a WHEN 3 THEN -1 ELSE a END AS y, CASE f WHEN 4 THEN 1 WHEN 5 THEN -1 ELSE b END AS z FROM g)
SELECT cell_id, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x*x + y*y))), 6) AS lat, CAST(4 AS BIGINT) AS n, CAST(4 AS BIGINT) AS corners FROM p"""
QUERIES["cvt_coords_cell"] = lambda s, d: hexagons(s).select("cell_id", geo.without_flat_corners(F.flatten(F.transform("ring", lambda p, i: F.when(i % 2 == C("cell_id") % 2, F.array(p, _between(p, F.element_at("ring", F.pmod(i + 1, F.lit(6)) + 1)))).otherwise(F.array(p))))).alias("ring")).select("cell_id", F.size("ring").cast("long").alias("corners"), F.round(C("ring")[5]["lon"], 6).alias("x"))
ORACLES["cvt_coords_cell"] = f"WITH {HEXES} SELECT cell_id, CAST(6 AS BIGINT) AS corners, round(x-{_wide}/2, 6) AS x FROM hx"


def _between(p, q):
    return F.struct(((p["lon"] + q["lon"]) / 2).alias("lon"), ((p["lat"] + q["lat"]) / 2).alias("lat"))


QUERIES["cvt_coords_line_pcs"] = lambda s, d: base.river(s, d).select("line", *[F.round(c, 6).alias(n) for c, n in zip(geo.from_mercator(*[F.round(x, 3) for x in geo.mercator(C("lon1"), C("lat1"))]), ("lon", "lat"), strict=True)])
ORACLES["cvt_coords_line_pcs"] = f"WITH {base.RIVER}, m AS (SELECT line, round(radians(lon1)*6378137, 3) AS x, round(ln(tan(pi()/4+radians(lat1)/2))*6378137, 3) AS y FROM l4) SELECT line, round(degrees(x/6378137), 6) AS lon, round(degrees(2*atan(exp(y/6378137))-pi()/2), 6) AS lat FROM m"
QUERIES["mesh_innerto"] = lambda s, d: overlay.inside_rings(grid(s).select(C("cell_id").alias("id"), "lon", "lat"), boundaries(s, d), 0.5).groupBy(C("id").alias("cell_id")).agg(F.max("polygon").alias("tag"))
ORACLES["mesh_innerto"] = f"WITH {base.CELLS}, {DIAMONDS} SELECT cell_id, max(polygon) AS tag FROM c5 JOIN dm ON abs(x1+0.25-cx) + abs(y1+0.25-cy) < r GROUP BY cell_id"
QUERIES["mesh_compose"] = lambda s, d: s.range(1).select(F.from_json(F.lit(importers.compose(spac_value=25.0)), "spac_value double, geom_mshID string, mesh_dims int, radii array<double>").alias("j")).select("j.*")
ORACLES["mesh_compose"] = "SELECT CAST(25 AS DOUBLE) AS spac_value, 'ellipsoid-mesh' AS \"geom_mshID\", 2 AS mesh_dims, [6371.0::DOUBLE, 6371.0::DOUBLE, 6371.0::DOUBLE] AS radii"
