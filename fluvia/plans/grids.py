"""Meshes and overlays as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mesh, network, overlay
from . import base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col


def _latlon(spark):
    return mesh.latlon(spark, -81.25, 34.0, 0.5, 25, 25)


GRID = base.CELLS + ", g AS (SELECT *, (cell_id - 1 - (cell_id - 1) % 25)/25 + 1 AS r, (cell_id - 1) % 25 + 1 AS c FROM c5)"
NEAR = GRID + ", n AS (SELECT a.cell_id, b.cell_id AS neighbor, a.x1 + 0.25 AS lon1, a.y1 + 0.25 AS lat1, b.x1 + 0.25 AS lon2, b.y1 + 0.25 AS lat2 FROM g a JOIN g b ON a.cell_id <> b.cell_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)"

QUERIES["mesh_latlon"] = lambda s, d: _latlon(s).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "neighbors")
ORACLES["mesh_latlon"] = f"WITH {NEAR} SELECT cell_id, round(lon1, 6) AS lon, round(lat1, 6) AS lat, list(neighbor ORDER BY neighbor) AS neighbors FROM n GROUP BY ALL"
QUERIES["mesh_square"] = lambda s, d: mesh.square(s, 0.0, 0.0, 5000.0, 20, 30).select("cell_id", "x", "y", F.size("neighbors").cast("long").alias("n"))
ORACLES["mesh_square"] = "WITH g AS (SELECT i + 1 AS cell_id, i % 30 AS c, (i - i % 30)/30 AS r FROM range(600) t(i)) SELECT cell_id, CAST(c*5000+2500 AS DOUBLE) AS x, CAST(r*5000+2500 AS DOUBLE) AS y, CAST((CASE WHEN c IN (0, 29) THEN 2 ELSE 3 END)*(CASE WHEN r IN (0, 19) THEN 2 ELSE 3 END)-1 AS BIGINT) AS n FROM g"
_edge, _wide = "sqrt(CAST(50000000 AS DOUBLE)/(3*sqrt(CAST(3 AS DOUBLE))))", "sqrt(CAST(50000000 AS DOUBLE)/(3*sqrt(CAST(3 AS DOUBLE))))*sqrt(CAST(3 AS DOUBLE))"
HEX = f"h AS (SELECT i + 1 AS cell_id, i % 30 + 1 AS c, (i - i % 30)/30 + 1 AS r, CAST(i % 30 AS DOUBLE)*{_wide} + CASE WHEN ((i - i % 30)/30 + 1) % 2 = 0 THEN {_wide}/2 ELSE 0 END AS x, CAST((i - i % 30)/30 AS DOUBLE)*1.5::DOUBLE*{_edge} AS y FROM range(600) t(i))"
QUERIES["mesh_hexagon"] = lambda s, d: mesh.hexagon(s, 0.0, 0.0, 5000.0, 20, 30).select("cell_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "neighbors")
ORACLES["mesh_hexagon"] = f"WITH {HEX} SELECT a.cell_id, round(a.x, 3) AS x, round(a.y, 3) AS y, list(b.cell_id ORDER BY b.cell_id) AS neighbors FROM h a JOIN h b ON a.cell_id <> b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 1.1::DOUBLE*{_wide}*{_wide} GROUP BY a.cell_id, a.x, a.y"
QUERIES["prd_share_edge"] = QUERIES["lookup_cells_by_edge"] = lambda s, d: mesh.shared_edges(mesh.hexagon(s, 0.0, 0.0, 5000.0, 20, 30))
ORACLES["prd_share_edge"] = ORACLES["lookup_cells_by_edge"] = f"WITH {HEX} SELECT a.cell_id AS a, b.cell_id AS b FROM h a JOIN h b ON a.cell_id < b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 1.1::DOUBLE*{_wide}*{_wide}"
_len = "sqrt(CAST(100000000 AS DOUBLE)/sqrt(CAST(3 AS DOUBLE)))"
QUERIES["mesh_triangular"] = lambda s, d: mesh.triangular(s, 0.0, 0.0, 5000.0, 20, 30).select("cell_id", F.round(C("ring")[0]["lon"], 3).alias("x"), F.round(C("ring")[0]["lat"], 3).alias("y"))
ORACLES["mesh_triangular"] = f"WITH t AS (SELECT i + 1 AS cell_id, i % 30 AS c, (i - i % 30)/30 AS r FROM range(600) x(i)) SELECT cell_id, round(CAST(c AS DOUBLE)*{_len}/2, 3) AS x, round((CAST(r AS DOUBLE) + CASE WHEN (r + c) % 2 = 0 THEN 0 ELSE 1 END)*{_len}*sqrt(CAST(3 AS DOUBLE))/2, 3) AS y FROM t"
QUERIES["join_self_neighbor"] = lambda s, d: mesh.neighbor_distance(_latlon(s), geo.haversine).select("cell_id", "neighbor", F.round("distance", 3).alias("distance"))
ORACLES["join_self_neighbor"] = f"WITH {NEAR} SELECT cell_id, neighbor, round({base.HAVERSINE.format('lon1', 'lat1', 'lon2', 'lat2')}, 3) AS distance FROM n"
QUERIES["geo_cell_area"] = lambda s, d: _latlon(s).select("cell_id", F.round(geo.ring_area(C("ring")), 0).alias("area"))
ORACLES["geo_cell_area"] = f"WITH {base.CELLS} SELECT cell_id, round(pow(CAST(6378137 AS DOUBLE), 2)*radians(CAST(0.5 AS DOUBLE))*(sin(radians(y1+0.5))-sin(radians(y1))), 0) AS area FROM c5"
QUERIES["agg_center_mean"] = lambda s, d: _latlon(s).select("cell_id", F.explode("ring").alias("p")).groupBy("cell_id").agg(F.round(F.avg("p.lon"), 6).alias("lon"), F.round(F.avg("p.lat"), 6).alias("lat"))
ORACLES["agg_center_mean"] = f"WITH {base.CELLS} SELECT cell_id, round(x1+0.25, 6) AS lon, round(y1+0.25, 6) AS lat FROM c5"


def _located(spark, sf_dir):
    return overlay.points_in_cells(base.walks(spark, sf_dir), base.cells(spark), 1.0).select("line", "event_id", "cell_id")


IN = f"{base.WALKS}, {base.CELLS}, j AS (SELECT w8.*, c5.cell_id FROM w8 JOIN c5 ON lon >= x1 AND lon < x1 + 0.5 AND lat >= y1 AND lat < y1 + 0.5)"
QUERIES["join_bbox_range"] = QUERIES["join_nested_loop"] = _located
ORACLES["join_bbox_range"] = ORACLES["join_nested_loop"] = f"WITH {IN} SELECT line, event_id, cell_id FROM j"
QUERIES["geo_pnpoly"] = lambda s, d: overlay.points_in_cells(base.walks(s, d), base.cells(s), 1.0).join(_latlon(s).select("cell_id", "ring"), "cell_id").select("event_id", geo.point_in_ring(C("lon"), C("lat"), C("ring")).alias("inside"))
ORACLES["geo_pnpoly"] = f"WITH {IN} SELECT event_id, true AS inside FROM j"
QUERIES["agg_count_reach"] = lambda s, d: _located(s, d).groupBy("cell_id").agg(F.count("*").alias("points"), F.count_distinct("line").alias("lines"))
ORACLES["agg_count_reach"] = f"WITH {IN} SELECT cell_id, count(*) AS points, count(DISTINCT line) AS lines FROM j GROUP BY cell_id"


def _walk_edges(spark, sf_dir):
    return network.split_to_edges(base.walks(spark, sf_dir), "line", ["pos"])


def _reaches(spark, sf_dir):
    """Each edge's part in each cell, with the length of the part."""
    d = overlay.edges_in_cells(_walk_edges(spark, sf_dir), base.cells(spark), 1.0)
    at = lambda t, a, b: C(a) + C(t) * (C(b) - C(a))
    length = geo.haversine(at("t0", "lon1", "lon2"), at("t0", "lat1", "lat2"), at("t1", "lon1", "lon2"), at("t1", "lat1", "lat2"))
    return d.select("line", "pos", "cell_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), F.round(length, 2).alias("length"))


_dx, _dy = "(lon2-lon1)", "(lat2-lat1)"


def _clip(axis: str, d: str, low: str, entering: bool) -> str:
    near, far = f"({low}-{axis})/{d}", f"({low}+0.5-{axis})/{d}"
    first, second = (near, far) if entering else (far, near)
    free = ("CAST(0 AS DOUBLE)", "CAST(2 AS DOUBLE)") if entering else ("CAST(1 AS DOUBLE)", "CAST(-1 AS DOUBLE)")
    return f"CASE WHEN {d} > 0 THEN {first} WHEN {d} < 0 THEN {second} WHEN {axis} >= {low} AND {axis} < {low}+0.5 THEN {free[0]} ELSE {free[1]} END"


REACH = f"""{base.WALKS}, {base.CELLS},
q AS (SELECT line, pos, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM w8 WINDOW w AS (PARTITION BY line ORDER BY pos)),
s AS (SELECT * FROM q WHERE lon2 IS NOT NULL AND (lon1 <> lon2 OR lat1 <> lat2)),
x AS (SELECT s.*, c5.cell_id, greatest(CAST(0 AS DOUBLE), {_clip("lon1", _dx, "x1", True)}, {_clip("lat1", _dy, "y1", True)}) AS t0,
  least(CAST(1 AS DOUBLE), {_clip("lon1", _dx, "x1", False)}, {_clip("lat1", _dy, "y1", False)}) AS t1
  FROM s JOIN c5 ON least(lon1, lon2) <= x1 + 0.5 AND greatest(lon1, lon2) >= x1 AND least(lat1, lat2) <= y1 + 0.5 AND greatest(lat1, lat2) >= y1),
r AS (SELECT line, pos, cell_id, t0, t1, {base.HAVERSINE.format("(lon1+t0*(lon2-lon1))", "(lat1+t0*(lat2-lat1))", "(lon1+t1*(lon2-lon1))", "(lat1+t1*(lat2-lat1))")} AS length FROM x WHERE t0 < t1)"""
QUERIES["topo_intersect_mesh"] = _reaches
ORACLES["topo_intersect_mesh"] = f"WITH {REACH} SELECT line, pos, cell_id, round(t0, 6) AS t0, round(t1, 6) AS t1, round(length, 2) AS length FROM r"
QUERIES["agg_max_reach"] = lambda s, d: _reaches(s, d).groupBy("cell_id").agg(F.max("length").alias("length"), F.count("*").alias("reaches"))
ORACLES["agg_max_reach"] = f"WITH {REACH} SELECT cell_id, max(round(length, 2)) AS length, count(*) AS reaches FROM r GROUP BY cell_id"
QUERIES["topo_cell_reach_len"] = lambda s, d: base.cells(s).select("cell_id").join(_reaches(s, d).groupBy("cell_id").agg(F.max("length").alias("length")), "cell_id", "left").select("cell_id", F.coalesce("length", F.lit(0.0)).alias("length"))
ORACLES["topo_cell_reach_len"] = f"WITH {REACH} SELECT c5.cell_id, coalesce(max(round(length, 2)), 0) AS length FROM c5 LEFT JOIN r ON r.cell_id = c5.cell_id GROUP BY c5.cell_id"


def _crossings(spark, sf_dir):
    """Crossings of the trajectories of even users with those of odd users."""
    e = _walk_edges(spark, sf_dir)
    d = overlay.crossings(e.where("line % 2 = 0"), e.where("line % 2 = 1"), 0.25)
    return d.select("a_line", "a_pos", "b_line", "b_pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


QUERIES["topo_intersect_line"] = _crossings
ORACLES["topo_intersect_line"] = f"""WITH {base.WALKS},
q AS (SELECT line, pos, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM w8 WINDOW w AS (PARTITION BY line ORDER BY pos)),
s AS (SELECT *, lon2-lon1 AS dx, lat2-lat1 AS dy FROM q WHERE lon2 IS NOT NULL AND (lon1 <> lon2 OR lat1 <> lat2)),
p AS (SELECT a.line AS a_line, a.pos AS a_pos, b.line AS b_line, b.pos AS b_pos, a.lon1, a.lat1, a.dx, a.dy, a.dx*b.dy-a.dy*b.dx AS c,
  (b.lon1-a.lon1)*b.dy-(b.lat1-a.lat1)*b.dx AS un, (b.lon1-a.lon1)*a.dy-(b.lat1-a.lat1)*a.dx AS vn
  FROM s a JOIN s b ON a.line % 2 = 0 AND b.line % 2 = 1 AND least(a.lon1, a.lon2) <= greatest(b.lon1, b.lon2) AND least(b.lon1, b.lon2) <= greatest(a.lon1, a.lon2)
    AND least(a.lat1, a.lat2) <= greatest(b.lat1, b.lat2) AND least(b.lat1, b.lat2) <= greatest(a.lat1, a.lat2))
SELECT a_line, a_pos, b_line, b_pos, round(lon1 + un/c*dx, 6) AS lon, round(lat1 + un/c*dy, 6) AS lat FROM p WHERE c <> 0 AND un/c > 0 AND un/c < 1 AND vn/c > 0 AND vn/c < 1"""
