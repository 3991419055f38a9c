"""Snapping, components, tags, burning and files as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mesh, network, overlay
from ..sources import files
from . import base, graph, grids
from .iterate import shared_path, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
_between = base.HAVERSINE.format("a.lon", "a.lat", "b.lon", "b.lat")
PLACES = f"{base.RIVER}, a AS (SELECT k AS id, lon, lat FROM n4), b AS (SELECT k AS other, lon, lat FROM n4)"


def _places(spark, sf_dir):
    return base.river(spark, sf_dir).select(C("line").alias("id"), C("lon1").alias("lon"), C("lat1").alias("lat"))


def _radius(spark, sf_dir):
    """Pairs of river nodes within 20 km; each node also meets itself."""
    p = _places(spark, sf_dir)
    return overlay.within(p, p.withColumnRenamed("id", "other"), 20_000.0).select("id", "other", F.round("distance", 2).alias("distance"))


QUERIES["join_point_radius"] = _radius
ORACLES["join_point_radius"] = f"WITH {PLACES} SELECT id, other, CASE WHEN id = other THEN CAST(0 AS DOUBLE) ELSE round({_between}, 2) END AS distance FROM a JOIN b ON abs(a.lat - b.lat) < 0.2 AND {_between} <= 20000 WHERE id > 0 AND other > 0"


def _dam_snap(spark, sf_dir):
    """Dams three millionths of a degree off their node, snapped to the first node within a metre."""
    p = _places(spark, sf_dir)
    dams = p.where("id % 11 = 0").withColumn("lon", C("lon") + 3e-6)
    return overlay.snap(dams, p.withColumnRenamed("id", "other"), 1.0)


QUERIES["join_dam_snap"] = _dam_snap
ORACLES["join_dam_snap"] = "SELECT c_custkey AS id, c_custkey AS other FROM customer WHERE c_custkey >= 1 AND c_custkey % 11 = 0"


def _components(spark, sf_dir):
    """Cells of equal mask that touch are one component; a cell without such a neighbour is its own."""
    g = mesh.latlon(spark, -81.25, 34.0, 0.5, 25, 25)
    mask = lambda c: F.pmod(c * 7919, F.lit(101)) % 3
    e = g.select(C("cell_id").alias("a"), F.explode("neighbors").alias("b")).where(mask(C("a")) == mask(C("b")))
    return g.select("cell_id").join(network.components(e).withColumnRenamed("node", "cell_id"), "cell_id", "left").select("cell_id", F.coalesce("root", "cell_id").alias("component"))


QUERIES["agg_components"] = _components
ORACLES["agg_components"] = f"""WITH RECURSIVE {grids.NEAR}, e AS (SELECT cell_id AS a, neighbor AS b FROM n WHERE (cell_id*7919) % 101 % 3 = (neighbor*7919) % 101 % 3),
r AS (SELECT cell_id, cell_id AS seen FROM c5 UNION SELECT r.cell_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT cell_id, min(seen) AS component FROM r GROUP BY cell_id"""


def _dam_burn(spark, sf_dir):
    """From every 211th node downstream through both kinds of links, up to the nodes that divide by 16."""
    k = C("line")
    t = base.river(spark, sf_dir).select(k.alias("from"), C("end").alias("to"))
    t = t.union(t.where("`from` % 50 = 0 AND `from` > 7").select("from", C("from") - 7))
    nodes = base.river(spark, sf_dir)
    return network.trace_downstream(nodes.where("line % 211 = 0").select(k.alias("id")), t, nodes.where("line % 16 = 0").select(k.alias("id")).union(spark.range(1)))


QUERIES["net_dam_burn"] = _dam_burn
ORACLES["net_dam_burn"] = f"""WITH RECURSIVE {base.RIVER}, t AS (SELECT k AS f, p AS t FROM f4 UNION ALL SELECT k, k - 7 FROM f4 WHERE k % 50 = 0 AND k > 7),
w AS (SELECT k AS id FROM f4 WHERE k % 211 = 0 AND k % 16 <> 0 UNION SELECT t.t FROM w JOIN t ON t.f = w.id WHERE t.t % 16 <> 0) SELECT id FROM w"""

QUERIES["mesh_hex_fill"] = lambda s, d: mesh.fill_holes(mesh.latlon(s, -81.25, 34.0, 0.5, 25, 25), base.cells(s).where("cell_id % 11 != 0 AND cell_id % 26 != 5")).withColumn("filled", C("filled").cast("long"))
ORACLES["mesh_hex_fill"] = f"""WITH {grids.NEAR}, k AS (SELECT cell_id FROM c5 WHERE cell_id % 11 <> 0 AND cell_id % 26 <> 5),
h AS (SELECT cell_id, min(neighbor) AS m FROM n WHERE cell_id IN (FROM k) AND neighbor NOT IN (FROM k) GROUP BY cell_id HAVING count(*) = 1)
SELECT cell_id, CAST(0 AS BIGINT) AS filled FROM k UNION ALL SELECT DISTINCT m, CAST(1 AS BIGINT) FROM h"""


def _spacing(spark, sf_dir):
    n = grids.QUERIES["agg_count_reach"](spark, sf_dir)
    return mesh.compose_spacing(base.cells(spark), [(n, 5000.0), (n.where("points > 10"), 2500.0), (n.where("lines > 1"), 4000.0)], 10_000.0)


QUERIES["agg_min_spacing"] = _spacing
ORACLES["agg_min_spacing"] = f"WITH {grids.IN}, n AS (SELECT cell_id, count(*) AS points, count(DISTINCT line) AS lines FROM j GROUP BY cell_id) SELECT c5.cell_id, CAST(CASE WHEN points > 10 THEN 2500 WHEN lines > 1 THEN 4000 WHEN points > 0 THEN 5000 ELSE 10000 END AS DOUBLE) AS spacing FROM c5 LEFT JOIN n ON n.cell_id = c5.cell_id"

QUERIES["mesh_cubedsphere"] = QUERIES["geo_cube_to_sphere"] = lambda s, d: mesh.cubed_sphere(s, 16).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
ORACLES["mesh_cubedsphere"] = ORACLES["geo_cube_to_sphere"] = """WITH g AS (SELECT k + 1 AS cell_id, (k - k % 256)/256 AS f, tan((k % 16 + 0.5)*pi()/32 - pi()/4) AS a, tan(((k - k % 16)/16 % 16 + 0.5)*pi()/32 - pi()/4) AS b FROM range(1536) r(k)),
p AS (SELECT cell_id, CASE f WHEN 0 THEN 1 WHEN 1 THEN -a WHEN 2 THEN -1 WHEN 3 THEN a WHEN 4 THEN -b ELSE b END AS x, CASE f WHEN 0 THEN a WHEN 1 THEN 1 WHEN 2 THEN -a WHEN 3 THEN -1 ELSE a END AS y, CASE f WHEN 4 THEN 1 WHEN 5 THEN -1 ELSE b END AS z FROM g)
SELECT cell_id, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x*x + y*y))), 6) AS lat FROM p"""


def _visits(spark, sf_dir):
    return overlay.points_in_cells(base.walks(spark, sf_dir), base.cells(spark), 1.0).select("line", "event_id", "pos", "cell_id")


def _erased(spark, sf_dir):
    """The cells that each trajectory visits, without its loops."""
    d = _visits(spark, sf_dir).groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell_id"))), lambda p: p["cell_id"]).alias("cells"))
    return d.select("line", overlay.erase_loops(C("cells")).alias("cells"))


QUERIES["topo_remove_returning"] = _erased
ORACLES["topo_remove_returning"] = f"""WITH RECURSIVE {grids.IN}, l AS (SELECT line, cell_id, max(pos) AS last FROM j GROUP BY ALL),
w AS (SELECT line, pos, cell_id FROM j WHERE pos = 1 UNION ALL SELECT j.line, j.pos, j.cell_id FROM w JOIN l ON l.line = w.line AND l.cell_id = w.cell_id JOIN j ON j.line = w.line AND j.pos = l.last + 1)
SELECT line, list(cell_id ORDER BY pos) AS cells FROM w GROUP BY line"""


def _steps(spark, sf_dir):
    """(event_id, line, cell_id, down): each step of a trajectory from one cell to another."""
    d = _visits(spark, sf_dir).withColumn("down", F.lead("cell_id").over(Window.partitionBy("line").orderBy("pos")))
    return d.where("down IS NOT NULL AND down != cell_id")


STEPS = f"{grids.IN}, q AS (SELECT event_id, line, cell_id, lead(cell_id) OVER (PARTITION BY line ORDER BY pos) AS down FROM j), s AS (SELECT * FROM q WHERE down <> cell_id)"


def _burn(spark, sf_dir):
    g = mesh.latlon(spark, -81.25, 34.0, 0.5, 25, 25).select("cell_id", "lon", "lat")
    to = g.select(C("cell_id").alias("down"), C("lon").alias("lon2"), C("lat").alias("lat2"))
    e = _steps(spark, sf_dir).join(g, "cell_id").join(to, "down")
    e = e.select(C("event_id").alias("pos"), C("line").alias("segment"), (C("line") % 3 + 1).alias("stream_order"), C("lon").alias("lon1"), C("lat").alias("lat1"), "lon2", "lat2")
    return overlay.burn(g, e)


QUERIES["topo_burn_cells"] = _burn
ORACLES["topo_burn_cells"] = f"""WITH {STEPS}, v AS (SELECT cell_id, arg_max(line, event_id) AS segment, arg_max(down, event_id) AS down FROM s GROUP BY cell_id)
SELECT c5.cell_id, coalesce(segment, -1) AS segment, coalesce(segment % 3 + 1, -1) AS stream_order, coalesce(down, -1) AS downstream FROM c5 LEFT JOIN v ON v.cell_id = c5.cell_id"""


def _merged_info(spark, sf_dir):
    """Cells beside the number of neighbours that the burnt table has downstream of them."""
    b = _burn(spark, sf_dir)
    up = b.where("downstream > 0").groupBy(C("downstream").alias("cell_id")).agg(F.count("*").alias("upstream"))
    return base.cells(spark).select("cell_id").join(up, "cell_id", "left").select("cell_id", F.coalesce("upstream", F.lit(0)).alias("upstream"))


QUERIES["join_cell_merge"] = _merged_info
ORACLES["join_cell_merge"] = f"SELECT a.cell_id, count(b.cell_id) AS upstream FROM ({ORACLES['topo_burn_cells']}) a LEFT JOIN ({ORACLES['topo_burn_cells']}) b ON b.downstream = a.cell_id GROUP BY a.cell_id"

QUERIES["agg_max_segment"] = lambda s, d: network.segments(base.shallow(s, d)).agg(F.max_by("line", "segment").alias("line"), F.max("segment").alias("segment"))
ORACLES["agg_max_segment"] = f"SELECT arg_max(line, segment) AS line, max(segment) AS segment FROM ({graph.ORACLES['net_segment']})"
QUERIES["agg_distinct_order"] = lambda s, d: network.strahler(base.shallow(s, d)).join(base.shallow(s, d), "line").groupBy(C("end").alias("vertex")).agg(F.count_distinct("stream_order").alias("orders"))
ORACLES["agg_distinct_order"] = f"SELECT CAST((line - line % 2)/2 AS BIGINT) AS vertex, count(DISTINCT stream_order) AS orders FROM ({graph.ORACLES['net_strahler']}) GROUP BY 1"
QUERIES["sort_argsort_order"] = lambda s, d: network.strahler(base.shallow(s, d)).join(base.shallow(s, d), "line").select("line", F.row_number().over(Window.partitionBy("end").orderBy("stream_order", "line")).cast("long").alias("visit"))
ORACLES["sort_argsort_order"] = f"SELECT line, CAST(row_number() OVER (PARTITION BY CAST((line - line % 2)/2 AS BIGINT) ORDER BY stream_order, line) AS BIGINT) AS visit FROM ({graph.ORACLES['net_strahler']})"


def _by_area(spark, sf_dir):
    """The branches that meet at a vertex, by the number of lines upstream, largest first."""
    t = base.shallow(spark, sf_dir)
    area = network.subtree_sum(t.withColumn("one", F.lit(1).cast("long")), "one")
    branch = F.struct((-C("total")).alias("a"), "line")
    d = t.join(area, "line").groupBy(C("end").alias("vertex")).agg(F.array_sort(F.collect_list(branch)).alias("b"))
    return d.select("vertex", F.transform("b", lambda x: x["line"]).alias("branches"))


QUERIES["sort_upstream_area"] = _by_area
ORACLES["sort_upstream_area"] = f"""WITH RECURSIVE {base.SHALLOW}, up AS (SELECT k AS k0, k, p FROM f3 UNION ALL SELECT u.k0, f.k, f.p FROM up u JOIN f3 f ON f.k = u.p),
a AS (SELECT k AS line, any_value(p) AS vertex, count(*) AS total FROM up GROUP BY k)
SELECT vertex, list(line ORDER BY total DESC, line) AS branches FROM a GROUP BY vertex"""
QUERIES["limit_noutlet"] = lambda s, d: base.table(s, d, "orders").groupBy(C("o_custkey").alias("basin")).agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "basin").limit(5)
ORACLES["limit_noutlet"] = "SELECT o_custkey AS basin, count(*) AS lines FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
QUERIES["agg_line_length"] = lambda s, d: base.edges(s, d).groupBy("line").agg(F.round(F.sum(geo.haversine(*[C(c) for c in ("lon1", "lat1", "lon2", "lat2")])) / 1000, 3).alias("km"))
ORACLES["agg_line_length"] = f"WITH {base.EDGES} SELECT line, round(sum({base.HAVERSINE.format('lon1', 'lat1', 'lon2', 'lat2')}) / 1000, 3) AS km FROM e GROUP BY line"
QUERIES["agg_max_tag"] = lambda s, d: base.river(s, d).select(F.explode(F.array("start", "end")).alias("node"), (C("line") % 7).alias("tag")).groupBy("node").agg(F.max("tag").alias("tag"))
ORACLES["agg_max_tag"] = f'WITH {base.RIVER} SELECT node, max(tag) AS tag FROM (SELECT "start" AS node, line % 7 AS tag FROM l4 UNION ALL SELECT "end", line % 7 FROM l4) GROUP BY node'
QUERIES["agg_largest_polygon"] = QUERIES["cvt_boundary"] = lambda s, d: mesh.latlon(s, -81.25, 34.0, 0.5, 25, 25).groupBy((C("cell_id") % 7).alias("polygon")).agg(F.max(F.struct(F.round(geo.ring_area(C("ring")), 0).alias("area"), C("cell_id"))).alias("m")).select("polygon", C("m.cell_id").alias("part"))
ORACLES["agg_largest_polygon"] = ORACLES["cvt_boundary"] = f"WITH {base.CELLS} SELECT cell_id % 7 AS polygon, arg_max(cell_id, row(-round(y1, 3), cell_id)) AS part FROM c5 GROUP BY 1"
QUERIES["set_union_distinct"] = lambda s, d: network.vertices(base.shallow(s, d)).unionByName(network.vertices(base.river(s, d))).dropDuplicates()
ORACLES["set_union_distinct"] = f'WITH {base.SHALLOW}, {base.RIVER} SELECT k AS vertex FROM f3 UNION SELECT p FROM f3 UNION SELECT "start" FROM l4 UNION SELECT "end" FROM l4'
QUERIES["win_split_points"] = lambda s, d: overlay.crossings(*[grids._walk_edges(s, d).where(f"line % 2 = {i}") for i in (0, 1)], 0.25).select("a_line", "a_pos", "b_line", "b_pos", F.row_number().over(Window.partitionBy("a_line", "a_pos").orderBy("u", "b_line", "b_pos")).cast("long").alias("nth"))
ORACLES["win_split_points"] = grids.ORACLES["topo_intersect_line"].replace("round(lon1 + un/c*dx, 6) AS lon, round(lat1 + un/c*dy, 6) AS lat", "CAST(row_number() OVER (PARTITION BY a_line, a_pos ORDER BY un/c, b_line, b_pos) AS BIGINT) AS nth")
QUERIES["prd_shared_vertex"] = lambda s, d: base.shallow(s, d).alias("a").join(base.shallow(s, d).alias("b"), C("b.line") == C("a.line") + 1).select(C("a.line").alias("line"), (C("a.start").isin(C("b.start"), C("b.end")) | C("a.end").isin(C("b.start"), C("b.end"))).cast("long").alias("shared"))
ORACLES["prd_shared_vertex"] = f"WITH {base.SHALLOW} SELECT a.k AS line, CAST(a.k IN (b.k, b.p) OR a.p IN (b.k, b.p) AS BIGINT) AS shared FROM f3 a JOIN f3 b ON b.k = a.k + 1"


def _same_lists(spark, sf_dir):
    """Orders of an even number whose multiset of line kinds an order of an odd number has too."""
    d = base.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(C("l_partkey") % 3)).alias("kinds"))
    return d.where("l_orderkey % 2 = 0").join(d.where("l_orderkey % 2 = 1").select("kinds"), "kinds", "left_semi").select("l_orderkey")


QUERIES["prd_list_in_list"] = _same_lists
ORACLES["prd_list_in_list"] = "WITH g AS (SELECT l_orderkey, list(l_partkey % 3 ORDER BY l_partkey % 3) AS kinds FROM lineitem GROUP BY 1) SELECT l_orderkey FROM g WHERE l_orderkey % 2 = 0 AND kinds IN (SELECT kinds FROM g WHERE l_orderkey % 2 = 1)"


def _has_edge(spark, sf_dir):
    """Which cells have the edge between cells 288 and 313."""
    g = mesh.latlon(spark, -81.25, 34.0, 0.5, 25, 25)
    a, b = (geo.vertex_key(F.lit(-81.25 + i / 2), F.lit(40.0)) for i in (12, 13))
    n, key = F.size("ring"), lambda p: geo.vertex_key(p["lon"], p["lat"])
    sides = F.transform("ring", lambda p, i: F.array_sort(F.array(key(p), key(F.element_at("ring", F.pmod(i + 1, n) + 1)))))
    return g.select("cell_id", F.array_contains(sides, F.array_sort(F.array(a, b))).alias("has"))


QUERIES["prd_cell_has_edge"] = _has_edge
ORACLES["prd_cell_has_edge"] = f"WITH {base.CELLS} SELECT cell_id, cell_id IN (288, 313) AS has FROM c5"
#: Several passes of removal, classification and merging: tested against a plain version.
QUERIES["net_small_river_loop"] = lambda s, d: network.small_river_rounds(base.river(s, d), 0, 400_000.0).select("line", "start", "end", F.round("length", 1).alias("length"), "dam")


def _line_file(spark, sf_dir):
    """The river lines written as GeoJSON and read back."""
    path = shared_path(spark, "lines")
    place = lambda i: F.struct(C(f"lon{i}").alias("lon"), C(f"lat{i}").alias("lat"))
    files.write_lines(base.river(spark, sf_dir).select("line", "dam", F.array(place(1), place(2)).alias("points")), path, ["line", "dam"])
    d, p = files.read_lines(spark, path, collection=False), C("points")
    return d.select(C("properties")["line"].cast("long").alias("line"), C("properties")["dam"].cast("int").alias("dam"), *[p[i - 1][c].alias(f"{c}{i}") for i in (1, 2) for c in ("lon", "lat")])


for _name in ("src_geojson_flowline", "snk_flowline_geojson", "cvt_flowline_geojson", "cvt_coords_line"):
    QUERIES[_name], ORACLES[_name] = _line_file, f"WITH {base.RIVER} SELECT line, dam, lon1, lat1, lon2, lat2 FROM l4"


def _ring_file(spark, sf_dir):
    """The cells written as GeoJSON and read back: four corners each."""
    path = shared_path(spark, "cells")
    files.write_rings(mesh.latlon(spark, -81.25, 34.0, 0.5, 25, 25), path, ["cell_id"])
    d = files.read_rings(spark, path, collection=False)
    return d.select(C("properties")["cell_id"].cast("long").alias("cell_id"), F.size("ring").cast("long").alias("corners"), C("ring")[0]["lon"].alias("x1"), C("ring")[0]["lat"].alias("y1"))


for _name in ("src_mesh_json", "snk_ring_geojson", "src_mesh_json_topo"):
    QUERIES[_name], ORACLES[_name] = _ring_file, f"WITH {base.CELLS} SELECT cell_id, CAST(4 AS BIGINT) AS corners, x1, y1 FROM c5"


def _vertex_file(spark, sf_dir):
    """The classified vertices written as points and read back."""
    path = shared_path(spark, "vertices")
    files.write_vertices(_places(spark, sf_dir), path, ["id"])
    at = F.from_json("coordinates", "array<double>")
    return files.read_features(spark, path, collection=False).select(C("properties")["id"].cast("long").alias("id"), at[0].alias("lon"), at[1].alias("lat"))


QUERIES["snk_vertex_geojson"] = _vertex_file
ORACLES["snk_vertex_geojson"] = f"WITH {base.RIVER} SELECT line AS id, lon1 AS lon, lat1 AS lat FROM l4"
QUERIES["snk_geoparquet"] = lambda s, d: written(mesh.latlon(s, -81.25, 34.0, 0.5, 25, 25), "mesh").select("cell_id", F.size("neighbors").cast("long").alias("n"))
ORACLES["snk_geoparquet"] = f"WITH {grids.NEAR} SELECT cell_id, count(*) AS n FROM n GROUP BY cell_id"


def _tables_csv(spark, sf_dir):
    """Links written as CSV and read back by place."""
    path = shared_path(spark, "links")
    base.river(spark, sf_dir).select("dam", "line", "end").write.option("header", True).csv(path)
    return files.read_topology(spark, path)


QUERIES["src_dam_csv"] = _tables_csv
ORACLES["src_dam_csv"] = f'WITH {base.RIVER} SELECT line AS "from", "end" AS "to" FROM l4'
QUERIES["snk_mesh_kml"] = lambda s, d: mesh.latlon(s, -81.25, 34.0, 0.5, 25, 25).select("cell_id", files.kml_placemark(C("cell_id"), C("ring")).alias("kml"))
_at = " || ' ' || ".join(f"CAST({x} AS VARCHAR) || ',' || CAST({y} AS VARCHAR)" for x, y in (("x1", "y1"), ("x1+0.5", "y1"), ("x1+0.5", "y1+0.5"), ("x1", "y1+0.5"), ("x1", "y1")))
ORACLES["snk_mesh_kml"] = f"WITH {base.CELLS} SELECT cell_id, '<Placemark><name>' || cell_id || '</name><Polygon><outerBoundaryIs><LinearRing><coordinates>' || {_at} || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS kml FROM c5"
