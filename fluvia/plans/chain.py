"""Simplified, thinned and conceptual networks as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import case, hydro, network, reconstruct
from ..sources import config, shapefile
from . import base, lookups
from .iterate import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
XY = ("lon1", "lat1", "lon2", "lat2")


def river_points(spark, sf_dir):
    """The river's lines as points, every seventh the wrong way round."""
    r = base.river(spark, sf_dir)
    back = C("line") % 7 == 3
    end = lambda a, b: F.struct(*[F.when(back, C(f"{c}{b}")).otherwise(C(f"{c}{a}")).alias(c) for c in ("lon", "lat")])
    return r.select("line", "dam", F.posexplode(F.array(end(1, 2), end(2, 1))).alias("pos", "p")).select("line", C("pos").cast("long").alias("pos"), "p.lon", "p.lat", "dam")


MOUTH = (-80.0, 35.0)


# Ground truth without the river's geometry: merged chains of the tree, and orders from the top down.
SEGMENTS = f"""{base.RIVER}, kids AS (SELECT "end" AS k, count(*) AS n FROM l4 GROUP BY 1),
m AS (SELECT l4.line, l4.length, CASE WHEN kids.n = 1 AND l4."end" > 0 THEN l4."end" END AS down, l4."end" FROM l4 JOIN kids ON kids.k = l4."end"),
walk AS (SELECT line AS root, line, length FROM m WHERE down IS NULL UNION ALL SELECT w.root, m.line, m.length FROM walk w JOIN m ON m.down = w.line),
seg AS (SELECT root, round(sum(length), 0) AS length, count(*) AS parts FROM walk GROUP BY root)"""
def _shaped(spark, sf_dir):
    """The vertices and the length of each simplified segment, from its shape."""
    shape = reconstruct.simplified(river_points(spark, sf_dir), *MOUTH)[1]
    e = network.split_to_edges(shape, "line", ["pos"])
    return e.groupBy("line").agg(F.count("*").alias("edges"), F.round(F.sum(geo.haversine(*[C(c) for c in XY])), 0).alias("length")).groupBy("edges", "length").agg(F.count("*").alias("n"))


QUERIES["net_simplified"] = _shaped
ORACLES["net_simplified"] = f"WITH RECURSIVE {SEGMENTS} SELECT parts AS edges, length, count(*) AS n FROM seg GROUP BY ALL"


def _directed(spark, sf_dir):
    """The deep river, every seventh line turned back."""
    t = base.river(spark, sf_dir)
    turned = C("line") % 7 == 3
    mixed = t.select("line", F.when(turned, C("end")).otherwise(C("start")).alias("start"), F.when(turned, C("start")).otherwise(C("end")).alias("end"))
    return network.orient(mixed, 0).select("line", "start", "end", "turned")


QUERIES["net_direction_deep"] = _directed
ORACLES["net_direction_deep"] = f'WITH {base.RIVER} SELECT line, "start", "end", CASE WHEN line % 7 = 3 THEN 1 ELSE 0 END AS turned FROM l4'


def _shreve_deep(spark, sf_dir):
    return network.shreve(base.river(spark, sf_dir))


QUERIES["net_shreve_deep"] = _shreve_deep
ORACLES["net_shreve_deep"] = f"""WITH RECURSIVE {base.RIVER}, up AS (SELECT line AS head, line, "end" FROM l4 WHERE "start" NOT IN (SELECT "end" FROM l4) UNION ALL SELECT u.head, l.line, l."end" FROM up u JOIN l4 l ON l.line = u."end")
SELECT line, count(*) AS stream_order FROM up GROUP BY line"""


QUERIES["win_running_id"] = lambda s, d: network.running_id(base.scattered(s, d).select("line", "event_id", "ts"), ["line", "ts", "event_id"]).select("line", "event_id", "id")
ORACLES["win_running_id"] = f"WITH {base.SCATTERED} SELECT line, event_id, CAST(row_number() OVER (ORDER BY line, ts, event_id) AS BIGINT) AS id FROM v2"


def _added(spark, sf_dir):
    """The starts of even lines, and the ends of all lines that are not among them, each at its first line."""
    r = base.river(spark, sf_dir)
    known = r.where("line % 2 = 0").select(C("start").alias("vertex"), C("line").alias("place"))
    return network.add_unique(known, r.select(C("end").alias("vertex"), C("line").alias("place")))


QUERIES["set_add_unique"] = _added
ORACLES["set_add_unique"] = f"""WITH {base.RIVER}, k AS (SELECT "start" AS vertex, min(line) AS place FROM l4 WHERE line % 2 = 0 GROUP BY 1)
SELECT vertex, place, false AS added FROM k UNION ALL SELECT "end", min(line), true FROM l4 WHERE "end" NOT IN (SELECT vertex FROM k) GROUP BY 1"""


def _dams(spark, sf_dir):
    """From every 211th node downstream through both kinds of links, up to the network of nodes below 300."""
    r = base.river(spark, sf_dir)
    t = r.select(C("line").alias("from"), C("end").alias("to"))
    t = t.union(t.where("`from` % 50 = 0 AND `from` > 7").select("from", C("from") - 7))
    return network.trace_downstream(r.where("line % 211 = 0").select(C("line").alias("id")), t, spark.range(300))


QUERIES["net_dam_burn_16"], ORACLES["net_dam_burn_16"] = lookups.QUERIES["net_dam_burn"], lookups.ORACLES["net_dam_burn"]
QUERIES["net_dam_burn"] = _dams
ORACLES["net_dam_burn"] = f"""WITH RECURSIVE {base.RIVER}, t AS (SELECT k AS f, p AS t FROM f4 UNION ALL SELECT k, k - 7 FROM f4 WHERE k % 50 = 0 AND k > 7),
w AS (SELECT k AS id FROM f4 WHERE k % 211 = 0 AND k >= 300 UNION SELECT t.t FROM w JOIN t ON t.f = w.id WHERE t.t >= 300) SELECT id FROM w"""


def _topology(spark, sf_dir):
    """Segments of the balanced tree with the segments below and above them, by segment number."""
    t = base.shallow(spark, sf_dir)
    return network.segment_topology(t, network.segments(t))


QUERIES["net_topology"] = _topology
_seg_sql = f"""{base.SHALLOW}, path AS (SELECT k, p, lpad(CAST(k AS VARCHAR), 9, '0') AS way FROM f3 WHERE p = 0 UNION ALL SELECT f.k, f.p, path.way || '/' || lpad(CAST(f.k AS VARCHAR), 9, '0') FROM f3 f JOIN path ON f.p = path.k),
sg AS (SELECT k, p, CAST((SELECT count(*) FROM f3) + 1 - row_number() OVER (ORDER BY way) AS BIGINT) AS segment FROM path)"""
ORACLES["net_topology"] = f"""WITH RECURSIVE {_seg_sql} SELECT a.segment, any_value(b.segment) AS downstream, coalesce(list(c.segment ORDER BY c.segment) FILTER (c.segment IS NOT NULL), []) AS upstream
FROM sg a LEFT JOIN sg b ON b.k = a.p LEFT JOIN sg c ON c.p = a.k GROUP BY a.segment"""
QUERIES["net_split_edge_parts"] = lambda s, d: reconstruct.split_evenly(base.edges(s, d), 2_000_000.0).select("line", "pos", "part", F.round("lon1", 5).alias("lon1"), F.round("lat1", 5).alias("lat1"), F.round("lat2", 5).alias("lat2"))
_h = base.HAVERSINE.format("lon1", "lat1", "lon2", "lat2")
_vec = lambda a, b: [f"cos(radians({b}))*cos(radians({a}))", f"cos(radians({b}))*sin(radians({a}))", f"sin(radians({b}))"]
_sum = [f"({p}+{q})" for p, q in zip(_vec("x1", "y1"), _vec("x2", "y2"), strict=True)]
ORACLES["net_split_edge_parts"] = f"""WITH RECURSIVE {base.EDGES}, p AS (SELECT line, pos, 1::BIGINT AS part, lon1 AS x1, lat1 AS y1, lon2 AS x2, lat2 AS y2, greatest(0, ceil(log2({_h}/2000000))) AS k FROM e
UNION ALL SELECT line, pos, CASE WHEN h = 0 THEN part*2 - 1 ELSE part*2 END, CASE WHEN h = 0 THEN x1 ELSE mx END, CASE WHEN h = 0 THEN y1 ELSE my END, CASE WHEN h = 0 THEN mx ELSE x2 END, CASE WHEN h = 0 THEN my ELSE y2 END, k - 1
  FROM (SELECT *, degrees(atan2({_sum[1]}, {_sum[0]})) AS mx, degrees(atan2({_sum[2]}, sqrt({_sum[0]}*{_sum[0]}+{_sum[1]}*{_sum[1]}))) AS my FROM p WHERE k > 0), range(2) r(h))
SELECT line, pos, part, round(x1, 5) AS lon1, round(y1, 5) AS lat1, round(y2, 5) AS lat2 FROM p WHERE k <= 0"""


# What two lines enclose: a straight line each, and one that crosses it between all its places.
def _zigzag(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = base.table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w))
    lat = C("user_id") / 16.0
    up = (F.lit(1.0) + C("event_id") % 7) / 256.0 * F.when(C("i") % 2 == 0, 1).otherwise(-1)
    zig = v.select(C("user_id").alias("line"), C("i").cast("long").alias("pos"), (C("i") / 4.0).alias("lon"), (lat + up).alias("lat"))
    flat = v.groupBy(C("user_id").alias("line")).agg(F.max("i").alias("n")).select("line", F.explode(F.array(F.lit(0.0), F.lit(0.1), (C("n") + 1) / 4.0)).alias("lon"), (C("line") / 16.0).alias("lat"))
    straight = flat.withColumn("pos", F.row_number().over(Window.partitionBy("line").orderBy("lon")).cast("long"))
    return [network.split_to_edges(x, "line", ["pos"]) for x in (straight, zig)]


ZIG = """z AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id FROM events),
v AS (SELECT line, i, CAST(i AS DOUBLE)/4 AS x, CAST(line AS DOUBLE)/16 AS y0, (1.0::DOUBLE + event_id % 7)/256*CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS h FROM z),
c AS (SELECT line, i, x, y0, h, x - 0.25*abs(h)/(abs(lag(h) OVER w)+abs(h)) AS a, x + 0.25*abs(h)/(abs(lead(h) OVER w)+abs(h)) AS b FROM v WINDOW w AS (PARTITION BY line ORDER BY i)),
f AS (SELECT line, i, abs(radians(b-a)*(2+2*sin(radians(y0))) + radians(x-b)*(2+sin(radians(y0))+sin(radians(y0+h))) + radians(a-x)*(2+sin(radians(y0))+sin(radians(y0+h))))*pow(CAST(6378137 AS DOUBLE), 2)/2 AS area FROM c WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _faces(spark, sf_dir):
    a, b = _zigzag(spark, sf_dir)
    return reconstruct.faces(reconstruct.noded_edges(a, b, 0.25))


QUERIES["topo_area_diff"] = lambda s, d: _faces(s, d).select(F.round(C("area") / 1e6, 3).alias("km2")).groupBy("km2").agg(F.count("*").alias("n"))
ORACLES["topo_area_diff"] = f"WITH {ZIG} SELECT round(area/1000000, 3) AS km2, count(*) AS n FROM f GROUP BY 1"
QUERIES["agg_sum_area"] = lambda s, d: reconstruct.area_of_difference(*_zigzag(s, d), 0.25).select("faces", F.round(C("area") / 1e6, 1).alias("km2"))
ORACLES["agg_sum_area"] = f"WITH {ZIG} SELECT count(*) AS faces, round(coalesce(sum(area), 0)/1000000, 1) AS km2 FROM f"


# Worldwide lines: the river cut into basins, written with their attributes as shapefiles.
def _world(spark, sf_dir):
    r = base.river(spark, sf_dir)
    area = network.subtree_sum(r.withColumn("one", F.lit(1).cast("long")), "one").select("line", (C("total") * 25.0).alias("skm"))
    cut = C("line") % 89 == 0  # these lines end in the sea
    tree = r.withColumn("down", F.when(~cut, C("down")))
    root = network.jump(tree.withColumn("one", F.lit(1)), "one").select("line", "root")
    order = (C("line") % 4 + 1).alias("ORD_STRA")
    rows = tree.join(area, "line").join(root, "line").select(F.array(F.array(F.struct(C("lon1").alias("lon"), C("lat1").alias("lat")), F.struct(C("lon2").alias("lon"), C("lat2").alias("lat")))).alias("parts"), C("line").alias("HYRIV_ID"), C("root").alias("MAIN_RIV"), order, C("skm").alias("UPLAND_SKM"), F.coalesce("down", F.lit(0)).alias("NEXT_DOWN"), (C("line") % 3 == 0).cast("int").alias("ENDORHEIC"))
    path = shared_path(spark, "world")
    shapefile.write_shapes(rows.repartition(2), path, shapefile.LINE, rows.columns[1:])
    return hydro.read_world(spark, path)


QUERIES["src_hydroshed"] = lambda s, d: _world(s, d)[0].select("line", "down", F.round("area", 0).alias("area"), "endorheic", "stream_order")
WORLD = f"""{base.RIVER}, up AS (SELECT line AS a, line, "end" FROM l4 UNION ALL SELECT u.a, l.line, l."end" FROM up u JOIN l4 l ON l.line = u."end"),
ar AS (SELECT line, CAST(count(*) AS DOUBLE)*25000000 AS area FROM up GROUP BY line),
wl AS (SELECT l4.line, CASE WHEN l4.line % 89 <> 0 AND "end" > 0 THEN "end" END AS down, area, CASE WHEN l4.line % 3 = 0 THEN 1 ELSE 0 END AS endorheic, CAST(l4.line % 4 + 1 AS INTEGER) AS stream_order, lon2 AS lon, lat2 AS lat FROM l4 JOIN ar USING (line))"""
ORACLES["src_hydroshed"] = f"WITH RECURSIVE {WORLD} SELECT line, down, round(area, 0) AS area, endorheic, stream_order FROM wl"


def _outlets(spark, sf_dir):
    """Outlets of more than 50 km2 that stay apart by 150 km."""
    lines, vertices = _world(spark, sf_dir)
    big, _ = hydro.large_lines(lines, 5e7)
    ends = vertices.groupBy("line").agg(F.max_by(F.struct("lon", "lat"), "pos").alias("p")).select("line", "p.*")
    return hydro.thin_outlets(big.join(ends, "line").select("line", "lon", "lat", "area", "endorheic"), 150_000.0)


def _thinned(spark, sf_dir):
    return hydro.simplify_world(*_world(spark, sf_dir), 60_000.0, 3e7)


QUERIES["net_hydro_outlet_dedup"] = lambda s, d: _outlets(s, d).select("line", F.round("area", 0).alias("area"))
#: Greedy choices in order: tested against a plain version.
QUERIES["net_hydro_prune"] = lambda s, d: _thinned(s, d)["lines"].select("line", "basin", "stream_order")
QUERIES["net_hydro_simplify"] = lambda s, d: _thinned(s, d)["basins"].select("line", "rank", "exported", F.round("area", 0).alias("area"))


def small_case(**values):
    return config.template("case", **({"sMesh_type": "latlon", "dResolution_degree": 0.5, "dLongitude_left": -81, "dLongitude_right": -69, "dLatitude_bot": 34, "dLatitude_top": 46, "dResolution_meter": 60000} | values))


def _dispatched(spark, sf_dir):
    """The number of cells that each type of mesh takes for one domain, and the area they cover."""
    out = None
    for kind in ("latlon", "square", "hexagon", "triangular", "cubicsphere"):
        c = small_case(sMesh_type=kind, **({"dResolution_meter": 500_000} if kind == "cubicsphere" else {}))
        d = case.make_mesh(spark, c).agg(F.lit(kind).alias("kind"), F.count("*").alias("cells"), F.count_distinct("cell_id").alias("ids"))
        out = d if out is None else out.unionByName(d)
    return out


QUERIES["mesh_dispatch"] = _dispatched
_y = "ln(tan(pi()/4 + radians({0}::DOUBLE)/2))*6378137"
_size = "(60000/cos(radians(40::DOUBLE)))"
_w, _hh = f"(radians(12::DOUBLE)*6378137/{_size})", f"(({_y.format(46)} - {_y.format(34)})/{_size})"
_e, _sd = "sqrt(2/(3*sqrt(3::DOUBLE)))", "sqrt(4/sqrt(3::DOUBLE))"
_cube = "CAST(floor(2*pi()*6378137/4/500000) AS BIGINT)"
ORACLES["mesh_dispatch"] = f"""WITH k AS (SELECT 'latlon' AS kind, 24*24 AS cells UNION ALL SELECT 'square', (ceil({_hh})+1)*(ceil({_w})+1) UNION ALL SELECT 'hexagon', (ceil({_hh}/(1.5::DOUBLE*{_e}))+1)*(ceil({_w}/({_e}*sqrt(3::DOUBLE)))+1)
UNION ALL SELECT 'triangular', (ceil({_hh}/({_sd}*sqrt(3::DOUBLE)/2))+1)*(ceil({_w}/({_sd}/2))+1) UNION ALL SELECT 'cubicsphere', 6*{_cube}*{_cube}) SELECT kind, CAST(cells AS BIGINT) AS cells, CAST(cells AS BIGINT) AS ids FROM k"""


def _basin_run(spark, sf_dir):
    """The river through all stages on a mesh of half a degree."""
    c = small_case()
    mesh_cells = case.make_mesh(spark, c)
    basin = config.template("basin", dLongitude_outlet_degree=MOUTH[0], dLatitude_outlet_degree=MOUTH[1])
    return case.run_basin(river_points(spark, sf_dir), basin, mesh_cells, 1.0), mesh_cells


#: A chain of stages: tested against a plain version.
QUERIES["topo_conceptual"] = lambda s, d: _basin_run(s, d)[0]["segments"].select("segment", "stream_order", "downstream", F.round("length", 0).alias("length"))
QUERIES["run_stages"] = lambda s, d: case.lengths(_basin_run(s, d)[0]).select("network", "segments", F.round("length", 0).alias("length"), "orders")


def _evaluated(spark, sf_dir):
    found, mesh_cells = _basin_run(spark, sf_dir)
    return case.evaluate(found, mesh_cells, 1.0).select("faces", F.round(C("area") / 1e6, 0).alias("km2"), F.round("per_metre", 2).alias("per_metre"))


QUERIES["topo_evaluate"] = _evaluated
