"""Hulls, distances, equality and lookups as queries; lattice walks have exact coordinates, with touches and lines that run together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import importers, mesh, network, overlay, reconstruct, shapes
from . import base, geometry, grids

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
XY = ("lon1", "lat1", "lon2", "lat2")


def lattice(spark, sf_dir):
    """Walks on a lattice of a sixteenth of a degree."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    move = lambda k: F.floor(F.sum((C("event_id") * k) % 2001 - 1000).over(w) / 1250).cast("double") / 16.0
    u = C("user_id")
    return base.table(spark, sf_dir, "events").select(
        u.alias("line"), "event_id", F.row_number().over(w).cast("long").alias("pos"),
        ((u % 10 - 80).cast("double") + move(7919)).alias("lon"), ((F.floor(u / 10) % 10 + 35).cast("double") + move(104729)).alias("lat"),
    )


LATTICE = """
k8 AS (SELECT user_id AS line, event_id, CAST(row_number() OVER w AS BIGINT) AS pos,
  CAST(-80 + user_id % 10 AS DOUBLE) + floor(CAST(CAST(sum((event_id*7919)%2001-1000) OVER w AS BIGINT) AS DOUBLE)/CAST(1250 AS DOUBLE))/CAST(16 AS DOUBLE) AS lon,
  CAST(35 + CAST(floor(user_id/10) AS BIGINT) % 10 AS DOUBLE) + floor(CAST(CAST(sum((event_id*104729)%2001-1000) OVER w AS BIGINT) AS DOUBLE)/CAST(1250 AS DOUBLE))/CAST(16 AS DOUBLE) AS lat
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q8 AS (SELECT line, pos, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM k8 WINDOW w AS (PARTITION BY line ORDER BY pos)),
e8 AS (SELECT * FROM q8 WHERE lon2 IS NOT NULL AND (lon1 <> lon2 OR lat1 <> lat2))"""


def lattice_edges(spark, sf_dir):
    return network.split_to_edges(lattice(spark, sf_dir), "line", ["pos"])


def _plane(spark, sf_dir):
    """How far each inner vertex lies from the plane through it and its neighbours."""
    e = [C(c) for c in ("lon1", "lat1", "lon", "lat", "lon2", "lat2")]
    return base.triples(spark, sf_dir).select("line", "event_id", F.round(geo.plane_distance(*e), 6).alias("distance"))


_u = [f"({b}-{a})" for a, b in zip(geometry._vec("lon1", "lat1"), geometry._vec("lon", "lat"), strict=True)]
_v = [f"({b}-{a})" for a, b in zip(geometry._vec("lon1", "lat1"), geometry._vec("lon2", "lat2"), strict=True)]
_n = [f"({_u[(i + 1) % 3]}*{_v[(i + 2) % 3]}-{_u[(i + 2) % 3]}*{_v[(i + 1) % 3]})" for i in range(3)]
_size = "sqrt(" + "+".join(f"{x}*{x}" for x in _n) + ")"
QUERIES["geo_dist_to_plane"] = _plane
ORACLES["geo_dist_to_plane"] = f"WITH {base.TRIPLES} SELECT line, event_id, CASE WHEN {_size} > 0 THEN abs(round(({'+'.join(f'{a}*{b}' for a, b in zip(_n, _u, strict=True))})/{_size}, 6)) END AS distance FROM t"


def _hulls(spark, sf_dir):
    """The corners of each walk's convex hull."""
    h = shapes.convex_hulls(lattice(spark, sf_dir).select(C("line").alias("id"), "lon", "lat"))
    return h.select(C("id").alias("line"), F.explode("ring").alias("p")).select("line", "p.lon", "p.lat")


QUERIES["geo_convex_hull"] = _hulls
ORACLES["geo_convex_hull"] = f"""WITH {LATTICE}, p AS (SELECT DISTINCT line, lon, lat FROM k8),
n AS (SELECT a.line, a.lon, a.lat, b.lon AS bx, b.lat AS by FROM p a JOIN p b ON a.line = b.line AND (a.lon <> b.lon OR a.lat <> b.lat)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.line = a.line AND ((b.lon-a.lon)*(c.lat-a.lat)-(b.lat-a.lat)*(c.lon-a.lon) < 0
    OR ((b.lon-a.lon)*(c.lat-a.lat)-(b.lat-a.lat)*(c.lon-a.lon) = 0 AND ((b.lon-a.lon)*(c.lon-a.lon)+(b.lat-a.lat)*(c.lat-a.lat) < 0
      OR (b.lon-a.lon)*(c.lon-a.lon)+(b.lat-a.lat)*(c.lat-a.lat) > (b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat))))))
SELECT line, lon, lat FROM n UNION SELECT line, lon, lat FROM p WHERE line IN (SELECT line FROM p GROUP BY line HAVING count(*) = 1)"""


def _point_line(spark, sf_dir):
    """From the first place of each user to the line of the next."""
    first = base.scattered(spark, sf_dir).groupBy(C("line").alias("id")).agg(F.min_by(F.struct("lon", "lat"), F.struct("ts", "event_id")).alias("p"))
    d = shapes.point_line_distance(first.select("id", "p.*", (C("id") + 1).alias("line")), base.edges(spark, sf_dir))
    return d.select("id", "line", F.round("distance", 2).alias("distance"))


QUERIES["geo_dist_point_line"] = _point_line
ORACLES["geo_dist_point_line"] = f"""WITH {base.EDGES}, f AS (SELECT line AS id, arg_min(lon, (ts, event_id)) AS lon, arg_min(lat, (ts, event_id)) AS lat FROM v2 GROUP BY line),
j AS (SELECT f.id, e.line, f.lon, f.lat, lon1, lat1, lon2, lat2 FROM f JOIN e ON e.line = f.id + 1)
SELECT id, line, round(min({geometry.POINT_EDGE}), 2) AS distance FROM j GROUP BY id, line"""


def _line_line(spark, sf_dir):
    """The least distance of the vertices of neighbouring users."""
    v = base.scattered(spark, sf_dir).select("line", "lon", "lat")
    pairs = v.select(C("line").alias("a"), (C("line") + 1).alias("b")).distinct()
    return shapes.line_line_distance(pairs, v).select("a", "b", F.round("distance", 3).alias("distance"))


QUERIES["geo_dist_line_line"] = _line_line
ORACLES["geo_dist_line_line"] = f"WITH {base.SCATTERED} SELECT x.line AS a, y.line AS b, round(min({base.HAVERSINE.format('x.lon', 'x.lat', 'y.lon', 'y.lat')}), 3) AS distance FROM v2 x JOIN v2 y ON y.line = x.line + 1 GROUP BY x.line, y.line"


def _matrix(spark, sf_dir):
    """The distances of each line's first three places to its last two."""
    w = Window.partitionBy("line").orderBy("ts", "event_id")
    d = base.scattered(spark, sf_dir).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("line"))).where("i <= 3 OR i > n - 2")
    pick = lambda when: F.array_sort(F.collect_list(F.when(F.expr(when), F.struct("i", "lon", "lat"))))
    g = d.groupBy("line").agg(pick("i <= 3").alias("a"), pick("i > n - 2").alias("b"))
    return g.select("line", F.transform(F.flatten(shapes.distance_matrix(C("a"), C("b"))), lambda x: F.round(x, 2)).alias("metres"))


QUERIES["geo_haversine_np"] = _matrix
ORACLES["geo_haversine_np"] = f"""WITH {base.SCATTERED}, r AS (SELECT line, lon, lat, row_number() OVER (PARTITION BY line ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY line) AS n FROM v2)
SELECT a.line, list(round({base.HAVERSINE.format('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 2) ORDER BY a.i, b.i) AS metres FROM r a JOIN r b ON a.line = b.line AND a.i <= 3 AND b.i > b.n - 2 GROUP BY a.line"""


def _gaps(spark, sf_dir):
    """River lines lengthened to every 13th node, moved by up to 30 km."""
    r = base.river(spark, sf_dir)
    places = r.where("line % 13 = 0").select(C("line").alias("place"), (C("lon1") + (C("line") % 5) / 20.0).alias("lon"), C("lat1").alias("lat"), ((C("line") % 4 + 1) * 5000.0).alias("metres"))
    return shapes.connect_gaps(r.select("line", *XY), places, 20_000.0)


QUERIES["net_connect_gap"] = _gaps
ORACLES["net_connect_gap"] = f"""WITH {base.RIVER}, p AS (SELECT line AS place, lon1 + CAST(line % 5 AS DOUBLE)/20 AS lon, lat1 AS lat, CAST((line % 4 + 1)*5000 AS DOUBLE) AS metres FROM l4 WHERE line % 13 = 0),
e AS (SELECT line, 0 AS side, lon1 AS x, lat1 AS y FROM l4 UNION ALL SELECT line, 1, lon2, lat2 FROM l4),
n AS (SELECT e.line, p.place, e.side FROM e JOIN p ON abs(p.lat - e.y) < 0.2 AND {base.HAVERSINE.format('e.x', 'e.y', 'p.lon', 'p.lat')} < p.metres),
m AS (SELECT line, place, side FROM n QUALIFY row_number() OVER (PARTITION BY line ORDER BY place, side) = 1)
SELECT line, place, CASE side WHEN 0 THEN 'start' ELSE 'end' END AS "at" FROM m"""


def _halved(spark, sf_dir):
    """Trajectories halved until a piece is 50,000 km or less."""
    d = reconstruct.split_lines(base.edges(spark, sf_dir), 50_000_000.0)
    return d.select("line", "piece", "edges", F.round("length", 1).alias("length"))


QUERIES["net_split_line_len"] = _halved
ORACLES["net_split_line_len"] = f"""WITH RECURSIVE {base.EDGES}, n AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY pos) AS i, {base.HAVERSINE.format('lon1', 'lat1', 'lon2', 'lat2')} AS l FROM e),
c AS (SELECT line, i, sum(l) OVER (PARTITION BY line ORDER BY i) AS s FROM n UNION ALL SELECT DISTINCT line, 0, CAST(0 AS DOUBLE) FROM n),
h AS (SELECT c.line, '1' AS piece, 0 AS a, max(c.i) AS b, max(s) AS l FROM c GROUP BY c.line
  UNION ALL SELECT h.line, h.piece || x.d, x.a, x.b, cb.s - ca.s FROM h, LATERAL (SELECT '0' AS d, h.a AS a, h.a + (h.b-h.a-(h.b-h.a)%2)/2 AS b UNION ALL SELECT '1', h.a + (h.b-h.a-(h.b-h.a)%2)/2, h.b) x
    JOIN c ca ON ca.line = h.line AND ca.i = x.a JOIN c cb ON cb.line = h.line AND cb.i = x.b WHERE h.l > 50000000 AND h.b - h.a > 1)
SELECT line, piece, CAST(b - a AS BIGINT) AS edges, round(l, 1) AS length FROM h WHERE l <= 50000000 OR b - a = 1"""


def _divided(spark, sf_dir):
    """River lines halved until a part is shorter than 4/3 of a spacing of 60 to 100 km: number and greatest length of the parts."""
    r = base.river(spark, sf_dir)
    d = shapes.divide_edges(r.select("line", F.lit(1).cast("long").alias("pos"), *XY), r.select("line", ((C("line") % 3) * 20_000.0 + 60_000.0).alias("spacing")))
    g = d.groupBy("line").agg(F.count("*").alias("parts"), F.max(geo.haversine(*[C(c) for c in XY])).alias("m"))
    return g.select("line", "parts", F.round("m", 2).alias("length"))


QUERIES["mesh_divide"] = _divided
_k = "greatest(0, floor(log2(length/((CAST(line % 3 AS DOUBLE)*20000 + 60000)*4/3))) + 1)"
ORACLES["mesh_divide"] = f"WITH {base.RIVER} SELECT line, CAST(pow(2, {_k}) AS BIGINT) AS parts, round(length/pow(2, {_k}), 2) AS length FROM l4"


def _zipped(spark, sf_dir):
    """Cell centres farther than 50 km from all places of the river."""
    g = mesh.latlon(spark, -81.25, 34.0, 0.5, 25, 25).select(C("cell_id").alias("id"), "lon", "lat")
    return shapes.far_from(g, base.river(spark, sf_dir).select(C("line").alias("other"), C("lon1").alias("lon"), C("lat1").alias("lat")), 50_000.0).select(C("id").alias("cell_id"))


QUERIES["mesh_zipnear"] = _zipped
ORACLES["mesh_zipnear"] = f"WITH {base.RIVER}, {base.CELLS} SELECT cell_id FROM c5 WHERE NOT EXISTS (SELECT 1 FROM l4 WHERE {base.HAVERSINE.format('c5.x1+0.25', 'c5.y1+0.25', 'l4.lon1', 'l4.lat1')} <= 50000)"


def _meetings(spark, sf_dir):
    """Where lattice walks of even users meet those of odd ones."""
    e = lattice_edges(spark, sf_dir)
    d = overlay.meetings(e.where("line % 2 = 0"), e.where("line % 2 = 1"), 0.25)
    return d.select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "line")


QUERIES["topo_intersect_line"] = _meetings
ORACLES["topo_intersect_line"] = f"""WITH {LATTICE}, s AS (SELECT *, lon2-lon1 AS dx, lat2-lat1 AS dy FROM e8),
p AS (SELECT b.line, a.lon1 AS x, a.lat1 AS y, a.dx, a.dy, a.dx*b.dy-a.dy*b.dx AS c, (b.lon1-a.lon1)*b.dy-(b.lat1-a.lat1)*b.dx AS un, (b.lon1-a.lon1)*a.dy-(b.lat1-a.lat1)*a.dx AS vn,
  (b.lon1-a.lon1)*a.dx+(b.lat1-a.lat1)*a.dy AS f, (b.lon2-a.lon1)*a.dx+(b.lat2-a.lat1)*a.dy AS g, a.dx*a.dx+a.dy*a.dy AS q
  FROM s a JOIN s b ON a.line % 2 = 0 AND b.line % 2 = 1 AND least(a.lon1, a.lon2) <= greatest(b.lon1, b.lon2) AND least(b.lon1, b.lon2) <= greatest(a.lon1, a.lon2)
    AND least(a.lat1, a.lat2) <= greatest(b.lat1, b.lat2) AND least(b.lat1, b.lat2) <= greatest(a.lat1, a.lat2)),
m AS (SELECT line, x, y, dx, dy, CASE WHEN c <> 0 THEN CASE WHEN un/c BETWEEN 0 AND 1 AND vn/c BETWEEN 0 AND 1 THEN un/c END
  WHEN vn = 0 AND greatest(least(f, g), 0) <= least(greatest(f, g), q) THEN greatest(least(f, g), 0)/q END AS u FROM p)
SELECT round(x + u*dx, 6) AS lon, round(y + u*dy, 6) AS lat, min(line) AS line FROM m WHERE u IS NOT NULL GROUP BY ALL"""
QUERIES["topo_cross_line"], ORACLES["topo_cross_line"] = grids.QUERIES["topo_intersect_line"], grids.ORACLES["topo_intersect_line"]

_L = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]


def _positions(spark, sf_dir):
    """Inside, on the border or outside of an L; coordinates in quarters."""
    at = base.table(spark, sf_dir, "events").select("event_id", ((C("event_id") * 7) % 21 / 4.0 - 0.5).alias("lon"), (F.floor(C("event_id") / 21) % 21 / 4.0 - 0.5).alias("lat"))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in _L])
    return at.select("event_id", geo.ring_position(C("lon"), C("lat"), ring).cast("long").alias("place"), geo.side_at(C("lon"), C("lat"), ring).cast("long").alias("side"))


_at = "p AS (SELECT event_id, CAST((event_id*7)%21 AS DOUBLE)/4 - 0.5 AS x, CAST(CAST(floor(event_id/21) AS BIGINT)%21 AS DOUBLE)/4 - 0.5 AS y FROM events)"
QUERIES["geo_pnpoly"] = _positions
ORACLES["geo_pnpoly"] = f"""WITH {_at}, s AS (SELECT event_id, x > 0 AND y > 0 AND ((x < 4 AND y < 2) OR (x < 2 AND y < 4)) AS inside, x >= 0 AND y >= 0 AND ((x <= 4 AND y <= 2) OR (x <= 2 AND y <= 4)) AS near, x, y FROM p)
SELECT event_id, CAST(CASE WHEN inside THEN 1 WHEN near THEN 0 ELSE -1 END AS BIGINT) AS place, CAST(CASE WHEN y = 0 AND x BETWEEN 0 AND 4 THEN 0 WHEN x = 4 AND y BETWEEN 0 AND 2 THEN 1 WHEN y = 2 AND x BETWEEN 2 AND 4 THEN 2
  WHEN x = 2 AND y BETWEEN 2 AND 4 THEN 3 WHEN y = 4 AND x BETWEEN 0 AND 2 THEN 4 WHEN x = 0 AND y BETWEEN 0 AND 4 THEN 5 ELSE -1 END AS BIGINT) AS side FROM s"""
QUERIES["prd_cell_edge_at_vertex"] = lambda s, d: lattice(s, d).withColumn("half", F.floor(C("lon") * 2)).join(mesh.latlon(s, -81.25, 34.0, 0.5, 25, 25).select("cell_id", "ring", F.col("ring")[0]["lon"].alias("x"), F.col("ring")[0]["lat"].alias("y")), F.expr("lon >= x AND lon <= x + 0.5 AND lat >= y AND lat <= y + 0.5")).select("line", "event_id", "cell_id", geo.side_at(C("lon"), C("lat"), C("ring")).cast("long").alias("side"))
ORACLES["prd_cell_edge_at_vertex"] = f"""WITH {LATTICE}, {base.CELLS} SELECT line, event_id, cell_id, CAST(CASE WHEN lat = y1 THEN 0 WHEN lon = x1 + 0.5 THEN 1 WHEN lat = y1 + 0.5 THEN 2 WHEN lon = x1 THEN 3 ELSE -1 END AS BIGINT) AS side
FROM k8 JOIN c5 ON lon BETWEEN x1 AND x1 + 0.5 AND lat BETWEEN y1 AND y1 + 0.5"""


def _same_places(spark, sf_dir):
    """Places that are equal to those of a copy moved by multiples of 4e-10 degrees."""
    p = base.scattered(spark, sf_dir).select("event_id", "lon", "lat")
    moved = p.select(C("event_id").alias("other"), (C("lon") + (C("event_id") % 5) * 4e-10).alias("x"), (C("lat") - (C("event_id") % 4) * 4e-10).alias("y"))
    key, keys = geo.tolerance_keys(C("lon"), C("lat"))[0], geo.tolerance_keys(C("x"), C("y"))[1]
    j = p.withColumn("k", key).join(moved.withColumn("k", F.explode(keys)), "k")
    return j.where(geo.same_vertex(C("lon"), C("lat"), C("x"), C("y"))).select("event_id", "other")


QUERIES["prd_vertex_eq"] = _same_places
ORACLES["prd_vertex_eq"] = f"WITH {base.SCATTERED}, p AS (SELECT * FROM v2) SELECT a.event_id, b.event_id AS other FROM p a JOIN p b ON a.lon = b.lon AND a.lat = b.lat WHERE b.event_id % 5 < 3 AND b.event_id % 4 < 3"
QUERIES["prd_edge_eq"] = lambda s, d: lattice_edges(s, d).groupBy(geo.vertex_key(C("lon1"), C("lat1")).alias("a"), geo.vertex_key(C("lon2"), C("lat2")).alias("b")).agg(F.min(F.struct("line", "pos")).alias("m"), F.count("*").alias("n")).select("m.line", "m.pos", "n")
ORACLES["prd_edge_eq"] = f"WITH {LATTICE} SELECT arg_min(line, (line, pos)) AS line, arg_min(pos, (line, pos)) AS pos, count(*) AS n FROM e8 GROUP BY lon1, lat1, lon2, lat2"


def _overlaps(spark, sf_dir):
    """Edges that lie on each other, whichever way they run."""
    a, b = geo.vertex_key(C("lon1"), C("lat1")), geo.vertex_key(C("lon2"), C("lat2"))
    g = lattice_edges(spark, sf_dir).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.min(F.struct("line", "pos")).alias("m"), F.count("*").alias("n"), F.count_distinct(a).alias("ways"))
    return g.select("m.line", "m.pos", "n", "ways")


QUERIES["prd_edge_overlap"] = _overlaps
ORACLES["prd_edge_overlap"] = f"""WITH {LATTICE}, k AS (SELECT *, CASE WHEN (lon1, lat1) <= (lon2, lat2) THEN (lon1, lat1, lon2, lat2) ELSE (lon2, lat2, lon1, lat1) END AS k FROM e8)
SELECT arg_min(line, (line, pos)) AS line, arg_min(pos, (line, pos)) AS pos, count(*) AS n, count(DISTINCT (lon1, lat1)) AS ways FROM k GROUP BY k"""


def _small_lines(spark, sf_dir):
    """Each order's items as a line on a lattice of four places."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    d = base.table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))
    return d.select(C("l_orderkey").alias("line"), "i", (C("l_partkey") % 2).cast("double").alias("lon"), (C("l_suppkey") % 2).cast("double").alias("lat"))


def _equal_lines(spark, sf_dir):
    """Lines with the first line that is equal to them."""
    p = network.line_prints(_small_lines(spark, sf_dir), "line", ["i"])
    first = p.groupBy("points", "print").agg(F.min("line").alias("first"))
    return p.join(first, ["points", "print"]).select("line", "first")


QUERIES["prd_line_eq"] = _equal_lines
_short = "o AS (SELECT l_orderkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i, l_partkey % 2 AS x, l_suppkey % 2 AS y FROM lineitem), s AS (SELECT line, list((x, y) ORDER BY i) AS shape FROM o GROUP BY line)"
ORACLES["prd_line_eq"] = f"WITH {_short} SELECT line, min(line) OVER (PARTITION BY shape) AS first FROM s"
QUERIES["set_distinct_line"] = lambda s, d: network.line_prints(_small_lines(s, d), "line", ["i"]).groupBy("points", "print").agg(F.min("line").alias("line")).select("line", C("points").cast("long").alias("points"))
ORACLES["set_distinct_line"] = f"WITH {_short} SELECT min(line) AS line, CAST(len(shape) AS BIGINT) AS points FROM s GROUP BY shape"
QUERIES["prd_upstream"] = lambda s, d: base.river(s, d).select("line", C("start").alias("v")).join(base.river(s, d).select(C("line").alias("up"), C("end").alias("v")), "v").select("line", "up")
ORACLES["prd_upstream"] = f'WITH {base.RIVER} SELECT a.line, b.line AS up FROM l4 a JOIN l4 b ON b."end" = a."start"'
QUERIES["prd_downstream"] = lambda s, d: base.river(s, d).select("line", C("end").alias("v")).join(base.river(s, d).select(C("line").alias("below"), C("start").alias("v")), "v").select("line", "below")
ORACLES["prd_downstream"] = f'WITH {base.RIVER} SELECT a.line, b.line AS below FROM l4 a JOIN l4 b ON b."start" = a."end"'


def _marks(spark, sf_dir):
    """A mark that some events set, clear or turn, before each event of a user."""
    k = C("event_id") % 7
    d = base.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", k.alias("k"))
    return network.carried_mark(d, ["user_id"], [C("ts"), C("event_id")], F.when(C("k") == 1, 1).when(C("k") == 2, 0), C("k").isin(3, 4)).select("event_id", "mark")


QUERIES["win_prev_overlap"] = _marks
ORACLES["win_prev_overlap"] = """WITH k AS (SELECT event_id, event_id % 7 AS k, list(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
SELECT event_id, CAST(coalesce(list_reduce([0::BIGINT] || coalesce(b, []), lambda s, x: CASE WHEN x = 1 THEN 1 WHEN x = 2 THEN 0 WHEN x IN (3, 4) THEN 1 - s ELSE s END), 0) AS INTEGER) AS mark FROM k"""


def _raster(spark, sf_dir):
    return base.table(spark, sf_dir, "events").select(F.floor(C("event_id") / 100).alias("row"), (C("event_id") % 100).alias("col"), (F.pmod(C("event_id") * 7919, F.lit(101)) % 11).alias("value"))


_raster_sql = "r AS (SELECT CAST(floor(event_id/100) AS BIGINT) AS row, event_id % 100 AS col, (event_id*7919) % 101 % 11 AS value FROM events)"
QUERIES["agg_mask_or"] = lambda s, d: _raster(s, d).groupBy(F.floor(C("row") / 3).alias("row"), F.floor(C("col") / 4).alias("col")).agg(F.bool_or(C("value") > 8).alias("mask"))
ORACLES["agg_mask_or"] = f"WITH {_raster_sql} SELECT CAST(floor(row/3) AS BIGINT) AS row, CAST(floor(col/4) AS BIGINT) AS col, bool_or(value > 8) AS mask FROM r GROUP BY ALL"
QUERIES["mesh_mask_raster"] = lambda s, d: shapes.mask_raster(_raster(s, d), 5, 2)
ORACLES["mesh_mask_raster"] = f"WITH {_raster_sql} SELECT CAST(floor(row/2) AS BIGINT) AS row, CAST(floor(col/2) AS BIGINT) AS col, bool_or(value = 5) AS mask FROM r GROUP BY ALL"


def _resolutions(spark, sf_dir):
    """The grid resolution of spacings of 700 m to 5,000 km, and its own spacing."""
    p = base.table(spark, sf_dir, "part").select("p_partkey", F.exp((C("p_partkey") * 37 % 1000) / 1000.0 * 8.9 + 6.5).alias("m"))
    out = p.select("p_partkey", *[importers.resolution_of(g, C("m")).cast("long").alias(g) for g in ("ISEA3H", "ISEA4H")])
    return out.select("*", *[F.round(importers.spacing_of(g, C(g)), 2).alias(f"{g}_metres") for g in ("ISEA3H", "ISEA4H")])


QUERIES["geo_res_lookup"] = _resolutions
_find = lambda t: f"CAST(coalesce(list_min([i FOR i IN range(1, {len(t)}) IF m*0.001 <= {t}[i] AND m*0.001 >= {t}[i+1]]), 0) AS BIGINT)"
_tables = {g: "[" + ", ".join(f"{x}::DOUBLE" for x in t) + "]" for g, t in importers.SPACINGS.items()}
ORACLES["geo_res_lookup"] = f"""WITH p AS (SELECT p_partkey, exp(CAST(p_partkey*37 % 1000 AS DOUBLE)/1000*8.9::DOUBLE + 6.5::DOUBLE)*0.001::DOUBLE AS km FROM part),
t AS (SELECT 'a' AS g, i, v, lead(v) OVER (ORDER BY i) AS w FROM (SELECT unnest({_tables['ISEA3H']}) AS v, unnest(range(1, {len(importers.ISEA3H) + 1})) AS i) UNION ALL SELECT 'b', i, v, lead(v) OVER (ORDER BY i) FROM (SELECT unnest({_tables['ISEA4H']}) AS v, unnest(range(1, {len(importers.ISEA4H) + 1})) AS i)),
f AS (SELECT p_partkey, coalesce(min(CASE WHEN g = 'a' THEN i END), 0) AS a, coalesce(min(CASE WHEN g = 'b' THEN i END), 0) AS b FROM p LEFT JOIN t ON km <= v AND km >= w GROUP BY p_partkey)
SELECT p_partkey, CAST(a AS BIGINT) AS ISEA3H, CAST(b AS BIGINT) AS ISEA4H, round((SELECT v*1000 FROM t WHERE g = 'a' AND i = a), 2) AS ISEA3H_metres, round((SELECT v*1000 FROM t WHERE g = 'b' AND i = b), 2) AS ISEA4H_metres FROM f"""


def _helpers(spark, sf_dir):
    """Spacing helpers: blended spacing, straight distance and the way back from points off an ellipsoid."""
    e = base.edges(spark, sf_dir).select("line", "pos", *XY)
    a, b = geo.unit_xyz(C("lon1"), C("lat1")), geo.unit_xyz(C("lon2"), C("lat2"))
    straight = F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))
    arc = geo.haversine(*[C(c) for c in XY])
    lon, lat = geo.on_ellipsoid(*[p * 3.5 for p in a], (6371.0, 6371.0, 6356.0))
    return e.select("line", "pos", F.round(straight, 6).alias("straight"), F.round(geo.blend(F.lit(10.0), F.lit(60.0), arc, 8e6, 4e6), 4).alias("spacing"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


QUERIES["geo_sphdist"] = _helpers
_a, _b = geometry._vec("lon1", "lat1"), geometry._vec("lon2", "lat2")
_beta = f"(0.5::DOUBLE + 0.5::DOUBLE*tanh(pi()*({geometry.H12} - 8000000)/4000000))"
ORACLES["geo_sphdist"] = f"""WITH {base.EDGES} SELECT line, pos, round(sqrt({'+'.join(f'({p}-{q})*({p}-{q})' for p, q in zip(_a, _b, strict=True))}), 6) AS straight, round({_beta}*60 + (1-{_beta})*10, 4) AS spacing,
round(degrees(atan2({_a[1]}, {_a[0]})), 6) AS lon, round(degrees(asin(({_a[2]})/6356/sqrt(({_a[0]})*({_a[0]})/6371/6371+({_a[1]})*({_a[1]})/6371/6371+({_a[2]})*({_a[2]})/6356/6356))), 6) AS lat FROM e"""

VINCENTY = """
g0 AS (SELECT *, radians(azimuth) AS al, atan((1-1/298.257223563::DOUBLE)*tan(radians(lat))) AS u1, 6378137*(1-1/298.257223563::DOUBLE) AS b FROM g),
g1 AS (SELECT *, atan2(tan(u1), cos(al)) AS s1, cos(u1)*sin(al) AS sa FROM g0),
g2 AS (SELECT *, 1-sa*sa AS c2, (1-sa*sa)*((CAST(6378137 AS DOUBLE)*6378137-b*b)/(b*b)) AS uu FROM g1),
g3 AS (SELECT *, 1+uu/16384*(4096+uu*(-768+uu*(320-175*uu))) AS ka, uu/1024*(256+uu*(-128+uu*(74-47*uu))) AS kb FROM g2),
h0 AS (SELECT *, metres/(b*ka) AS s0, metres/(b*ka) AS s FROM g3),""" + "".join(
    f"""
h{i} AS (SELECT * REPLACE (s0 + kb*sin(s)*(cos(2*s1+s)+kb/4*(cos(s)*(2*cos(2*s1+s)*cos(2*s1+s)-1)-kb/6*cos(2*s1+s)*(4*sin(s)*sin(s)-3)*(4*cos(2*s1+s)*cos(2*s1+s)-3))) AS s) FROM h{i - 1}),"""
    for i in range(1, 7)
) + """
k AS (SELECT *, c2*(1/298.257223563::DOUBLE/16)*(4+1/298.257223563::DOUBLE*(4-3*c2)) AS cc, sin(u1)*sin(s)-cos(u1)*cos(s)*cos(al) AS fl FROM h6),
v AS (SELECT *, degrees(atan2(sin(u1)*cos(s)+cos(u1)*sin(s)*cos(al), (1-1/298.257223563::DOUBLE)*sqrt(sa*sa+fl*fl))) AS lat2,
  lon + degrees(atan2(sin(s)*sin(al), cos(u1)*cos(s)-sin(u1)*sin(s)*cos(al)) - (1-cc)*(1/298.257223563::DOUBLE)*sa*(s+cc*sin(s)*(cos(2*s1+s)+cc*cos(s)*(2*cos(2*s1+s)*cos(2*s1+s)-1)))) AS x FROM k)"""
for _name in ("geo_direct_point", "geo_buffer_circle"):
    QUERIES[_name + "_sphere"], ORACLES[_name + "_sphere"] = geometry.QUERIES[_name], geometry.ORACLES[_name]


def _geodesic(spark, sf_dir):
    lon, lat = geo.geodesic_point(C("lon"), C("lat"), (C("event_id") % 360).cast("double"), F.lit(25000.0))
    return base.scattered(spark, sf_dir).select("line", "event_id", F.round(lon, 6).alias("lon2"), F.round(lat, 6).alias("lat2"))


QUERIES["geo_direct_point"] = _geodesic
_fold = "round(x - 360*floor((x+180)/360), 6)"
ORACLES["geo_direct_point"] = f"WITH {base.SCATTERED}, g AS (SELECT line, event_id, lon, lat, CAST(event_id % 360 AS DOUBLE) AS azimuth, CAST(25000 AS DOUBLE) AS metres FROM v2), {VINCENTY} SELECT line, event_id, {_fold} AS lon2, round(lat2, 6) AS lat2 FROM v"
QUERIES["geo_buffer_circle"] = lambda s, d: base.scattered(s, d).select("event_id", F.posexplode(geo.circle(C("lon"), C("lat"), F.lit(10000.0), 12)).alias("i", "p")).select("event_id", C("i").cast("long").alias("i"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))
ORACLES["geo_buffer_circle"] = f"WITH {base.SCATTERED}, g AS (SELECT event_id, i, lon, lat, CAST(i*30 AS DOUBLE) AS azimuth, CAST(10000 AS DOUBLE) AS metres FROM v2, range(12) r(i)), {VINCENTY} SELECT event_id, i, {_fold} AS lon, round(lat2, 6) AS lat FROM v"


#: Hulls of circles and their union: tested against distances.
QUERIES["geo_buffer_edge"] = lambda s, d: shapes.buffer_edges(base.river(s, d).select("line", F.lit(1).cast("long").alias("pos"), *XY), 100_000.0, 12).select("line", F.size("ring").alias("corners"), F.round(geo.ring_area(C("ring")) / 1e6, 0).alias("km2"))
QUERIES["geo_buffer_line"] = lambda s, d: shapes.buffer_lines(lattice_edges(s, d), 4000.0, 0.25, 8).select("polygon", *[F.round(c, 9).alias(c) for c in XY])
QUERIES["geo_buffer_polygon"] = lambda s, d: shapes.buffer_polygons(mesh.hexagon(s, 0.0, 0.0, 0.5, 2, 2).select(C("cell_id").alias("id"), "ring"), 8000.0, 0.25, 18).select("polygon", *[F.round(c, 9).alias(c) for c in XY])


def _angles(spark, sf_dir):
    r = base.river(spark, sf_dir)
    up = r.groupBy(C("end").alias("vertex"), "lon2", "lat2").agg(F.count("*").alias("n"), F.min(F.struct("line", "lon1", "lat1")).alias("a"), F.max(F.struct("line", "lon1", "lat1")).alias("b")).where("n > 1")
    angle = geo.angle3(C("a.lon1"), C("a.lat1"), C("lon2"), C("lat2"), C("b.lon1"), C("b.lat1"))
    return up.select("vertex", F.when(C("n") == 2, F.round(angle, 6)).otherwise(0.0).alias("angle"))


QUERIES["net_branch_angle"] = _angles
_ang = geometry.ANGLE
ORACLES["net_branch_angle"] = f"""WITH {base.RIVER}, u AS (SELECT "end" AS vertex, count(*) AS n, any_value(lon2) AS lon, any_value(lat2) AS lat, arg_min(lon1, line) AS lon1, arg_min(lat1, line) AS lat1, arg_max(lon1, line) AS lon2, arg_max(lat1, line) AS lat2 FROM l4 GROUP BY 1 HAVING count(*) > 1)
SELECT vertex, CASE WHEN n = 2 THEN round({_ang}, 6) ELSE 0 END AS angle FROM u"""
QUERIES["net_sinuosity"] = lambda s, d: _by_line(lattice_edges(s, d))
_ends = "(" + base.HAVERSINE.format("arg_min(lon1, pos)", "arg_min(lat1, pos)", "arg_max(lon2, pos)", "arg_max(lat2, pos)") + ")"
ORACLES["net_sinuosity"] = f"WITH {LATTICE} SELECT line, CASE WHEN {_ends} > 0 THEN round(sum({geometry.H12})/{_ends}, 6) END AS sinuosity FROM e8 GROUP BY line"


def _by_line(edges):
    d = edges.groupBy("line").agg(F.sum(geo.haversine(*[C(c) for c in XY])).alias("length"), F.min_by(F.struct("lon1", "lat1"), "pos").alias("a"), F.max_by(F.struct("lon2", "lat2"), "pos").alias("b"))
    straight = geo.haversine(C("a.lon1"), C("a.lat1"), C("b.lon2"), C("b.lat2"))
    return d.select("line", F.when(straight > 0, F.round(C("length") / straight, 6)).alias("sinuosity"))
