"""Network operators as queries over a balanced and a river-like tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network
from . import base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col


def _ordered(spark, sf_dir):
    return network.with_headwater_order(base.river(spark, sf_dir))


HEADS = "h4 AS (SELECT l.*, CASE WHEN l.\"start\" IN (SELECT \"end\" FROM l4) THEN -1 ELSE 1 END AS stream_order FROM l4 l)"
CLASSES = """
i4 AS (SELECT vertex, CASE WHEN bool_or(h) THEN 1 ELSE count(*) END AS n FROM (
    SELECT "start" AS vertex, stream_order = 1 AND "end" <> 0 AS h FROM h4 UNION ALL SELECT "end", false FROM h4) GROUP BY vertex),
k4 AS (SELECT vertex, n AS connectivity, CASE WHEN n >= 3 OR (vertex = 0 AND n > 1) THEN 'confluence' WHEN vertex = 0 THEN 'outlet' WHEN n = 1 THEN 'headwater' ELSE 'middle' END AS kind FROM i4)"""

QUERIES["net_headwater_order"] = lambda s, d: _ordered(s, d).select("line", "stream_order")
ORACLES["net_headwater_order"] = f"WITH {base.RIVER}, {HEADS} SELECT line, stream_order FROM h4"
QUERIES["net_small_river"] = lambda s, d: network.remove_small_rivers(_ordered(s, d), 400_000.0).select("line")
ORACLES["net_small_river"] = f"WITH {base.RIVER}, {HEADS} SELECT line FROM h4 WHERE dam = 1 OR stream_order <> 1 OR length > 400000"
QUERIES["net_classify"] = lambda s, d: network.classify(_ordered(s, d), 0)
ORACLES["net_classify"] = f"WITH {base.RIVER}, {HEADS}, {CLASSES} SELECT vertex, CAST(connectivity AS BIGINT) AS connectivity, kind FROM k4"
QUERIES["net_confluence"] = QUERIES["agg_collect_upstream"] = lambda s, d: network.confluences(base.shallow(s, d))
ORACLES["net_confluence"] = ORACLES["agg_collect_upstream"] = f"WITH {base.SHALLOW} SELECT p AS vertex, list(k ORDER BY k) AS upstream, CASE WHEN p > 0 THEN p END AS downstream FROM f3 GROUP BY p HAVING count(*) > 1"
QUERIES["net_topology"] = lambda s, d: network.downstream_lines(base.river(s, d).drop("down")).select("line", "down")
ORACLES["net_topology"] = f"WITH {base.RIVER} SELECT a.line, b.line AS down FROM l4 a LEFT JOIN l4 b ON a.\"end\" = b.\"start\""
QUERIES["net_reverse"] = lambda s, d: base.river(s, d).select("line", C("end").alias("start"), C("start").alias("end"))
ORACLES["net_reverse"] = f'WITH {base.RIVER} SELECT line, "end" AS "start", "start" AS "end" FROM l4'
QUERIES["net_sinuosity"] = lambda s, d: base.river(s, d).select("line", F.round(C("length") / geo.haversine(C("lon1"), C("lat1"), C("lon2"), C("lat2")), 6).alias("sinuosity"))
ORACLES["net_sinuosity"] = f"WITH {base.RIVER} SELECT line, CAST(1 AS DOUBLE) AS sinuosity FROM l4"


def _branch_angle(spark, sf_dir):
    """The angle between the two upstream lines of a confluence; 0 where there are not exactly two."""
    r = base.river(spark, sf_dir)
    up = r.groupBy(C("end").alias("vertex"), "lon2", "lat2").agg(F.sort_array(F.collect_list(F.struct("line", "lon1", "lat1"))).alias("u")).where("size(u) > 1")
    a, b = C("u")[0], C("u")[1]
    angle = geo.angle3(a["lon1"], a["lat1"], C("lon2"), C("lat2"), b["lon1"], b["lat1"])
    return up.select("vertex", F.when(F.size("u") == 2, F.round(angle, 6)).otherwise(0.0).alias("angle"))


QUERIES["net_branch_angle"] = _branch_angle


def _direction(spark, sf_dir):
    """Some lines of the balanced tree are turned; the walk from the outlet turns them back."""
    t = base.shallow(spark, sf_dir)
    turned = C("line") % 7 == 3
    mixed = t.select("line", F.when(turned, C("end")).otherwise(C("start")).alias("start"), F.when(turned, C("start")).otherwise(C("end")).alias("end"))
    return network.orient(mixed, 0).select("line", "start", "end", "turned")


QUERIES["net_direction"] = _direction
ORACLES["net_direction"] = f'WITH {base.SHALLOW} SELECT k AS line, k AS "start", p AS "end", CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END AS turned FROM f3'


def _merge(spark, sf_dir):
    lines = _ordered(spark, sf_dir)
    middle = network.classify(lines, 0).where("kind = 'middle'").select("vertex")
    return network.merge(lines, middle).select("line", "first", "parts", F.round("length", 1).alias("length"))


QUERIES["net_merge"] = _merge
ORACLES["net_merge"] = f"""WITH RECURSIVE {base.RIVER}, {HEADS}, {CLASSES},
m AS (SELECT h.line, h.length, h."end", CASE WHEN k.kind = 'middle' THEN h."end" END AS down FROM h4 h JOIN k4 k ON k.vertex = h."end"),
walk AS (SELECT line AS root, line, length, CAST(1 AS BIGINT) AS d FROM m WHERE down IS NULL UNION ALL SELECT w.root, m.line, m.length, w.d + 1 FROM walk w JOIN m ON m.down = w.line)
SELECT root AS line, arg_max(line, d) AS first, count(*) AS parts, round(sum(length), 1) AS length FROM walk GROUP BY root"""

QUERIES["net_shreve"] = QUERIES["agg_sum_order"] = lambda s, d: network.shreve(base.shallow(s, d))
ORACLES["net_shreve"] = ORACLES["agg_sum_order"] = f"""WITH RECURSIVE {base.SHALLOW},
up AS (SELECT k AS head, k, p FROM f3 WHERE k NOT IN (SELECT p FROM f3) UNION ALL SELECT u.head, f.k, f.p FROM up u JOIN f3 f ON f.k = u.p)
SELECT k AS line, CAST(count(*) AS BIGINT) AS stream_order FROM up GROUP BY k"""
QUERIES["net_strahler"] = lambda s, d: network.strahler(base.shallow(s, d))
ORACLES["net_strahler"] = f"""WITH RECURSIVE {base.SHALLOW}, depth AS (SELECT k, p, CAST(floor(log2(k)) AS BIGINT) AS d FROM f3),
o AS (
  SELECT k, d, 1 AS stream_order FROM depth WHERE d = (SELECT max(d) FROM depth)
  UNION ALL
  SELECT n.k, n.d, CASE WHEN count(c.k) = 0 THEN 1 WHEN min(c.stream_order) = max(c.stream_order) THEN max(c.stream_order) + 1 ELSE max(c.stream_order) END
  FROM depth n JOIN (SELECT min(d) - 1 AS d FROM o) x ON n.d = x.d LEFT JOIN o c ON (c.k - c.k % 2)/2 = n.k GROUP BY n.k, n.d)
SELECT k AS line, stream_order FROM o"""
QUERIES["net_segment"] = lambda s, d: network.segments(base.shallow(s, d))
ORACLES["net_segment"] = f"""WITH RECURSIVE {base.SHALLOW},
path AS (SELECT k, p, lpad(CAST(k AS VARCHAR), 9, '0') AS way FROM f3 WHERE p = 0 UNION ALL SELECT f.k, f.p, path.way || '/' || lpad(CAST(f.k AS VARCHAR), 9, '0') FROM f3 f JOIN path ON f.p = path.k)
SELECT k AS line, CAST((SELECT count(*) FROM f3) + 1 - row_number() OVER (ORDER BY way) AS BIGINT) AS segment FROM path"""


def _downstream(spark, sf_dir):
    """(line, root, steps): where each line of the river-like tree drains to, and through how many lines."""
    t = base.river(spark, sf_dir).select("line", "down").withColumn("one", F.lit(1).cast("long"))
    return network.jump(t, "one").select("line", "root", C("total").alias("steps"))


QUERIES["net_is_downstream"] = _downstream
ORACLES["net_is_downstream"] = f"""WITH RECURSIVE {base.RIVER},
up AS (SELECT line, line AS root, CAST(1 AS BIGINT) AS steps FROM l4 WHERE "end" = 0 UNION ALL SELECT l.line, u.root, u.steps + 1 FROM l4 l JOIN up u ON l."end" = u.line)
SELECT * FROM up"""


def _split(spark, sf_dir):
    """Trajectories cut at every event whose number divides by 9."""
    d = network.split_at_vertices(base.scattered(spark, sf_dir), "line", ["ts", "event_id"], C("event_id") % 9 == 0)
    return d.select("line", C("piece").cast("long"), F.size("points").cast("long").alias("points"))


QUERIES["net_split_at_vertex"] = _split
ORACLES["net_split_at_vertex"] = f"""WITH {base.SCATTERED},
a AS (SELECT line, CAST(row_number() OVER w AS BIGINT) AS pos, event_id % 9 = 0 AS cut FROM v2 WINDOW w AS (PARTITION BY line ORDER BY ts, event_id)),
c AS (SELECT line, pos, CAST(row_number() OVER w AS BIGINT) AS piece, lead(pos) OVER w AS nxt FROM a WHERE cut WINDOW w AS (PARTITION BY line ORDER BY pos))
SELECT line, piece, nxt - pos + 1 AS points FROM c WHERE nxt IS NOT NULL"""


def _split_len(spark, sf_dir):
    """Edges halved until no part is longer than 500 km: 2^k equal parts."""
    e = base.edges(spark, sf_dir)
    length = geo.haversine(C("lon1"), C("lat1"), C("lon2"), C("lat2"))
    k = F.greatest(F.lit(0).cast("long"), F.ceil(F.log2(length / 500_000.0)))
    parts = F.pow(F.lit(2.0), k).cast("long")
    return e.select("line", "pos", parts.alias("parts"), F.round(length / parts, 3).alias("part_length"))


QUERIES["net_split_edge_len"] = _split_len
_h = base.HAVERSINE.format("lon1", "lat1", "lon2", "lat2")
_k = f"pow(CAST(2 AS DOUBLE), greatest(0, ceil(log2({_h}/CAST(500000 AS DOUBLE)))))"
ORACLES["net_split_edge_len"] = f"WITH {base.EDGES} SELECT line, pos, CAST({_k} AS BIGINT) AS parts, round({_h}/{_k}, 3) AS part_length FROM e"
