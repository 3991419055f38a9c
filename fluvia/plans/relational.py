"""Joins, windows and set operations of the engine over derived lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import network
from . import base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
BRAID_ORDER = ("l_linenumber", "end", "l_suppkey", "l_extendedprice", "l_shipdate")
LINES = "b AS (SELECT l_orderkey AS s, l_partkey AS e, l_linenumber, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)"

QUERIES["win_pick_downstream"] = QUERIES["net_loop"] = lambda s, d: network.remove_loops(base.braids(s, d), [F.desc(c) for c in BRAID_ORDER]).select("start", "end", "l_linenumber")
ORACLES["win_pick_downstream"] = ORACLES["net_loop"] = f'WITH {LINES} SELECT s AS "start", e AS "end", l_linenumber FROM b QUALIFY row_number() OVER (PARTITION BY s ORDER BY l_linenumber DESC, e DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) = 1'
QUERIES["win_edge_lead"] = QUERIES["net_split_to_edge"] = base.edges
ORACLES["win_edge_lead"] = ORACLES["net_split_to_edge"] = f"WITH {base.EDGES} SELECT * FROM e"
QUERIES["win_running_id"] = lambda s, d: base.scattered(s, d).select("line", "event_id", F.row_number().over(Window.partitionBy("line").orderBy("ts", "event_id")).cast("long").alias("pos"))
ORACLES["win_running_id"] = f"WITH {base.SCATTERED} SELECT line, event_id, CAST(row_number() OVER (PARTITION BY line ORDER BY ts, event_id) AS BIGINT) AS pos FROM v2"
QUERIES["win_prev_overlap"] = lambda s, d: base.table(s, d, "events").select("event_id", (F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == C("event_type")).alias("repeats"))
ORACLES["win_prev_overlap"] = "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AS repeats FROM events"
QUERIES["set_distinct_edge"] = lambda s, d: base.braids(s, d).select("start", "end").distinct()
ORACLES["set_distinct_edge"] = f'WITH {LINES} SELECT DISTINCT s AS "start", e AS "end" FROM b'
QUERIES["prd_edge_overlap"] = lambda s, d: base.braids(s, d).groupBy(F.least("start", "end").alias("a"), F.greatest("start", "end").alias("b")).agg(F.count("*").alias("n"))
ORACLES["prd_edge_overlap"] = f"WITH {LINES} SELECT least(s, e) AS a, greatest(s, e) AS b, count(*) AS n FROM b GROUP BY ALL"
QUERIES["set_distinct_vertex"] = lambda s, d: network.vertices(base.braids(s, d))
ORACLES["set_distinct_vertex"] = f"WITH {LINES} SELECT s AS vertex FROM b UNION SELECT e FROM b"
QUERIES["set_union_all"] = lambda s, d: base.braids(s, d).select(C("start").alias("vertex")).unionByName(base.braids(s, d).select(C("end").alias("vertex"))).groupBy("vertex").agg(F.count("*").alias("n"))
ORACLES["set_union_all"] = f"WITH {LINES} SELECT vertex, count(*) AS n FROM (SELECT s AS vertex FROM b UNION ALL SELECT e FROM b) GROUP BY vertex"
QUERIES["set_intersect"] = lambda s, d: base.braids(s, d).select(C("start").alias("vertex")).intersect(base.braids(s, d).select(C("end").alias("vertex")))
ORACLES["set_intersect"] = f"WITH {LINES} SELECT s AS vertex FROM b INTERSECT SELECT e FROM b"
QUERIES["set_except"] = lambda s, d: base.braids(s, d).select(C("start").alias("vertex")).subtract(base.braids(s, d).select(C("end").alias("vertex")))
ORACLES["set_except"] = f"WITH {LINES} SELECT s AS vertex FROM b EXCEPT SELECT e FROM b"
QUERIES["set_add_unique"] = lambda s, d: base.braids(s, d).select(C("start").alias("vertex")).distinct().unionByName(base.braids(s, d).select(C("end").alias("vertex")).distinct().join(base.braids(s, d).select(C("start").alias("vertex")), "vertex", "left_anti"))
ORACLES["set_add_unique"] = ORACLES["set_distinct_vertex"]
QUERIES["set_distinct_line"] = lambda s, d: base.scattered(s, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lon", "lat"))).alias("p")).groupBy(F.transform("p", lambda p: p["lon"]).alias("shape")).agg(F.min("line").alias("line")).select("line", F.size("shape").cast("long").alias("points"))
ORACLES["set_distinct_line"] = f"WITH {base.SCATTERED}, l AS (SELECT line, list(lon ORDER BY ts, event_id) AS shape FROM v2 GROUP BY line) SELECT min(line) AS line, CAST(len(shape) AS BIGINT) AS points FROM l GROUP BY shape"
QUERIES["prd_headwater"] = QUERIES["join_anti"] = lambda s, d: network.headwaters(base.shallow(s, d)).select("line")
ORACLES["prd_headwater"] = ORACLES["join_anti"] = f"WITH {base.SHALLOW} SELECT k AS line FROM f3 WHERE k NOT IN (SELECT p FROM f3)"
QUERIES["join_semi"] = lambda s, d: base.shallow(s, d).join(base.shallow(s, d).select(C("end").alias("start")), "start", "left_semi").select("line")
ORACLES["join_semi"] = f"WITH {base.SHALLOW} SELECT k AS line FROM f3 WHERE k IN (SELECT p FROM f3)"
QUERIES["join_equi_hash"] = QUERIES["prd_upstream"] = lambda s, d: base.shallow(s, d).select(C("line").alias("upper"), C("end").alias("v")).join(base.shallow(s, d).select(C("line").alias("lower"), C("start").alias("v")), "v").select("upper", "lower")
ORACLES["join_equi_hash"] = ORACLES["prd_upstream"] = f"WITH {base.SHALLOW} SELECT a.k AS upper, b.k AS lower FROM f3 a JOIN f3 b ON a.p = b.k"
QUERIES["join_left_outer"] = lambda s, d: network.downstream_lines(base.shallow(s, d).drop("down")).select("line", "down")
ORACLES["join_left_outer"] = f"WITH {base.SHALLOW} SELECT a.k AS line, b.k AS down FROM f3 a LEFT JOIN f3 b ON a.p = b.k"
QUERIES["join_nearest"] = lambda s, d: base.river(s, d).agg(F.min_by("line", F.struct(F.round(F.abs(C("lon1") + 75) + F.abs(C("lat1") - 40), 9), C("line"))).alias("line"))
ORACLES["join_nearest"] = f"WITH {base.RIVER} SELECT line FROM l4 ORDER BY round(abs(lon1+75)+abs(lat1-40), 9), line LIMIT 1"
QUERIES["agg_degree"] = lambda s, d: network.degrees(base.braids(s, d)).select("vertex", C("n_in").cast("long"), C("n_out").cast("long"))
ORACLES["agg_degree"] = f"WITH {LINES} SELECT vertex, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT e AS vertex, 1 AS i, 0 AS o FROM b UNION ALL SELECT s, 0, 1 FROM b) GROUP BY vertex"
QUERIES["agg_sum_length"] = lambda s, d: base.river(s, d).groupBy("dam").agg(F.round(F.sum("length"), 1).alias("length"))
ORACLES["agg_sum_length"] = f"WITH {base.RIVER} SELECT dam, round(sum(length), 1) AS length FROM l4 GROUP BY dam"
QUERIES["sort_area_desc"] = QUERIES["topk_outlets"] = lambda s, d: base.table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")
QUERIES["sort_area_all"] = lambda s, d: base.table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal")
ORACLES["sort_area_all"] = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey"
ORACLES["sort_area_desc"] = ORACLES["topk_outlets"] = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"
QUERIES["prd_dup_check"] = lambda s, d: base.braids(s, d).groupBy("start").agg((F.count_distinct("end") == F.count("end")).alias("unique"))
ORACLES["prd_dup_check"] = f'WITH {LINES} SELECT s AS "start", count(DISTINCT e) = count(e) AS "unique" FROM b GROUP BY s'
QUERIES["lookup_edge"] = lambda s, d: base.braids(s, d).groupBy("start", "end").agg(F.min("l_linenumber").alias("first"))
ORACLES["lookup_edge"] = f'WITH {LINES} SELECT s AS "start", e AS "end", min(l_linenumber) AS first FROM b GROUP BY s, e'
QUERIES["agg_mask_or"] = lambda s, d: base.walks(s, d).groupBy((C("event_id") % 40).alias("row"), (C("line") % 7).alias("col")).agg(F.bool_or(C("lon") > -75).alias("mask"))
ORACLES["agg_mask_or"] = f"WITH {base.WALKS} SELECT event_id % 40 AS row, line % 7 AS col, bool_or(lon > -75) AS mask FROM w8 GROUP BY ALL"
