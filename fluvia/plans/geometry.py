"""Scalar geometry and predicates as queries over scattered trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clib, geo
from . import base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col


def E4():  # noqa: N802
    return C("lon1"), C("lat1"), C("lon2"), C("lat2")


def _p():
    return C("lon"), C("lat")


HAV = base.HAVERSINE


def _register(name: str, rows, keys: list[str], ctes: str, source: str, columns: dict) -> None:
    """``columns``: name -> (decimals or None, function that makes the column, SQL)."""

    def query(spark, sf_dir):
        return rows(spark, sf_dir).select(*keys, *[(c() if n is None else F.round(c(), n)).alias(k) for k, (n, c, _) in columns.items()])

    QUERIES[name] = query
    shown = ", ".join(f"{sql} AS {k}" if n is None else f"round({sql}, {n}) AS {k}" for k, (n, _, sql) in columns.items())
    ORACLES[name] = f"WITH {ctes} SELECT {', '.join(keys)}, {shown} FROM {source}"


def _edge(name: str, **columns) -> None:
    _register(name, base.edges, ["line", "pos"], base.EDGES, "e", columns)


def _triple(name: str, **columns) -> None:
    _register(name, base.triples, ["line", "event_id"], base.TRIPLES, "t", columns)


def _point(name: str, **columns) -> None:
    _register(name, base.scattered, ["line", "event_id"], base.SCATTERED, "v2", columns)


X, Y, Z = "cos(radians({1}))*cos(radians({0}))", "cos(radians({1}))*sin(radians({0}))", "sin(radians({1}))"
_vec = lambda lon, lat: [s.format(lon, lat) for s in (X, Y, Z)]
H12 = HAV.format("lon1", "lat1", "lon2", "lat2")
BEARING = "(degrees(atan2(sin(radians({2}-{0}))*cos(radians({3})), cos(radians({1}))*sin(radians({3}))-sin(radians({1}))*cos(radians({3}))*cos(radians({2}-{0}))))+360)"
_bear = lambda *p: f"({BEARING.format(*p)} - 360*floor({BEARING.format(*p)}/360))"

_edge("geo_haversine", length=(3, lambda: geo.haversine(*E4()), H12))
QUERIES["geo_haversine_array"] = lambda s, d: base.edges(s, d).select("line", "pos", clib.haversine_rounded(*E4(), 3).alias("m")).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", C("m")))).alias("p")).select("line", F.transform("p", lambda p: p["m"]).alias("lengths"))
ORACLES["geo_haversine_array"] = f"WITH {base.EDGES} SELECT line, list(round({H12}, 3) ORDER BY pos) AS lengths FROM e GROUP BY line"
_point("geo_xyz", **{k: (3, lambda i=i: geo.xyz(*_p())[i], f"CAST(6371000 AS DOUBLE)*{s}") for i, (k, s) in enumerate(zip("xyz", _vec("lon", "lat"), strict=True))})
_point("geo_unit_xyz", **{k: (6, lambda i=i: geo.unit_xyz(*_p())[i], s) for i, (k, s) in enumerate(zip("xyz", _vec("lon", "lat"), strict=True))})
_x, _y, _z = _vec("lon", "lat")
_back = lambda: geo.to_lonlat(*geo.unit_xyz(*_p()))
_point("geo_from_nvector", lon=(6, lambda: _back()[0], f"degrees(atan2({_y}, {_x}))"), lat=(6, lambda: _back()[1], f"degrees(atan2({_z}, sqrt(({_x})*({_x})+({_y})*({_y}))))"))
_sum = [f"({a}+{b})" for a, b in zip(_vec("lon1", "lat1"), _vec("lon2", "lat2"), strict=True)]
_edge("geo_midpoint", lon=(6, lambda: geo.midpoint(*E4())[0], f"degrees(atan2({_sum[1]}, {_sum[0]}))"), lat=(6, lambda: geo.midpoint(*E4())[1], f"degrees(atan2({_sum[2]}, sqrt({_sum[0]}*{_sum[0]}+{_sum[1]}*{_sum[1]})))"))
_u = [f"({a}-{b})" for a, b in zip(_vec("lon1", "lat1"), _vec("lon", "lat"), strict=True)]
_v = [f"({a}-{b})" for a, b in zip(_vec("lon2", "lat2"), _vec("lon", "lat"), strict=True)]
_dot = lambda a, b: "(" + "+".join(f"{p}*{q}" for p, q in zip(a, b, strict=True)) + ")"
ANGLE = f"CASE WHEN {_dot(_u, _u)} > 0 AND {_dot(_v, _v)} > 0 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_dot(_u, _v)}/(sqrt({_dot(_u, _u)})*sqrt({_dot(_v, _v)})))))) END"
_triple("geo_angle3", angle=(6, lambda: geo.angle3(*E4()[:2], *_p(), *E4()[2:]), ANGLE))
_triple("geo_dist_to_plane", distance=(None, lambda: F.lit(0.0), "CAST(0 AS DOUBLE)"))
_point("geo_lon_360_180", folded=(6, lambda: geo.fold_longitude(C("lon") + 180), "(lon+180) - CAST(trunc((lon+180)/180) AS INTEGER)*360"))
_edge("geo_bearing", bearing=(6, lambda: geo.bearing(*E4()), _bear("lon1", "lat1", "lon2", "lat2")))
_edge("geo_edge_bound", x1=(None, lambda: F.least("lon1", "lon2"), "least(lon1, lon2)"), y1=(None, lambda: F.least("lat1", "lat2"), "least(lat1, lat2)"), x2=(None, lambda: F.greatest("lon1", "lon2"), "greatest(lon1, lon2)"), y2=(None, lambda: F.greatest("lat1", "lat2"), "greatest(lat1, lat2)"))
_w = lambda: F.greatest("lon1", "lon2") - F.least("lon1", "lon2") > 180
_edge("geo_cell_bound_idl", x1=(None, lambda: F.when(_w(), F.greatest("lon1", "lon2")).otherwise(F.least("lon1", "lon2")), "CASE WHEN greatest(lon1,lon2)-least(lon1,lon2) > 180 THEN greatest(lon1,lon2) ELSE least(lon1,lon2) END"), x2=(None, lambda: F.when(_w(), F.least("lon1", "lon2")).otherwise(F.greatest("lon1", "lon2")), "CASE WHEN greatest(lon1,lon2)-least(lon1,lon2) > 180 THEN least(lon1,lon2) ELSE greatest(lon1,lon2) END"))
_edge("prd_dateline", wide=(None, lambda: (F.abs(C("lon1") - C("lon2")) > 100).cast("int"), "CAST(abs(lon1-lon2) > 100 AS INTEGER)"))
_point("prd_region", arctic=(None, lambda: C("lat") > 55, "lat > 55"), antarctic=(None, lambda: C("lat") < -60, "lat < -60"), worldwide=(None, lambda: C("lat").between(-60, 85), "lat BETWEEN -60 AND 85"))
_d1, _d2 = HAV.format("lon1", "lat1", "lon", "lat"), HAV.format("lon2", "lat2", "lon", "lat")
_b12, _b1p, _b21, _b2p = _bear("lon1", "lat1", "lon2", "lat2"), _bear("lon1", "lat1", "lon", "lat"), _bear("lon2", "lat2", "lon1", "lat1"), _bear("lon2", "lat2", "lon", "lat")
POINT_EDGE = f"CASE WHEN {H12} = 0 THEN {_d1} WHEN cos(radians({_b1p}-{_b12})) > 0 AND cos(radians({_b2p}-{_b21})) > 0 THEN abs(asin(sin({_d1}/CAST(6378137 AS DOUBLE))*sin(radians({_b1p}-{_b12})))*CAST(6378137 AS DOUBLE)) ELSE least({_d1}, {_d2}) END"
_triple("geo_dist_point_edge", distance=(2, lambda: geo.point_edge_distance(*_p(), *E4()), POINT_EDGE))
_triple("geo_point_on_edge", inside=(None, lambda: geo.point_on_edge(*_p(), *E4()), f"CAST(coalesce(({ANGLE}) > 178 AND {_d1} + {_d2} - {H12} < 1.0 AND {_d1} > 0 AND {_d2} > 0, false) AS INTEGER)"))
_s = "(CAST(25000 AS DOUBLE)/CAST(6378137 AS DOUBLE))"
_lat2 = f"asin(sin(radians(lat))*cos({_s})+cos(radians(lat))*sin({_s})*cos(radians(CAST(event_id%360 AS DOUBLE))))"
_lon2 = f"(degrees(radians(lon)+atan2(sin(radians(CAST(event_id%360 AS DOUBLE)))*sin({_s})*cos(radians(lat)), cos({_s})-sin(radians(lat))*sin({_lat2})))+540)"
_direct = lambda: geo.direct_point(*_p(), (C("event_id") % 360).cast("double"), F.lit(25000.0))
_point("geo_direct_point", lon2=(6, lambda: _direct()[0], f"({_lon2} - 360*floor({_lon2}/360)) - 180"), lat2=(6, lambda: _direct()[1], f"degrees({_lat2})"))
_point("geo_deg_meter", degrees=(6, lambda: geo.metre_to_degree(F.lit(1000.0), C("lat")), "degrees(CAST(1000 AS DOUBLE)/(CAST(6378137 AS DOUBLE)*cos(radians(lat))))"))
_point("geo_cell_len_hex", edge=(6, lambda: geo.hexagon_edge(C("lon") + 180), "sqrt(2*(lon+180)/(3*sqrt(CAST(3 AS DOUBLE))))"))
_point("geo_cell_len_sq", edge=(6, lambda: F.sqrt(C("lon") + 180), "sqrt(lon+180)"))
_point("geo_row_col", row=(None, lambda: (F.floor((C("event_id") - 1) / 25) + 1), "CAST(floor((event_id-1)/25) AS BIGINT)+1"), col=(None, lambda: F.pmod(C("event_id") - 1, F.lit(25)) + 1, "((event_id-1)%25+25)%25+1"))
_point("cvt_wkt", wkt=(None, lambda: F.concat(F.lit("POINT ("), F.round(C("lon") * 1000).cast("long").cast("string"), F.lit(" "), F.round(C("lat") * 1000).cast("long").cast("string"), F.lit(")")), "'POINT (' || CAST(CAST(round(lon*1000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(lat*1000) AS BIGINT) AS VARCHAR) || ')'"))
_triple("prd_vertex_eq", same=(None, lambda: (geo.vertex_key(*E4()[:2]) == geo.vertex_key(*E4()[2:])).cast("int"), "CAST(abs(lon1-lon2) < 1e-9 AND abs(lat1-lat2) < 1e-9 AS INTEGER)"))

_lines = lambda s, d: base.edges(s, d).groupBy("line")
QUERIES["geo_line_length"] = lambda s, d: _lines(s, d).agg(F.round(F.sum(geo.haversine(*E4())), 2).alias("length"), F.count("*").alias("edges"))
ORACLES["geo_line_length"] = f"WITH {base.EDGES} SELECT line, round(sum({H12}), 2) AS length, count(*) AS edges FROM e GROUP BY line"
QUERIES["agg_bbox"] = lambda s, d: base.scattered(s, d).groupBy("line").agg(F.min("lon").alias("x1"), F.min("lat").alias("y1"), F.max("lon").alias("x2"), F.max("lat").alias("y2"))
ORACLES["agg_bbox"] = f"WITH {base.SCATTERED} SELECT line, min(lon) AS x1, min(lat) AS y1, max(lon) AS x2, max(lat) AS y2 FROM v2 GROUP BY line"


def _sinuosity(spark, sf_dir):
    """Length over the distance of the ends; null for a closed line."""
    d = base.edges(spark, sf_dir).groupBy("line").agg(
        F.sum(geo.haversine(*E4())).alias("length"), F.min_by(F.struct("lon1", "lat1"), "pos").alias("a"), F.max_by(F.struct("lon2", "lat2"), "pos").alias("b"),
        F.min(F.least("lon1", "lon2")).alias("x1"), F.max(F.greatest("lon1", "lon2")).alias("x2"))
    straight = geo.haversine(C("a.lon1"), C("a.lat1"), C("b.lon2"), C("b.lat2"))
    return d.select("line", F.round("length", 2).alias("length"), F.when(straight > 0, F.round(C("length") / straight, 6)).alias("sinuosity"), "x1", "x2")


QUERIES["geo_sinuosity"] = _sinuosity
_ends = "(" + HAV.format("(arg_min(lon1, pos))", "(arg_min(lat1, pos))", "(arg_max(lon2, pos))", "(arg_max(lat2, pos))") + ")"
ORACLES["geo_sinuosity"] = f"WITH {base.EDGES} SELECT line, round(sum({H12}), 2) AS length, CASE WHEN {_ends} > 0 THEN round(sum({H12})/{_ends}, 6) END AS sinuosity, min(least(lon1, lon2)) AS x1, max(greatest(lon1, lon2)) AS x2 FROM e GROUP BY line"


def _potentiometric(spark, sf_dir):
    p = base.table(spark, sf_dir, "part")
    missing = C("p_partkey") % 13 == 0
    bed, ice = F.when(missing, -9999.0).otherwise(C("p_retailprice") - 1000), F.when(missing, -9999.0).otherwise(C("p_size") * 10.0)
    return p.select("p_partkey", F.round(geo.potentiometric(bed, ice), 3).alias("surface"))


QUERIES["geo_potentiometric"] = _potentiometric
ORACLES["geo_potentiometric"] = "SELECT p_partkey, CASE WHEN p_partkey%13=0 THEN CAST(-9999 AS DOUBLE) ELSE round(p_retailprice-1000 + p_size*CAST(10 AS DOUBLE)*CAST(0.917 AS DOUBLE), 3) END AS surface FROM part"


def _circle(spark, sf_dir):
    """16 points around every event at 10 km."""
    d = base.scattered(spark, sf_dir).select("event_id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    lon, lat = geo.direct_point(C("lon"), C("lat"), C("i") * 22.5, F.lit(10000.0))
    return d.select("event_id", "i", F.round(geo.haversine(C("lon"), C("lat"), lon, lat), 2).alias("distance"))


QUERIES["geo_buffer_circle"] = _circle
ORACLES["geo_buffer_circle"] = "SELECT event_id, CAST(i AS INTEGER) AS i, CAST(10000 AS DOUBLE) AS distance FROM events, range(16) r(i)"
