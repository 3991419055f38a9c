"""Files and configuration as queries: everything is written into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import network
from ..sources import config, files, shapefile
from . import base, cells, graph, grids, lookups
from .iterate import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
XY = ("lon1", "lat1", "lon2", "lat2")


def _points(d):
    place = lambda i: F.struct(C(f"lon{i}").alias("lon"), C(f"lat{i}").alias("lat"))
    return d.withColumn("points", F.array(place(1), place(2)))


def _line_shapes(spark, sf_dir):
    """The river as a shapefile, every fifth line with a second part."""
    r = _points(base.river(spark, sf_dir)).withColumn("parts", F.when(C("line") % 5 == 0, F.array("points", F.array(C("points")[1], C("points")[0], C("points")[1]))).otherwise(F.array("points")))
    path = shared_path(spark, "shapes")
    shapefile.write_shapes(r.select("parts", C("line").alias("NHDPlusID"), "dam").repartition(3), path, shapefile.LINE, ["NHDPlusID", "dam"])
    return path


def _read(spark, sf_dir):
    d = shapefile.read_lines(spark, _line_shapes(spark, sf_dir))
    return d.select(C("properties")["NHDPlusID"].cast("long").alias("line"), C("properties")["dam"].cast("int").alias("dam"), C("part").cast("long").alias("part"), F.size("points").cast("long").alias("n"), C("points")[0]["lon"].alias("lon"), C("points")[0]["lat"].alias("lat"))


_shape_sql = f"WITH {base.RIVER} SELECT line, dam, CAST(p AS BIGINT) AS part, CASE WHEN p = 0 THEN CAST(2 AS BIGINT) ELSE 3 END AS n, CASE WHEN p = 0 THEN lon1 ELSE lon2 END AS lon, CASE WHEN p = 0 THEN lat1 ELSE lat2 END AS lat FROM l4, range(2) r(p) WHERE p = 0 OR line % 5 = 0"
QUERIES["src_shp_flowline"] = QUERIES["snk_flowline_shp"] = _read
ORACLES["src_shp_flowline"] = ORACLES["snk_flowline_shp"] = _shape_sql


def _swat(spark, sf_dir):
    """Lines without attributes, from metres."""
    r = base.river(spark, sf_dir)
    xy = [geo.mercator(C(f"lon{i}"), C(f"lat{i}")) for i in (1, 2)]
    path = shared_path(spark, "shapes")
    metres = r.select(F.array(F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in xy])).alias("parts"))
    shapefile.write_shapes(metres, path, shapefile.LINE, [])
    d = shapefile.read_lines(spark, path, attributes=False)
    back = geo.from_mercator(C("points")[0]["lon"], C("points")[0]["lat"])
    return d.select(F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"), F.size("points").cast("long").alias("n"))


QUERIES["src_shp_swat"] = _swat
ORACLES["src_shp_swat"] = f"WITH {base.RIVER} SELECT round(lon1, 6) AS lon, round(lat1, 6) AS lat, CAST(2 AS BIGINT) AS n FROM l4"
QUERIES["src_nhd_ids_shp"] = lambda s, d: shapefile.read_lines(s, _line_shapes(s, d)).select(C("properties")["NHDPlusID"].cast("long").alias("id")).distinct()
ORACLES["src_nhd_ids_shp"] = f"WITH {base.RIVER} SELECT line AS id FROM l4"


def _extract(spark, sf_dir):
    """The parts of the shapes whose id is one of a list."""
    ids = base.river(spark, sf_dir).where("dam = 1").select(C("line").alias("id"))
    d = shapefile.read_lines(spark, _line_shapes(spark, sf_dir)).withColumn("id", C("properties")["NHDPlusID"].cast("long"))
    return d.join(ids, "id", "left_semi").select("id", C("part").cast("long").alias("part"))


QUERIES["src_nhd_extract"] = _extract
ORACLES["src_nhd_extract"] = f"WITH {base.RIVER} SELECT line AS id, CAST(p AS BIGINT) AS part FROM l4, range(2) r(p) WHERE dam = 1 AND (p = 0 OR line % 5 = 0)"


def _vertices(spark, sf_dir):
    path = shared_path(spark, "points")
    v = network.classify(network.with_headwater_order(base.river(spark, sf_dir)), 0)
    at = base.river(spark, sf_dir).select(C("line").alias("vertex"), C("lon1").alias("lon"), C("lat1").alias("lat"))
    shapefile.write_shapes(v.join(at, "vertex").select(F.array(F.array(F.struct("lon", "lat"))).alias("parts"), C("vertex").alias("pointid"), C("connectivity").alias("degree")), path, shapefile.POINT, ["pointid", "degree"])
    d = shapefile.read_shapes(spark, path).where(C("kind") == shapefile.POINT)
    return d.select(C("properties")["pointid"].cast("long").alias("vertex"), C("properties")["degree"].cast("long").alias("connectivity"), C("points")[0]["lon"].alias("lon"))


QUERIES["snk_vertex_shp"] = _vertices
ORACLES["snk_vertex_shp"] = f"WITH {base.RIVER}, {graph.HEADS}, {graph.CLASSES} SELECT vertex, CAST(connectivity AS BIGINT) AS connectivity, lon1 AS lon FROM k4 JOIN l4 ON l4.line = k4.vertex"


def _converted(spark, sf_dir):
    """Shapefile to GeoJSON: lines with sequential numbers."""
    path = shared_path(spark, "lines")
    files.write_lines(shapefile.read_lines(spark, _line_shapes(spark, sf_dir)).select("points", C("properties")["NHDPlusID"].alias("NHDPlusID"), "part"), path, ["NHDPlusID", "part"])
    d = files.read_lines(spark, path, collection=False)
    return d.select(C("properties")["NHDPlusID"].cast("long").alias("line"), C("properties")["part"].cast("long").alias("part"), F.size("points").cast("long").alias("n"), C("points")[0]["lat"].alias("lat"))


QUERIES["cvt_shp_geojson"] = QUERIES["cvt_flowline_geojson"] = _converted
ORACLES["cvt_shp_geojson"] = ORACLES["cvt_flowline_geojson"] = f"SELECT line, part, n, lat FROM ({_shape_sql})"


def _collection(spark, sf_dir):
    """A FeatureCollection with optional fields, some lines in parts, read by the place of the feature."""
    path = shared_path(spark, "collection")
    r = _points(base.river(spark, sf_dir))
    pair = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.when(C("line") % 5 == 0, F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(pair, F.reverse(pair)).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), pair.alias("coordinates"))))
    fields = F.concat(F.lit('{"lineid": '), C("line").cast("string"), F.when(C("line") % 2 == 0, F.concat(F.lit(', "NHDPlusID": '), (C("line") * 10).cast("string"))).otherwise(""), F.lit("}"))
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), fields, F.lit(', "geometry": '), geometry, F.lit("}"))
    whole = r.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", feature.alias("f")))), lambda x: x["f"]), ", ").alias("f"))  # a collection is one document
    whole.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "f", F.lit("]}")).alias("value")).write.text(path)
    return files.read_lines(spark, path)


QUERIES["src_geojson_flowline"] = lambda s, d: _collection(s, d).select(C("properties")["lineid"].cast("long").alias("line"), C("properties")["NHDPlusID"].cast("long").alias("id"), C("feature").cast("long").alias("feature"), C("part").cast("long").alias("part"), C("points")[0]["lon"].alias("lon"))
ORACLES["src_geojson_flowline"] = f"WITH {base.RIVER} SELECT line, CASE WHEN line % 2 = 0 THEN line*10 END AS id, line - 1 AS feature, CAST(p AS BIGINT) AS part, CASE WHEN p = 0 THEN lon1 ELSE lon2 END AS lon FROM l4, range(2) r(p) WHERE p = 0 OR line % 5 = 0"
QUERIES["src_nhd_ids_geojson"] = lambda s, d: _collection(s, d).where("part = 0").select(C("properties")["NHDPlusID"].cast("long").alias("id")).where("id IS NOT NULL")
ORACLES["src_nhd_ids_geojson"] = f"WITH {base.RIVER} SELECT line*10 AS id FROM l4 WHERE line % 2 = 0"


def _coords(spark, sf_dir):
    """Coordinates with repeats, as lines without them: places of a line are doubled."""
    w = base.walks(spark, sf_dir).withColumn("lon", F.round("lon", 1)).withColumn("lat", F.round("lat", 1))
    path = shared_path(spark, "coords")
    g = w.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))
    files.write_lines(g, path, ["line"])
    return files.read_lines(spark, path, collection=False).select(C("properties")["line"].cast("long").alias("line"), F.size("points").cast("long").alias("n"))


QUERIES["cvt_coords_line"] = _coords
ORACLES["cvt_coords_line"] = f"WITH {base.WALKS}, r AS (SELECT line, pos, round(lon, 1) AS x, round(lat, 1) AS y FROM w8), k AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM r WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, count(*) AS n FROM k WHERE px IS NULL OR px <> x OR py <> y GROUP BY line"


def _mesh_file(spark, sf_dir):
    """The grid with its attributes written as GeoJSON and read back."""
    path = shared_path(spark, "mesh")
    g = cells.grid(spark).select(C("cell_id").alias("cellid"), C("lon").alias("longitude"), C("lat").alias("latitude"), F.round(geo.ring_area(C("ring")), 2).alias("area"), (C("cell_id") * 1.5).alias("elevation_mean"), "ring")
    files.write_rings(g, path, ["cellid", "longitude", "latitude", "area", "elevation_mean"])
    return files.read_mesh(spark, path, collection=False)


QUERIES["src_mesh_json"] = QUERIES["src_mesh_json_topo"] = lambda s, d: _mesh_file(s, d).select("cell_id", "lon", "lat", F.round("area", 0).alias("area"), "elevation", F.size("ring").cast("long").alias("corners"))
ORACLES["src_mesh_json"] = ORACLES["src_mesh_json_topo"] = f"WITH {base.CELLS} SELECT cell_id, x1+0.25 AS lon, y1+0.25 AS lat, round(pow(CAST(6378137 AS DOUBLE), 2)*radians(CAST(0.5 AS DOUBLE))*(sin(radians(y1+0.5))-sin(radians(y1))), 0) AS area, cell_id*CAST(1.5 AS DOUBLE) AS elevation, CAST(4 AS BIGINT) AS corners FROM c5"


def _placemarks(spark, sf_dir):
    """Cells, lines and places as KML."""
    g = cells.grid(spark).select(C("cell_id").alias("id"), files.kml_placemark(C("cell_id"), C("ring")).alias("kml"))
    r = _points(base.river(spark, sf_dir).withColumn("lon1", F.floor("lon1") + 0.5).withColumn("lon2", F.floor("lon2") + 0.5).withColumn("lat1", F.floor("lat1") + 0.25).withColumn("lat2", F.floor("lat2") + 0.25))
    line = r.select("line", files.kml_placemark(C("line"), C("points"), "LineString"))
    return g.union(line).union(r.select("line", files.kml_placemark(C("line"), F.slice("points", 1, 1), "Point")))


QUERIES["snk_mesh_kml"] = _placemarks
_at = lambda x, y: f"CAST(floor({x})+0.5 AS VARCHAR) || ',' || CAST(floor({y})+0.25 AS VARCHAR)"
ORACLES["snk_mesh_kml"] = f"""SELECT cell_id AS id, kml FROM ({lookups.ORACLES['snk_mesh_kml']}) UNION ALL
SELECT line, kml FROM (WITH {base.RIVER} SELECT line, '<Placemark><name>' || line || '</name><LineString><coordinates>' || {_at('lon1', 'lat1')} || ' ' || {_at('lon2', 'lat2')} || '</coordinates></LineString></Placemark>' AS kml FROM l4
  UNION ALL SELECT line, '<Placemark><name>' || line || '</name><Point><coordinates>' || {_at('lon1', 'lat1')} || '</coordinates></Point></Placemark>' FROM l4)"""


def _wkt(spark, sf_dir):
    """Lattice lines as text, read back: the text of points and lines, and a line's points, first and last place."""
    w = base.walks(spark, sf_dir).withColumn("lon", F.floor("lon") + 0.5).withColumn("lat", F.floor("lat") + 0.25)
    g = w.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).select("line", files.wkt("LINESTRING", C("p")).alias("wkt"), files.wkt("POINT", F.slice("p", 1, 1)).alias("point"))
    p = files.from_wkt(C("wkt"))
    return g.select("line", "wkt", "point", F.size(p).cast("long").alias("n"), F.element_at(p, -1)["lat"].alias("lat"))


QUERIES["cvt_wkt"] = _wkt
ORACLES["cvt_wkt"] = f"""WITH {base.WALKS}, k AS (SELECT line, pos, floor(lon)+0.5 AS x, floor(lat)+0.25 AS y, CAST(floor(lon)+0.5 AS VARCHAR) || ' ' || CAST(floor(lat)+0.25 AS VARCHAR) AS t FROM w8)
SELECT line, 'LINESTRING (' || string_agg(t, ', ' ORDER BY pos) || ')' AS wkt, 'POINT (' || arg_min(t, pos) || ')' AS point, count(*) AS n, arg_max(y, pos) AS lat FROM k GROUP BY line"""


def _vectors(spark, sf_dir):
    """The normalised sum of the first three n-vectors of each line."""
    d = base.scattered(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("line").orderBy("ts", "event_id"))).where("i <= 3")
    g = d.groupBy("line").agg(F.collect_list(F.struct("lon", "lat")).alias("p"))
    lon, lat = geo.sum_vector(C("p"))
    return g.select("line", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


QUERIES["geo_nvector"] = _vectors
_v = ["sum(cos(radians(lat))*cos(radians(lon)))", "sum(cos(radians(lat))*sin(radians(lon)))", "sum(sin(radians(lat)))"]
ORACLES["geo_nvector"] = f"WITH {base.SCATTERED}, f AS (SELECT * FROM v2 QUALIFY row_number() OVER (PARTITION BY line ORDER BY ts, event_id) <= 3), s AS (SELECT line, {_v[0]} AS x, {_v[1]} AS y, {_v[2]} AS z FROM f GROUP BY line) SELECT line, round(degrees(atan2(y, x)), 5) AS lon, round(degrees(atan2(z, sqrt(x*x+y*y))), 5) AS lat FROM s"


def _json_back(rows, label, schema):
    """Rows written as JSON, one object a line, by as many tasks as they have partitions, and read back."""
    path = shared_path(rows.sparkSession, label)
    rows.write.json(path)
    return rows.sparkSession.read.schema(schema).json(path)


def _links(spark, sf_dir):
    """Each burnt edge as a link between the cells of its ends."""
    g = cells.grid(spark).select("cell_id", geo.vertex_key(C("lon"), C("lat")).alias("k"))
    e = lookups._steps(spark, sf_dir).select("event_id", "cell_id", "down")
    centre = cells.grid(spark).select("cell_id", "lon", "lat")
    e = e.join(centre.toDF("cell_id", "lon1", "lat1"), "cell_id").join(centre.toDF("down", "lon2", "lat2"), "down")
    a, b = g.toDF("start_cell", "k1"), g.toDF("end_cell", "k2")
    found = e.withColumn("k1", geo.vertex_key(C("lon1"), C("lat1"))).withColumn("k2", geo.vertex_key(C("lon2"), C("lat2"))).join(a, "k1").join(b, "k2")
    return _json_back(found.select("event_id", "start_cell", "end_cell"), "links", "event_id long, start_cell long, end_cell long")


QUERIES["snk_cell_link_json"] = _links
ORACLES["snk_cell_link_json"] = f"WITH {lookups.STEPS} SELECT event_id, cell_id AS start_cell, down AS end_cell FROM s"


def _info(spark, sf_dir):
    """Cells with their burnt segment, order and downstream cell as JSON."""
    b = lookups.QUERIES["topo_burn_cells"](spark, sf_dir)
    near = cells.grid(spark).select("cell_id", "lon", "neighbors").join(b, "cell_id")
    return _json_back(near, "mesh-info", "cell_id long, lon double, neighbors array<long>, segment long, stream_order long, downstream long")


QUERIES["snk_mesh_info"] = lambda s, d: _info(s, d)
ORACLES["snk_mesh_info"] = f"SELECT b.*, m.lon, m.neighbors FROM ({lookups.ORACLES['topo_burn_cells']}) b JOIN ({grids.ORACLES['mesh_latlon']}) m ON m.cell_id = b.cell_id"
QUERIES["snk_mesh_info_stream"] = lambda s, d: _info(s, d).select("cell_id", "segment", "downstream")
ORACLES["snk_mesh_info_stream"] = f"SELECT cell_id, segment, downstream FROM ({lookups.ORACLES['topo_burn_cells']})"


def _basin(spark, sf_dir):
    """Lines, their confluences and the network's lengths as JSON."""
    t = base.river(spark, sf_dir)
    c = network.confluences(t)
    total = t.agg(F.sum("length").alias("total"), F.count("*").alias("lines"))
    rows = c.crossJoin(F.broadcast(total))  # one row
    return _json_back(rows, "basin-info", "vertex long, upstream array<long>, downstream long, total double, lines long").select("vertex", "upstream", "downstream", F.round("total", 0).alias("total"), "lines")


QUERIES["snk_basin_info"] = _basin
ORACLES["snk_basin_info"] = f"""WITH {base.RIVER}, t AS (SELECT round(sum(length), 0) AS total, count(*) AS n FROM l4)
SELECT "end" AS vertex, list(line ORDER BY line) AS upstream, CASE WHEN "end" > 0 THEN "end" END AS downstream, (SELECT total FROM t) AS total, (SELECT n FROM t) AS lines FROM l4 GROUP BY "end" HAVING count(*) > 1"""
QUERIES["cvt_to_json"] = lambda s, d: base.river(s, d).select("line", F.to_json(files.skipping(base.river(s, d).columns, ["start", "end", "down", "length", *XY])).alias("json"))
ORACLES["cvt_to_json"] = f"""WITH {base.RIVER} SELECT line, '{{"line":' || line || ',"dam":' || dam || '}}' AS json FROM l4"""


# Configuration: one basin a nation.
def _case_files(spark, sf_dir):
    case, basins = shared_path(spark, "case") + ".json", shared_path(spark, "basins") + ".json"
    nations = base.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a case has a handful of basins
    config.write_json(spark, {"nOutlet": 5, "dResolution_meter": 2500, "sMesh_type": "latlon", "sFilename_mesh_netcdf": "m.nc", "sDate": "20240101"}, case)
    config.write_json(spark, [{"lBasinID": r["n_nationkey"] + 1, "dLatitude_outlet_degree": r["n_nationkey"] - 10.5, "dLongitude_outlet_degree": 7.25 * r["n_nationkey"], "iFlag_dam": r["n_regionkey"] % 2} for r in nations], basins)
    return case, basins


def _basins(spark, rows):
    return spark.createDataFrame([(r["lBasinID"], float(r["dLatitude_outlet_degree"]), float(r["dLongitude_outlet_degree"]), r["iFlag_dam"], r["dThreshold_small_river"], r["sFilename_dam"]) for r in rows], "basin long, lat double, lon double, dam long, small long, dams string")


BASINS = "b AS (SELECT n_nationkey + 1 AS basin, CAST(n_nationkey AS DOUBLE) - 10.5 AS lat, CAST(n_nationkey AS DOUBLE)*7.25 AS lon, n_regionkey % 2 AS dam FROM nation)"
_basin_sql = "SELECT CAST(basin AS BIGINT) AS basin, lat, lon, CAST(dam AS BIGINT) AS dam, CAST({} AS BIGINT) AS small, 'ICoM_dams.csv' AS dams FROM b"


def _src_config(spark, sf_dir):
    case, basins = _case_files(spark, sf_dir)
    c = config.read_case(spark, case, dResolution_meter=None, sMesh_type="hexagon")
    return _basins(spark, config.read_basins(spark, basins, c["nOutlet"])).crossJoin(spark.createDataFrame([(c["sMesh_type"], c["dResolution_meter"], c["sRegion"], c["sFilename_mpas_mesh_netcdf"], c["sDate"])], "mesh string, metres long, region string, file string, day string"))


QUERIES["src_config"] = _src_config
ORACLES["src_config"] = f"WITH {BASINS} SELECT *, 'hexagon' AS mesh, CAST(2500 AS BIGINT) AS metres, 'susquehanna' AS region, 'm.nc' AS file, '20240101' AS day FROM ({_basin_sql.format(90)} WHERE basin <= 5)"
QUERIES["src_config_tpl"] = lambda s, d: _basins(s, config.basin_templates(int(base.table(s, d, "nation").count()), dThreshold_small_river=7)).select("basin", "small", "dams")
ORACLES["src_config_tpl"] = f"WITH {BASINS} SELECT basin, small, dams FROM ({_basin_sql.format(7)})"


def _edited(spark, sf_dir):
    case, basins = _case_files(spark, sf_dir)
    config.edit_json(spark, basins, {"dThreshold_small_river": 123, "iFlag_dam": 9}, 2)
    config.edit_json(spark, case, {"nOutlet": 4})
    return _basins(spark, config.read_basins(spark, basins, config.read_case(spark, case)["nOutlet"]))


QUERIES["src_config_edit"] = _edited
ORACLES["src_config_edit"] = f"WITH {BASINS} SELECT basin, lat, lon, CASE WHEN basin = 3 THEN 9 ELSE dam END AS dam, CASE WHEN basin = 3 THEN 123 ELSE small END AS small, dams FROM ({_basin_sql.format(90)}) WHERE basin <= 4"


def _written_config(spark, sf_dir):
    _, basins = _case_files(spark, sf_dir)
    path = shared_path(spark, "exported") + ".json"
    config.write_json(spark, config.read_basins(spark, basins), path)
    return spark.read.schema("lBasinID long, dLatitude_outlet_degree double, sFilename_flowline_topo string").json(path).select(C("lBasinID").alias("basin"), C("dLatitude_outlet_degree").alias("lat"), C("sFilename_flowline_topo").alias("topo"))


QUERIES["snk_config"] = _written_config
ORACLES["snk_config"] = f"WITH {BASINS} SELECT CAST(basin AS BIGINT) AS basin, lat, 'flowline.csv' AS topo FROM b"


def _set(spark, sf_dir):
    case, basins = _case_files(spark, sf_dir)
    rows = [config.set_parameter(b, "dThreshold_small_river", b["lBasinID"] * 100) for b in config.read_basins(spark, basins)]
    return _basins(spark, rows).select("basin", "small")


QUERIES["run_set_param"] = _set
ORACLES["run_set_param"] = f"WITH {BASINS} SELECT CAST(basin AS BIGINT) AS basin, CAST(basin*100 AS BIGINT) AS small FROM b"


def _setup(spark, sf_dir):
    """What keeps each of several cases from being run."""
    case, basins = _case_files(spark, sf_dir)
    c, b = config.read_case(spark, case), config.read_basins(spark, basins)
    tried = [c, c | {"nOutlet": 99}, c | {"sMesh_type": "cube"}, c | {"dLatitude_bot": 95, "dResolution_meter": 0}]
    return spark.createDataFrame([(i, len(config.problems(x, b))) for i, x in enumerate(tried)], "case long, problems long")


QUERIES["run_setup"] = _setup
ORACLES["run_setup"] = "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 1), (2, 1), (3, 2)) v(\"case\", problems)"


def _dams(spark, sf_dir):
    """Dams written as CSV and read back by place of the columns."""
    path = shared_path(spark, "dams")
    r = base.river(spark, sf_dir).where("dam = 1")
    r.select(C("lat1").alias("lat"), C("lon1").alias("lon"), F.lit("x").alias("a"), F.lit("y").alias("b"), F.concat(F.lit("Dam, "), C("line").cast("string")).alias("name"), C("line").alias("id")).write.option("header", True).csv(path)
    return files.read_dams(spark, path)


QUERIES["src_dam_csv"] = _dams
ORACLES["src_dam_csv"] = f"WITH {base.RIVER} SELECT lat1 AS lat, lon1 AS lon, 'Dam, ' || line AS name, line AS id FROM l4 WHERE dam = 1"
QUERIES["src_dam_topology"], ORACLES["src_dam_topology"] = lookups.QUERIES["src_dam_csv"], lookups.ORACLES["src_dam_csv"]


def _jigsaw(spark, sf_dir):
    """Nodes and edges of lines and polygons as a mesher takes them, numbered without gaps."""
    path = shared_path(spark, "mesher")
    files.write_rings(cells.diamonds(spark, sf_dir), path, ["polygon"])
    rings = files.read_rings(spark, path, collection=False).select(C("properties")["polygon"].cast("int").alias("part"), C("ring").alias("points"))
    nodes, edges = files.mesher_tables(rings, closed=True)
    e = edges.groupBy("part").agg(F.count("*").alias("edges"), F.sum(C("a") - C("b")).alias("turn"))
    return nodes.groupBy("part").agg(F.count("*").alias("nodes"), F.min("node").alias("first")).join(e, "part")


QUERIES["src_jigsaw_geo"] = _jigsaw
ORACLES["src_jigsaw_geo"] = "SELECT n_nationkey AS part, CAST(4 AS BIGINT) AS nodes, (row_number() OVER (ORDER BY n_nationkey) - 1)*4 AS first, CAST(4 AS BIGINT) AS edges, CAST(0 AS BIGINT) AS turn FROM nation"
