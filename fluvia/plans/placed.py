"""Meshes met by the customers of the given tables, files read in many tasks, and queries that shared another's name before.

Each customer is assigned a cell of a mesh by its number, so that the rows of these queries follow the tables.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, projection
from ..operators import importers, mesh, network, overlay, reconstruct
from ..operators import shapes as buffers
from ..sources import files, geoparquet, netcdf, shapefile
from . import base, cells, chain, exchange, graph, grids, lookups, relational, shapes
from .iterate import shared_path, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col


def customers(spark, sf_dir, count: int) -> DataFrame:
    """(customer, cell_id): every customer with one of ``count`` cells."""
    k = C("c_custkey")
    return base.table(spark, sf_dir, "customer").select(k.alias("customer"), (F.pmod(k * 7919, F.lit(count)) + 1).alias("cell_id"))


def _met(name: str, query: Callable, sql: str, count: int, key: str = "cell_id") -> None:
    """Register a query over a mesh as one over the customers: each with the rows of its cell."""
    QUERIES[name] = lambda s, d: customers(s, d, count).withColumnRenamed("cell_id", key).join(query(s, d), key)
    ORACLES[name] = f'SELECT c.c_custkey AS customer, q.* FROM customer c JOIN ({sql}) q ON q."{key}" = 1 + (c.c_custkey*7919) % {count}'


_GRIDS = {600: ["mesh_hexagon"], 625: ["join_self_neighbor", "geo_cell_area", "agg_center_mean"]}
_LOOKUPS = {625: ["agg_components", "mesh_hex_fill", "snk_ring_geojson", "prd_cell_has_edge"], 1536: ["geo_cube_to_sphere"]}
_CELLS = {600: ["mesh_square", "mesh_square_metres", "mesh_hexagon_flat", "mesh_triangular"], 625: ["mesh_latlon_whole", "mesh_tin", "cvt_attr_cell"], 6 * cells._n**2: ["mesh_cubedsphere"], 34 * 26: ["mesh_dggrid", "cvt_coords_cell", "geo_cell_bound"]}
for _module, _named in ((grids, _GRIDS), (lookups, _LOOKUPS), (cells, _CELLS), (exchange, {625: ["src_mesh_json"]})):
    for _count, _names in _named.items():
        for _name in _names:
            _met(_name, _module.QUERIES[_name], _module.ORACLES[_name], _count)
_met("lookup_cells_by_edge", cells.QUERIES["lookup_cells_by_edge"], cells.ORACLES["lookup_cells_by_edge"], 34 * 26, "edge")
_met("prd_share_edge", grids.QUERIES["prd_share_edge"], grids.ORACLES["prd_share_edge"], 600, "a")


def _dispatched(spark, sf_dir):
    """The kinds of mesh, one after the other, for the nations."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("latlon", "square", "hexagon", "triangular", "cubicsphere")]), (C("n_nationkey") % 5 + 1).cast("int"))
    return base.table(spark, sf_dir, "nation").select("n_nationkey", kinds.alias("kind")).join(chain.QUERIES["mesh_dispatch"](spark, sf_dir), "kind")


QUERIES["mesh_dispatch"] = _dispatched
ORACLES["mesh_dispatch"] = f"SELECT n_nationkey, q.* FROM nation JOIN ({chain.ORACLES['mesh_dispatch']}) q ON q.kind = ['latlon', 'square', 'hexagon', 'triangular', 'cubicsphere'][CAST(n_nationkey % 5 + 1 AS INTEGER)]"


def _composed(spark, sf_dir):
    """The mesher's settings of each nation, with its own spacing, as JSON and read back."""
    settings = F.from_json(F.lit(importers.compose()), "spac_value double, geom_mshID string, mesh_dims int, radii array<double>")
    own = base.table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(settings.withField("spac_value", 25.0 + C("n_nationkey"))).alias("json"))
    return own.select("n_nationkey", F.from_json("json", "spac_value double, geom_mshID string, mesh_dims int, radii array<double>").alias("j")).select("n_nationkey", "j.*")


QUERIES["mesh_compose"] = _composed
ORACLES["mesh_compose"] = "SELECT n_nationkey, CAST(25 + n_nationkey AS DOUBLE) AS spac_value, 'ellipsoid-mesh' AS \"geom_mshID\", 2 AS mesh_dims, [6371.0::DOUBLE, 6371.0::DOUBLE, 6371.0::DOUBLE] AS radii FROM nation"


# NetCDF: arrays written as files of several partitions and read by ranges of rows.
def _mpas_nc(spark, sf_dir):
    """The grid's cells as arrays of an MPAS file, read 100 a task, for the customers."""
    path = shared_path(spark, "mpas-nc")
    arrays, _, _ = cells.mpas_tables(spark)
    netcdf.write_arrays(arrays.select("indexToCellID", "lonCell", "latCell", "areaCell", "verticesOnCell", "edgesOnCell").repartition(3), path, "nCells", {"verticesOnCell": 5, "edgesOnCell": 5})
    d = netcdf.read_arrays(spark, path, ["indexToCellID", "latCell", "verticesOnCell", "edgesOnCell"], 100)
    d = d.select(C("indexToCellID").cast("long").alias("cell_id"), F.round(F.degrees("latCell"), 6).alias("lat"), F.expr("transform(filter(verticesOnCell, x -> x > 0), x -> bigint(x))").alias("corners"), F.size("edgesOnCell").cast("long").alias("width"))
    return customers(spark, sf_dir, 625).join(d, "cell_id")


QUERIES["src_mpas_nc"] = _mpas_nc
ORACLES["src_mpas_nc"] = f"SELECT c_custkey AS customer, q.* FROM customer JOIN (SELECT m.*, round(y1 + 0.25, 6) AS lat FROM ({cells.ORACLES['src_mpas_nc']}) m JOIN (WITH {base.CELLS} SELECT cell_id, y1 FROM c5) USING (cell_id)) q ON q.cell_id = 1 + (c_custkey*7919) % 625"


def _tin_nc(spark, sf_dir):
    """The TIN's vertices and cells as NetCDF arrays, imported from the files, for the customers."""
    path = shared_path(spark, "tin-nc")
    g = cells.grid(spark)
    v = g.where("row < 25 AND col < 25").select(C("cell_id").alias("vertex"), *cells._xyz(C("lon") + 0.2, C("lat") + 0.2), F.array(C("cell_id"), C("cell_id") + 1, F.when(C("cell_id") % 9 == 0, 0).otherwise(C("cell_id") + 25)).alias("cellsOnVertex"))
    netcdf.write_arrays(v.repartition(2), path + "/vertices", "nVertices", {"cellsOnVertex": 3}, version=1)
    netcdf.write_arrays(g.select(C("cell_id").alias("cell"), *cells._xyz(C("lon"), C("lat"))).repartition(2), path + "/cells", "nCells", version=5)
    tin = importers.tin(netcdf.read_arrays(spark, path + "/vertices", ["vertex", "x", "y", "z", "cellsOnVertex"], 100), netcdf.read_arrays(spark, path + "/cells", ["cell", "x", "y", "z"], 100))
    d = tin.select(C("cell_id").cast("long").alias("cell_id"), F.size("ring").cast("long").alias("corners"), F.round(C("ring")[2]["lat"], 6).alias("top"))
    return customers(spark, sf_dir, 625).join(d, "cell_id")


QUERIES["src_tin_nc"] = _tin_nc
ORACLES["src_tin_nc"] = f"WITH {grids.GRID} SELECT c_custkey AS customer, cell_id, CAST(3 AS BIGINT) AS corners, round(y1+0.75, 6) AS top FROM g JOIN customer ON cell_id = 1 + (c_custkey*7919) % 625 WHERE r < 25 AND c < 25 AND cell_id % 9 <> 0"


def _cubed_nc(spark, sf_dir):
    """The cubed sphere's points and faces as NetCDF arrays, imported from the files, for the customers."""
    path = shared_path(spark, "cubed-nc")
    c = mesh.cubed_sphere(spark, 8)
    p = c.select("cell_id", F.posexplode("ring").alias("pos", "v")).withColumn("key", F.struct(*[F.round(x * 1e7).cast("long").alias(n) for n, x in zip("xyz", geo.unit_xyz(C("v.lon"), C("v.lat")), strict=True)]))
    names = written(p.groupBy("key").agg(F.min(F.struct("cell_id", "pos", "v")).alias("m")).select("key", (C("m.cell_id") * 10 + C("m.pos")).alias("point"), "m.v"))
    faces = p.join(names.select("key", "point"), "key").groupBy(C("cell_id").alias("global_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "point"))).alias("l")).select("global_id", F.transform("l", lambda x: x["point"]).alias("connect"))
    netcdf.write_arrays(names.select("point", *cells._xyz(C("v.lon"), C("v.lat"), 1.0)).repartition(2), path + "/points", "nNodes")
    netcdf.write_arrays(faces.repartition(2), path + "/faces", "nCells", {"connect": 4})
    d = importers.quads(netcdf.read_arrays(spark, path + "/points", ["point", "x", "y", "z"], 90), netcdf.read_arrays(spark, path + "/faces", ["global_id", "connect"], 90))
    d = d.select(C("cell_id").cast("long").alias("cell_id"), F.size("ring").cast("long").alias("corners"), F.size("neighbors").cast("long").alias("n"), F.round("lat", 5).alias("lat"))
    return customers(spark, sf_dir, 384).join(d, "cell_id")


QUERIES["src_cubed_nc"] = _cubed_nc
# the centre is the mean direction of the four corners
_corner = lambda i, j: (f"tan((k % 8 + {i})*pi()/16 - pi()/4)", f"tan(((k - k % 8)/8 % 8 + {j})*pi()/16 - pi()/4)")
_faces = [("1", "{a}", "{b}"), ("-({a})", "1", "{b}"), ("-1", "-({a})", "{b}"), ("{a}", "-1", "{b}"), ("-({b})", "{a}", "1"), ("{b}", "{a}", "-1")]


def _axis(n: int, i: int, j: int) -> str:
    a, b = _corner(i, j)
    return f"(CASE CAST((k - k % 64)/64 AS BIGINT) {' '.join(f'WHEN {f} THEN {sides[n].format(a=a, b=b)}' for f, sides in enumerate(_faces))} END / sqrt(1 + pow({a}, 2) + pow({b}, 2)))"


_mean = ["(" + " + ".join(_axis(n, i, j) for i in (0, 1) for j in (0, 1)) + ")" for n in range(3)]
ORACLES["src_cubed_nc"] = f"WITH p AS (SELECT k + 1 AS cell_id, {_mean[0]} AS x, {_mean[1]} AS y, {_mean[2]} AS z FROM range(384) r(k)) SELECT c_custkey AS customer, cell_id, CAST(4 AS BIGINT) AS corners, CAST(4 AS BIGINT) AS n, round(degrees(atan2(z, sqrt(x*x + y*y))), 5) AS lat FROM p JOIN customer ON cell_id = 1 + (c_custkey*7919) % 384"


# GeoParquet: the river's lines as WKB.
def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [struct.unpack("<BII4d", g) for g in batch.column("geometry").to_pylist()]
        order, kind, n, *places = (list(x) for x in zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_pydict({"line": batch.column("line"), "kind": pa.array(kind, pa.int64()), "points": pa.array(n, pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in zip(("lon1", "lat1", "lon2", "lat2"), places, strict=True)}})


def _geoparquet(spark, sf_dir):
    """The lines written with a geometry, read back and decoded, with what the footers say of it."""
    path = shared_path(spark, "geoparquet")
    geoparquet.write(exchange._points(base.river(spark, sf_dir)).select("line", "points").repartition(3), path, "LineString", "points")
    d = spark.read.parquet(path).mapInArrow(_decoded, "line long, kind long, points long, lon1 double, lat1 double, lon2 double, lat2 double")
    said = geoparquet.footers(spark, path).agg(F.min("encoding").alias("encoding"), F.max("kind").alias("shape"), F.count("version").alias("files"))
    return d.crossJoin(F.broadcast(said))  # one row


QUERIES["snk_geoparquet"] = _geoparquet
ORACLES["snk_geoparquet"] = f"WITH {base.RIVER} SELECT line, CAST(2 AS BIGINT) AS kind, CAST(2 AS BIGINT) AS points, lon1, lat1, lon2, lat2, 'WKB' AS encoding, 'LineString' AS shape, CAST(3 AS BIGINT) AS files FROM l4"

# Shapefiles in metres of a projection that their .prj names.
_PRJ = 'PROJCS["UTM_17N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-75.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def _projected(spark, sf_dir):
    """The river as a shapefile in metres, every fifth line with a second part, read in degrees by tasks of 50 records: its vertices."""
    crs, path = projection.from_wkt(_PRJ), shared_path(spark, "projected")
    place = lambda i: F.struct(*[c.alias(n) for n, c in zip(("lon", "lat"), projection.project(C(f"lon{i}"), C(f"lat{i}"), crs), strict=True)])
    first = F.array(place(1), place(2))
    parts = F.when(C("line") % 5 == 0, F.array(first, F.array(place(2), place(1), place(2)))).otherwise(F.array(first))
    shapefile.write_shapes(base.river(spark, sf_dir).select(parts.alias("parts"), C("line").alias("NHDPlusID"), "dam").repartition(2), path, shapefile.LINE, ["NHDPlusID", "dam"], _PRJ)
    d = shapefile.read_lines(spark, path, records=50)
    d = d.select(C("properties")["NHDPlusID"].cast("long").alias("line"), C("properties")["dam"].cast("int").alias("dam"), C("part").cast("long").alias("part"), F.size("points").cast("long").alias("n"), F.posexplode("points").alias("pos", "at"))
    return d.select("line", "dam", "part", "n", (C("pos") + 1).cast("long").alias("pos"), *[F.round(C("at")[c], 6).alias(c) for c in ("lon", "lat")])


QUERIES["src_shp_flowline"] = _projected
ORACLES["src_shp_flowline"] = f"""WITH {base.RIVER} SELECT line, dam, CAST(p AS BIGINT) AS part, CAST(2 + p AS BIGINT) AS n, CAST(q AS BIGINT) AS pos,
round(CASE WHEN (p + q) % 2 = 1 THEN lon1 ELSE lon2 END, 6) AS lon, round(CASE WHEN (p + q) % 2 = 1 THEN lat1 ELSE lat2 END, 6) AS lat
FROM l4, range(2) r(p), range(1, 4) t(q) WHERE (p = 0 OR line % 5 = 0) AND q <= 2 + p"""


# FeatureCollections of one line, read in ranges of some kilobytes.
def _collection(spark, sf_dir):
    """A FeatureCollection with a crs and optional fields, some lines in parts, written by one streaming task."""
    path = shared_path(spark, "collection") + "/lines.geojson"
    r = exchange._points(base.river(spark, sf_dir))
    pair = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.when(C("line") % 5 == 0, F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(pair, F.reverse(pair)).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), pair.alias("coordinates"))))
    fields = F.concat(F.lit('{"lineid": '), C("line").cast("string"), F.when(C("line") % 2 == 0, F.concat(F.lit(', "NHDPlusID": '), (C("line") * 10).cast("string"))).otherwise(""), F.lit(', "name": "a \\" {[ b"}'))
    value = F.concat(F.lit('{"type": "Feature", "properties": '), fields, F.lit(', "geometry": '), geometry, F.lit("}"))
    files.write_collection(r.select("line", value.alias("value")), path, ["line"], "urn:ogc:def:crs:OGC:1.3:CRS84")
    return path


def _collected(spark, sf_dir):
    path = _collection(spark, sf_dir)
    d = files.read_lines(spark, path, size=4096)
    return d.select(C("properties")["lineid"].cast("long").alias("line"), C("properties")["NHDPlusID"].cast("long").alias("id"), C("feature").cast("long").alias("feature"), C("part").cast("long").alias("part"), C("points")[0]["lon"].alias("lon"), F.lit(files.read_crs(path)).substr(1, 6).alias("crs"))


QUERIES["src_geojson_flowline"] = _collected
ORACLES["src_geojson_flowline"] = f"SELECT *, 'GEOGCS' AS crs FROM ({exchange.ORACLES['src_geojson_flowline']})"
QUERIES["src_nhd_ids_geojson"] = lambda s, d: files.read_lines(s, _collection(s, d), size=4096).where("part = 0").select(C("properties")["NHDPlusID"].cast("long").alias("id")).where("id IS NOT NULL")
ORACLES["src_nhd_ids_geojson"] = exchange.ORACLES["src_nhd_ids_geojson"]


def _one_a_line(spark, sf_dir):
    """A collection turned into one feature a line, and read by Spark's own reader."""
    path = shared_path(spark, "features")
    files.write_lines(files.read_lines(spark, _collection(spark, sf_dir), size=16_384).select("points", C("properties")["lineid"].alias("lineid"), "part"), path, ["lineid", "part"])
    d = files.read_lines(spark, path, collection=False)
    return d.select(C("properties")["lineid"].cast("long").alias("line"), C("properties")["part"].cast("long").alias("part"), C("points")[1]["lat"].alias("lat"))


QUERIES["cvt_flowline_geojson"] = _one_a_line
ORACLES["cvt_flowline_geojson"] = f"WITH {base.RIVER} SELECT line, CAST(p AS BIGINT) AS part, CASE WHEN p = 0 THEN lat2 ELSE lat1 END AS lat FROM l4, range(2) r(p) WHERE p = 0 OR line % 5 = 0"

# Queries that were another's object before.


def _picked(spark, sf_dir):
    """Of the lines out of a vertex the one that is kept, with their number."""
    w = Window.partitionBy("start")
    d = base.braids(spark, sf_dir).withColumn("lines", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(*[F.desc(c) for c in relational.BRAID_ORDER])))
    return d.where("rank = 1").select("start", "end", "lines")


QUERIES["win_pick_downstream"] = _picked
ORACLES["win_pick_downstream"] = f'WITH {relational.LINES} SELECT s AS "start", e AS "end", count(*) OVER (PARTITION BY s) AS lines FROM b QUALIFY row_number() OVER (PARTITION BY s ORDER BY l_linenumber DESC, e DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) = 1'
QUERIES["win_edge_lead"] = lambda s, d: base.walks(s, d).select("line", "pos", *[F.lead(c).over(Window.partitionBy("line").orderBy("pos")).alias(f"next_{c}") for c in ("lon", "lat")])
ORACLES["win_edge_lead"] = f"WITH {base.WALKS} SELECT line, pos, lead(lon) OVER w AS next_lon, lead(lat) OVER w AS next_lat FROM w8 WINDOW w AS (PARTITION BY line ORDER BY pos)"
QUERIES["prd_headwater"] = lambda s, d: network.with_headwater_order(base.shallow(s, d)).select("line", (C("stream_order") == 1).alias("headwater"))
ORACLES["prd_headwater"] = f"WITH {base.SHALLOW} SELECT k AS line, k NOT IN (SELECT p FROM f3) AS headwater FROM f3"
QUERIES["sort_area_desc"] = lambda s, d: network.running_id(base.table(s, d, "customer").select("c_custkey", "c_acctbal", (-C("c_acctbal")).alias("less")), ["less", "c_custkey"], "rank").select("c_custkey", "c_acctbal", "rank")
ORACLES["sort_area_desc"] = "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM customer"
QUERIES["agg_collect_upstream"] = lambda s, d: base.river(s, d).groupBy(C("end").alias("vertex")).agg(F.sort_array(F.collect_list("line")).alias("upstream"), F.round(F.sum("length"), 1).alias("length"))
ORACLES["agg_collect_upstream"] = f'WITH {base.RIVER} SELECT "end" AS vertex, list(line ORDER BY line) AS upstream, round(sum(length), 1) AS length FROM l4 GROUP BY 1'
QUERIES["agg_sum_order"] = lambda s, d: network.shreve(base.shallow(s, d)).join(base.shallow(s, d), "line").groupBy(C("end").alias("vertex")).agg(F.sum("stream_order").alias("orders"))
ORACLES["agg_sum_order"] = f"SELECT CAST((line - line % 2)/2 AS BIGINT) AS vertex, CAST(sum(stream_order) AS BIGINT) AS orders FROM ({graph.ORACLES['net_shreve']}) GROUP BY 1"


def _nested(spark, sf_dir):
    """The river's places within each nation's diamond: a join by an inequality, met in tiles."""
    x, y, r = F.abs(C("lon") - C("cx")), F.abs(C("lat") - C("cy")), C("r")
    k = C("n_nationkey")
    dm = base.table(spark, sf_dir, "nation").select(k.cast("int").alias("polygon"), (-81 + (k * 7 % 23) / 2.0 + 0.125).alias("cx"), (35 + (k * 5 % 19) / 2.0 + 0.0625).alias("cy"), (0.75 + (k % 4) / 2.0).alias("r"))
    dm = dm.withColumn("t", F.explode(overlay.tiles(C("cx") - r, C("cy") - r, C("cx") + r, C("cy") + r, 1.0)))
    p = base.river(spark, sf_dir).select("line", C("lon1").alias("lon"), C("lat1").alias("lat")).withColumn("t", F.struct(F.floor("lon").alias("tx"), F.floor("lat").alias("ty")))
    return p.join(dm, "t").where(x + y <= r).select("line", "polygon")


QUERIES["join_nested_loop"] = _nested
ORACLES["join_nested_loop"] = f"WITH {base.RIVER}, {cells.DIAMONDS} SELECT line, CAST(polygon AS INTEGER) AS polygon FROM l4 JOIN dm ON abs(lon1-cx) + abs(lat1-cy) <= r"


def _largest(spark, sf_dir):
    """Of the boundaries of each region, read from their file, the one of the greatest area."""
    path = shared_path(spark, "boundary")
    files.write_rings(cells.diamonds(spark, sf_dir), path, ["polygon"])
    d = files.read_rings(spark, path, collection=False).select(C("properties")["polygon"].cast("int").alias("n_nationkey"), geo.ring_area(C("ring")).alias("area"))
    d = d.join(base.table(spark, sf_dir, "nation").select(C("n_nationkey").cast("int").alias("n_nationkey"), "n_regionkey"), "n_nationkey")
    return d.groupBy("n_regionkey").agg(F.max(F.struct("area", "n_nationkey")).alias("m")).select("n_regionkey", C("m.n_nationkey").alias("polygon"), F.round(C("m.area") / 1e6, 1).alias("km2"))


QUERIES["agg_largest_polygon"] = _largest
_AREAS = f"{cells.DIAMONDS}, ar AS (SELECT n_regionkey, CAST(polygon AS INTEGER) AS polygon, radians(r)*pow(CAST(6378137 AS DOUBLE), 2)*(sin(radians(cy+r)) - sin(radians(cy-r))) AS area FROM dm JOIN nation ON n_nationkey = polygon)"
ORACLES["agg_largest_polygon"] = f"WITH {_AREAS} SELECT n_regionkey, arg_max(polygon, area) AS polygon, round(max(area)/1000000, 1) AS km2 FROM ar GROUP BY n_regionkey"


def _boundary(spark, sf_dir):
    """All boundaries as sides, from their file: the corners of each, and its area."""
    path = shared_path(spark, "boundary")
    files.write_rings(cells.diamonds(spark, sf_dir), path, ["polygon"])
    d = files.read_rings(spark, path, collection=False).select(C("properties")["polygon"].cast("int").alias("polygon"), "ring")
    sides = overlay.ring_edges(d, "polygon").groupBy("polygon").agg(F.count("*").alias("sides"), F.round(F.min("lat1"), 6).alias("south"))
    return sides.join(d.select("polygon", F.round(geo.ring_area(C("ring")) / 1e6, 1).alias("km2")), "polygon")


QUERIES["cvt_boundary"] = _boundary
ORACLES["cvt_boundary"] = f"WITH {_AREAS} SELECT ar.polygon, CAST(4 AS BIGINT) AS sides, round(cy-r, 6) AS south, round(area/1000000, 1) AS km2 FROM ar JOIN dm ON dm.polygon = ar.polygon"


def _mesh_topology(spark, sf_dir):
    """The mesh file's cells that share an edge with a customer's cell."""
    d = exchange._mesh_file(spark, sf_dir).select("cell_id", "ring")
    near = importers.with_shared_neighbors(d).select("cell_id", "neighbors")
    return customers(spark, sf_dir, 625).join(near, "cell_id")


QUERIES["src_mesh_json_topo"] = _mesh_topology
ORACLES["src_mesh_json_topo"] = f"WITH {grids.GRID}, q AS (SELECT a.cell_id, list(b.cell_id ORDER BY b.cell_id) AS neighbors FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.cell_id) SELECT c_custkey AS customer, cell_id, neighbors FROM customer JOIN q ON cell_id = 1 + (c_custkey*7919) % 625"


def _grid_file(spark, sf_dir):
    """All named features of a discrete global grid file, with their neighbours, and the customers in them; every third also names a cell that is not there."""
    path = shared_path(spark, "dggrid")
    near = F.when(C("cell_id") % 3 == 0, F.concat("neighbors", F.array(F.lit(0).cast("long")))).otherwise(C("neighbors"))
    named = cells.hexagons(spark).select(C("cell_id").cast("string").alias("name"), F.to_json(F.transform(near, lambda n: n.cast("string"))).alias("neighbors"), "ring")
    files.write_rings(named, path, ["name", "neighbors"])
    d = importers.dggrid(spark, path, collection=False).select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.size("ring").cast("long").alias("corners"), F.round(C("ring")[0]["lat"], 6).alias("top"), "neighbors", F.round(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), 1).alias("metres"))
    return d.join(customers(spark, sf_dir, 34 * 26), "cell_id", "left")


QUERIES["src_dggrid_geojson"] = _grid_file
ORACLES["src_dggrid_geojson"] = f"""WITH {cells.HEXES}, q AS (SELECT a.cell_id, round(a.x, 6) AS lon, round(a.y, 6) AS lat, CAST(6 AS BIGINT) AS corners, round(a.y + {cells._edge}, 6) AS top, list(b.cell_id ORDER BY b.cell_id) AS neighbors, round(sum({base.HAVERSINE.format('a.x', 'a.y', 'b.x', 'b.y')}), 1) AS metres
FROM hx a JOIN hx b ON a.cell_id <> b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 1.1::DOUBLE*{cells._wide}*{cells._wide} GROUP BY a.cell_id, a.x, a.y)
SELECT q.*, c_custkey AS customer FROM q LEFT JOIN customer ON cell_id = 1 + (c_custkey*7919) % {34 * 26}"""


# Lattice walks of all users, drawn together so that neighbours meet, touch and run along each other.
def crowd_edges(spark, sf_dir):
    e = shapes.lattice_edges(spark, sf_dir)
    x, y = (C("line") % 10) * 0.75, (F.floor(C("line") / 10) % 10) * 0.75
    return e.select("line", "pos", *[(C(f"lon{i}") - x).alias(f"lon{i}") for i in (1, 2)], *[(C(f"lat{i}") - y).alias(f"lat{i}") for i in (1, 2)])


CROWD = f"""{shapes.LATTICE}, s AS (SELECT *, lon2-lon1 AS dx, lat2-lat1 AS dy FROM (SELECT line, pos, lon1 - 0.75::DOUBLE*(line % 10) AS lon1, lon2 - 0.75::DOUBLE*(line % 10) AS lon2,
  lat1 - 0.75::DOUBLE*(CAST(floor(line/10) AS BIGINT) % 10) AS lat1, lat2 - 0.75::DOUBLE*(CAST(floor(line/10) AS BIGINT) % 10) AS lat2 FROM e8)),
p AS (SELECT a.line AS a_line, a.pos AS a_pos, b.line AS b_line, b.pos AS b_pos, a.lon1 AS x, a.lat1 AS y, a.dx, a.dy, a.dx*b.dy-a.dy*b.dx AS c, (b.lon1-a.lon1)*b.dy-(b.lat1-a.lat1)*b.dx AS un, (b.lon1-a.lon1)*a.dy-(b.lat1-a.lat1)*a.dx AS vn,
  (b.lon1-a.lon1)*a.dx+(b.lat1-a.lat1)*a.dy AS f, (b.lon2-a.lon1)*a.dx+(b.lat2-a.lat1)*a.dy AS g, a.dx*a.dx+a.dy*a.dy AS q
  FROM s a JOIN s b ON a.line % 2 = 0 AND b.line % 2 = 1 AND least(a.lon1, a.lon2) <= greatest(b.lon1, b.lon2) AND least(b.lon1, b.lon2) <= greatest(a.lon1, a.lon2)
    AND least(a.lat1, a.lat2) <= greatest(b.lat1, b.lat2) AND least(b.lat1, b.lat2) <= greatest(a.lat1, a.lat2))"""


def _halves(spark, sf_dir):
    e = crowd_edges(spark, sf_dir)
    return e.where("line % 2 = 0"), e.where("line % 2 = 1")


QUERIES["topo_intersect_line"] = lambda s, d: overlay.meetings(*_halves(s, d), 0.25).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "line")
ORACLES["topo_intersect_line"] = f"""WITH {CROWD}, m AS (SELECT b_line AS line, x, y, dx, dy, CASE WHEN c <> 0 THEN CASE WHEN un/c BETWEEN 0 AND 1 AND vn/c BETWEEN 0 AND 1 THEN un/c END
  WHEN vn = 0 AND greatest(least(f, g), 0) <= least(greatest(f, g), q) THEN greatest(least(f, g), 0)/q END AS u FROM p)
SELECT round(x + u*dx, 6) + 0 AS lon, round(y + u*dy, 6) + 0 AS lat, min(line) AS line FROM m WHERE u IS NOT NULL GROUP BY ALL"""
QUERIES["topo_cross_line"] = lambda s, d: overlay.crossings(*_halves(s, d), 0.25).select("a_line", "a_pos", "b_line", "b_pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
_inner = "c <> 0 AND un/c > 0 AND un/c < 1 AND vn/c > 0 AND vn/c < 1"
ORACLES["topo_cross_line"] = f"WITH {CROWD} SELECT a_line, a_pos, b_line, b_pos, round(x + un/c*dx, 6) AS lon, round(y + un/c*dy, 6) AS lat FROM p WHERE {_inner}"
QUERIES["win_split_points"] = lambda s, d: overlay.ordered_crossings(*_halves(s, d), 0.25, 9)
ORACLES["win_split_points"] = f"WITH {CROWD} SELECT a_line, a_pos, b_line, b_pos, CAST(row_number() OVER (PARTITION BY a_line, a_pos ORDER BY round(un/c, 9), b_line, b_pos) AS BIGINT) AS nth FROM p WHERE {_inner}"


def _at_vertices(spark, sf_dir):
    """Which side of a cell each lattice place lies on, for all cells that hold it; met in tiles of a cell's size."""
    g = cells.grid(spark).select("cell_id", "ring", C("ring")[0]["lon"].alias("x"), C("ring")[0]["lat"].alias("y"))
    g = g.withColumn("t", F.explode(overlay.tiles(C("x"), C("y"), C("x") + 0.5, C("y") + 0.5, 0.5)))
    k = shapes.lattice(spark, sf_dir).withColumn("t", F.struct(F.floor(C("lon") / 0.5).alias("tx"), F.floor(C("lat") / 0.5).alias("ty")))
    return k.join(g, "t").where("lon >= x AND lon <= x + 0.5 AND lat >= y AND lat <= y + 0.5").select("line", "event_id", "cell_id", geo.side_at(C("lon"), C("lat"), C("ring")).cast("long").alias("side"))


QUERIES["prd_cell_edge_at_vertex"] = _at_vertices
ORACLES["prd_cell_edge_at_vertex"] = shapes.ORACLES["prd_cell_edge_at_vertex"]
QUERIES["topo_remove_returning"] = lambda s, d: reconstruct.erase_returns(lookups._visits(s, d).select("line", "pos", "cell_id"))
ORACLES["topo_remove_returning"] = f"""WITH RECURSIVE {grids.IN}, l AS (SELECT line, cell_id, max(pos) AS last FROM j GROUP BY ALL),
w AS (SELECT line, pos, cell_id FROM j WHERE pos = 1 UNION ALL SELECT j.line, j.pos, j.cell_id FROM w JOIN l ON l.line = w.line AND l.cell_id = w.cell_id JOIN j ON j.line = w.line AND j.pos = l.last + 1)
SELECT line, pos, cell_id FROM w"""
#: Orders on the deep river are beyond a recursive query: tested against a plain version.
QUERIES["net_strahler_deep"] = lambda s, d: network.strahler(base.river(s, d))
QUERIES["geo_buffer_polygon"] = lambda s, d: buffers.buffer_polygons(cells.diamonds(s, d).select(C("polygon").cast("long").alias("id"), "ring"), 8000.0, 0.25, 18).select("polygon", *[F.round(c, 9).alias(c) for c in exchange.XY])
