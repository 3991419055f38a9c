"""Meshes that other programs made, as cells: (cell_id, lon, lat, ring, neighbors, ...).

Their arrays come as tables with the arrays' names (Parquet in place of NetCDF): one row a cell, an edge or a vertex. Ids
are 1-based, 0 pads. Rings are gathered by cell, a handful of corners each.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import config, files
from . import mesh, overlay

#: Latitudes of the regions that an import may be cut to.
REGIONS = {"arctic": "lat > 55", "antarctic": "lat < -60", "global": "lat BETWEEN -60 AND 85"}


def rings_by_vertex(cells: DataFrame, corners: str, vertices: DataFrame) -> DataFrame:
    """(cell_id, ring) from the ids in the array ``corners`` and ``vertices`` (vertex, lon, lat), in the array's order.

    Padding and repeated ids are left out. A cell of fewer than three corners, or with an id that is no vertex, has none.
    """
    ids = cells.select("cell_id", F.array_distinct(F.filter(corners, lambda x: x > 0)).alias("ids")).where("size(ids) >= 3")
    d = ids.select("cell_id", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "vertex")).join(vertices.select("vertex", "lon", "lat"), "vertex")
    g = d.groupBy("cell_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).where("size(p) = n")
    return g.select("cell_id", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))


def _kept_neighbors(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(cell_id, neighbors, distances): pairs (cell_id, neighbor, distance, pos) of kept cells, in the order of pos."""
    near = pairs.join(kept.select(F.col("cell_id").alias("neighbor")), "neighbor", "left_semi").join(kept.select("cell_id"), "cell_id", "left_semi")
    g = near.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "neighbor", "distance"))).alias("p"))
    return g.select("cell_id", F.transform("p", lambda p: p["neighbor"]).alias("neighbors"), F.transform("p", lambda p: p["distance"]).alias("distances"))


def _finished(cells: DataFrame, near: DataFrame) -> DataFrame:
    d = cells.join(near, "cell_id", "left")
    return d.withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<long>"))).withColumn("distances", F.coalesce("distances", F.array().cast("array<double>")))


def mpas(cells: DataFrame, edges: DataFrame, vertices: DataFrame, region: str | None = None, boundary: DataFrame | None = None, size: float = 1.0, ice_density: float = 917.0) -> DataFrame:
    """Cells of an MPAS mesh: cell_id, lon, lat, ring, area, elevation, neighbors, distances.

    Angles are radians, longitudes fold to (-180, 180]. The distance of a neighbour is that of the edge at the same place
    of the arrays. elevation is the surface that ice of that thickness floats or rests at; null without a bed. Cells
    outside of the ``region`` or the ``boundary`` (polygon sides), and cells across the date line where a region is
    given, are left out, and so are they as neighbours.
    """
    place = lambda x: geo.fold_longitude(F.degrees(x))
    v = vertices.select(F.col("indexToVertexID").alias("vertex"), place("lonVertex").alias("lon"), F.degrees("latVertex").alias("lat"))
    has = lambda name: F.col(name) if name in cells.columns else F.lit(None).cast("double")
    bed, ice = has("bed_elevation"), has("ice_thickness")
    surface = F.when(ice > 0, geo.potentiometric(bed, ice, ice_density)).otherwise(bed)
    c = cells.select(F.col("indexToCellID").alias("cell_id"), place("lonCell").alias("lon"), F.degrees("latCell").alias("lat"), F.col("areaCell").alias("area"), surface.alias("elevation"), "verticesOnCell", "cellsOnCell", "edgesOnCell")
    d = c.join(rings_by_vertex(c, "verticesOnCell", v), "cell_id")
    if region is not None:
        x1, _, x2, _ = overlay.ring_box(F.col("ring"))
        d = d.where(REGIONS[region]).where(x2 - x1 <= 100)
    if boundary is not None:
        d = d.join(overlay.cells_in_boundary(d, boundary, size), "cell_id", "left_semi")
    pairs = d.select("cell_id", F.posexplode(F.arrays_zip("cellsOnCell", "edgesOnCell")).alias("pos", "z")).select("cell_id", "pos", F.col("z.cellsOnCell").alias("neighbor"), F.col("z.edgesOnCell").alias("edge")).where("neighbor > 0")
    pairs = pairs.join(edges.select(F.col("indexToEdgeID").alias("edge"), F.col("dcEdge").alias("distance")), "edge", "left")
    return _finished(d.drop("verticesOnCell", "cellsOnCell", "edgesOnCell"), _kept_neighbors(pairs, d))


def tin(vertices: DataFrame, cells: DataFrame, boundary: DataFrame | None = None, size: float = 1.0) -> DataFrame:
    """Triangles of a TIN: one around each vertex (vertex, x, y, z, cellsOnVertex) from the three cells (cell, x, y, z) there.

    Vertices with fewer than three cells are left out. There are no neighbours.
    """
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    corners = cells.select(F.col("cell").alias("vertex"), lon.alias("lon"), lat.alias("lat"))
    c = vertices.select(F.col("vertex").alias("cell_id"), lon.alias("lon"), lat.alias("lat"), "cellsOnVertex")
    d = c.join(rings_by_vertex(c, "cellsOnVertex", corners), "cell_id").drop("cellsOnVertex")
    if boundary is not None:
        d = d.join(overlay.cells_in_boundary(d, boundary, size), "cell_id", "left_semi")
    return d.withColumn("area", geo.triangle_area(F.col("ring")))


def quads(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Quads of a cubed sphere from points (point, x, y, z) and faces (global_id, connect): centre is the mean direction of the corners; neighbours share an edge."""
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    v = points.select(F.col("point").alias("vertex"), lon.alias("lon"), lat.alias("lat"))
    c = faces.select(F.col("global_id").alias("cell_id"), "connect")
    d = c.join(rings_by_vertex(c, "connect", v), "cell_id").drop("connect")
    mean = lambda axis: F.aggregate("ring", F.lit(0.0), lambda s, p: s + geo.unit_xyz(p["lon"], p["lat"])[axis])
    lon, lat = geo.to_lonlat(mean(0), mean(1), mean(2))
    return with_shared_neighbors(d.withColumn("lon", lon).withColumn("lat", lat))


def with_shared_neighbors(cells: DataFrame) -> DataFrame:
    """The cells (cell_id, ring, ...) with ``neighbors``, those that share an edge, in ascending order."""
    p = mesh.shared_edges(cells)
    both = p.union(p.select("b", "a")).groupBy(F.col("a").alias("cell_id")).agg(F.array_sort(F.collect_list("b")).alias("neighbors"))
    return cells.join(both, "cell_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<long>")))


def dggrid(spark: SparkSession, path: str, collection: bool = True) -> DataFrame:
    """Cells of a discrete global grid from GeoJSON: cell_id, lon, lat, ring, neighbors, distances.

    The name of a feature is its id; neighbours that are not in the file are left out. The centre is the mean of the corners.
    """
    f = files.read_rings(spark, path, collection)
    p = F.col("properties")
    ids = F.from_json(F.regexp_replace(p["neighbors"], '"', ""), "array<long>")
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, v: s + v[c]) / F.size("ring")
    d = f.select(p["name"].cast("long").alias("cell_id"), mean("lon").alias("lon"), mean("lat").alias("lat"), "ring", ids.alias("__ids"))
    pairs = d.select("cell_id", "lon", "lat", F.posexplode("__ids").alias("pos", "neighbor"))
    other = d.select(F.col("cell_id").alias("neighbor"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    pairs = pairs.join(other, "neighbor").withColumn("distance", geo.haversine(F.col("lon"), F.col("lat"), F.col("o_lon"), F.col("o_lat")))
    return _finished(d.drop("__ids"), _kept_neighbors(pairs, d))


# Cell spacing in kilometres by resolution, from 1.
ISEA3H = [4320.490, 2539.690, 1480.02, 855.419, 494.959, 285.6520, 165.058, 95.2636, 55.0226, 31.7596, 18.341, 10.5871, 6.11367, 3.52911, 2.03789, 1.17638, 0.67930]
ISEA4H = [3764.92, 1913.88, 961.978, 481.7710, 241.0470, 120.56, 60.2893, 30.147, 15.0741, 7.53719, 3.76863, 1.88432, 0.94217]
SPACINGS = {"ISEA3H": ISEA3H, "ISEA4H": ISEA4H}


def spacing_of(grid: str, resolution: Column) -> Column:
    """Metres between cells at a resolution; null beyond the table."""
    return F.get(F.array(*[F.lit(x * 1000) for x in SPACINGS[grid]]), (resolution - 1).cast("int"))


def resolution_of(grid: str, metres: Column) -> Column:
    """The coarser of the two resolutions whose spacings hold ``metres`` between them; 0 outside of the table."""
    table = SPACINGS[grid]
    km = metres * 0.001
    found = F.lit(0)
    for i in range(len(table) - 2, -1, -1):
        found = F.when((km >= table[i + 1]) & (km <= table[i]), i + 1).otherwise(found)
    return found


def compose(**settings) -> str:
    """The default mesh, geometry and spacing settings of a mesher as JSON, with ``settings`` in their place."""
    known = config.template("spacing")
    names = ["geom_mshID", "spac_mshID", "hfun_scal", "hfun_hmax", "hfun_hmin", "mesh_dims", "optm_qlim", "optm_iter", "optm_qtol"]
    default = {n: known[n] for n in names} | {"radii": [known["FULL_SPHERE_RADIUS"]] * 3, "spac_value": known["dSpac_value"]}
    return json.dumps(default | settings, sort_keys=True)
