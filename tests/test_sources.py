"""Files read in ranges, projections, cells of any shape, and networks on which lines meet in circles."""

from __future__ import annotations

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import projection
from fluvia.operators import hydro, network, overlay
from fluvia.sources import files, geoparquet, netcdf, shapefile

C = F.col


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("records", [False, True])
def test_netcdf_is_read_by_ranges_of_rows(spark, tmp_path, version, records):
    rng = np.random.default_rng(version)
    arrays = {"a": (["n", "k"], rng.normal(size=(1000, 3)).astype(">f8")), "b": (["n"], rng.integers(-99, 99, 1000).astype(">i4")), "s": (["n", "k"], rng.integers(0, 99, (1000, 3)).astype(">i2")), "t": (["n", "w"], np.array([list(f"n{i:03d}") for i in range(1000)], dtype="S1"))}
    (tmp_path / "x.nc").write_bytes(netcdf.encoded({"n": 0 if records else 1000, "k": 3, "w": 4}, arrays, version, {"title": "made here"}))
    header = netcdf.read_header(f"{tmp_path}/x.nc")
    assert header.attributes == {"title": "made here"} and header.shape("a") == (1000, 3) and header.by_record("b") == records
    d = netcdf.read_arrays(spark, str(tmp_path), list(arrays), 300)
    assert d.rdd.getNumPartitions() == 4
    got = d.orderBy("row").toPandas()
    assert got["row"].tolist() == list(range(1000)) and got["t"].tolist() == [f"n{i:03d}" for i in range(1000)]
    assert (np.array(got["a"].tolist()) == arrays["a"][1]).all() and (got["b"] == arrays["b"][1]).all() and (np.array(got["s"].tolist()) == arrays["s"][1]).all()


def test_netcdf_errors_and_lone_records(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(netcdf.encoded({"n": 0}, {"s": (["n"], np.arange(7, dtype=">i2"))}))
    assert [r["s"] for r in netcdf.read_arrays(spark, f"{tmp_path}/x.nc", ["s"], 2).orderBy("row").collect()] == list(range(7))  # a lone record variable isn't padded
    (tmp_path / "y.nc").write_bytes(b"\x89HDF\r\n")
    with pytest.raises(ValueError, match="no classic NetCDF"):
        netcdf.read_header(f"{tmp_path}/y.nc")


CLARKE = 'GEOGCS["x",DATUM["d",SPHEROID["Clarke 1866",6378206.4,294.978698213898]],PRIMEM["G",0],UNIT["Degree",0.0174532925199433]]'


def prj(name: str, unit: float = 1.0, **params: float) -> str:
    return f'PROJCS["t",{CLARKE},PROJECTION["{name}"],' + ",".join(f'PARAMETER["{k}",{v}]' for k, v in params.items()) + f',UNIT["u",{unit}]]'


#: Numerical examples of the standard manual on map projections, to a decimetre.
CONTROL = [
    (prj("Albers", Standard_Parallel_1=29.5, Standard_Parallel_2=45.5, Latitude_Of_Origin=23, Central_Meridian=-96), -75, 35, 1885472.7, 1535925.0),
    (prj("Lambert_Conformal_Conic", Standard_Parallel_1=33, Standard_Parallel_2=45, Latitude_Of_Origin=23, Central_Meridian=-96), -75, 35, 1894410.9, 1564649.5),
    (prj("Transverse_Mercator", Latitude_Of_Origin=0, Central_Meridian=-75, Scale_Factor=0.9996), -73.5, 40.5, 127106.5, 4484124.4),
    (prj("Mercator", Central_Meridian=-180), -75, 35, 11688673.7, 4139145.6),
]


@pytest.mark.parametrize("control", CONTROL)
def test_projections_meet_control_points_and_round_trip(spark, control):
    text, lon, lat, x, y = control
    crs = projection.from_wkt(text)
    near = spark.createDataFrame([(float(lon), float(lat)), *[(lon + a / 2, lat + b / 2) for a in range(-8, 9, 4) for b in range(-8, 9, 4)]], "lon double, lat double")
    d = near.select("lon", "lat", *[c.alias(n) for n, c in zip("xy", projection.project(C("lon"), C("lat"), crs), strict=True)])
    rows = d.select("*", *[c.alias(n) for n, c in zip(("lon2", "lat2"), projection.unproject(C("x"), C("y"), crs), strict=True)]).collect()
    assert abs(rows[0]["x"] - x) < 0.1 and abs(rows[0]["y"] - y) < 0.1
    assert all(abs(r["lon"] - r["lon2"]) < 1e-8 and abs(r["lat"] - r["lat2"]) < 1e-8 for r in rows)


def test_projection_texts(spark):
    feet = projection.from_wkt(prj("Transverse_Mercator", 0.3048, Central_Meridian=-75, False_Easting=1000, Scale_Factor=1))
    x, _ = projection.project(F.lit(-75.0), F.lit(40.0), feet)
    assert abs(spark.range(1).select(x).first()[0] - 1000) < 1e-6
    assert projection.from_wkt(CLARKE).kind == "geographic"
    with pytest.raises(ValueError, match="unknown projection"):
        projection.from_wkt(prj("Robinson"))


def test_a_shapefile_is_read_in_ranges_of_records(spark, tmp_path):
    place = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    k = C("id")
    d = spark.range(500).select(F.array(F.array(place(k, k), place(k + 1, k * 0), place(k, k + 2)), F.array(place(k, k), place(k, k + 1))).alias("parts"), k.alias("number"), F.when(k % 7 > 0, F.concat(F.lit("é "), k.cast("string"))).alias("name"))
    shapefile.write_shapes(d.coalesce(1), str(tmp_path / "s"), shapefile.LINE, ["number", "name"])
    whole = sorted(map(str, shapefile.read_shapes(spark, str(tmp_path / "s")).collect()))
    parts = shapefile.read_shapes(spark, str(tmp_path / "s"), records=37)
    assert parts.rdd.getNumPartitions() == 14 and sorted(map(str, parts.collect())) == whole and len(whole) == 1000
    assert {r["properties"]["name"] for r in parts.where("shape IN (7, 8)").collect()} == {None, "é 8"}


@pytest.mark.parametrize("size", [61, 500, 1 << 26])
def test_a_collection_of_one_line_is_read_in_ranges(spark, tmp_path, size):
    """Brackets, quotes and backslashes in names, objects of the features' depth that are none, ranges that begin anywhere."""
    draw = random.Random(1)
    features = [{"type": "Feature", "properties": {"id": i, "name": "".join(draw.choice('ab{}[]"\\ é') for _ in range(draw.randrange(20))), "more": {"x": [1, {"y": 2}]}}, "geometry": {"type": "LineString", "coordinates": [[draw.random(), i], [1, 2]]}} for i in range(60)]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::26918"}}, "name": 't{["', "features": features}
    (tmp_path / "c.json").write_text(json.dumps(doc, ensure_ascii=False))
    got = files.read_features(spark, f"{tmp_path}/c.json", True, size).collect()
    assert sorted((r["feature"], int(r["properties"]["id"]), r["properties"]["name"]) for r in got) == [(i, i, f["properties"]["name"]) for i, f in enumerate(features)]
    assert files.read_crs(f"{tmp_path}/c.json") == "urn:ogc:def:crs:EPSG::26918"


def test_collections_are_written_and_name_their_crs(spark, tmp_path):
    d = spark.range(5).select("id", F.concat(F.lit('{"type": "Feature", "properties": {"id": '), C("id").cast("string"), F.lit('}, "geometry": {"type": "Point", "coordinates": [1, 2]}}')).alias("value"))
    assert files.write_collection(d.repartition(3), f"{tmp_path}/o.json", ["id"]) == 5
    assert [f["properties"]["id"] for f in json.loads((tmp_path / "o.json").read_text())["features"]] == list(range(5))
    assert files.read_crs(f"{tmp_path}/o.json") == files.WGS84
    assert files.write_collection(d.limit(0), f"{tmp_path}/e.json", ["id"]) == 0 and files.read_features(spark, f"{tmp_path}/e.json").count() == 0


def test_doubles_and_shapes_as_binary(spark):
    values = [0.0, -0.0, 1.0, -1.5, 0.1, math.pi, -180.0, 1e-300, 5e-324, 2.0**-1022, 1.7e308, 2.0**52 + 0.5, 1 - 2**-53]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", geoparquet._double(C("v")).alias("b")).collect()
    assert all(struct.pack("<d", r["v"]) == bytes(r["b"]) for r in rows)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (0, 1))])
    (row,) = spark.range(1).select(geoparquet.wkb("Polygon", ring).alias("p"), geoparquet.wkb("Point", ring).alias("q")).collect()
    assert struct.unpack("<BIII8d", row["p"]) == (1, 3, 1, 4, 0, 0, 1, 0, 0, 1, 0, 0) and struct.unpack("<BI2d", row["q"]) == (1, 1, 0, 0)


def test_parts_in_convex_cells_are_the_same_by_either_way(spark):
    """Random edges, edges along sides, through corners and touches, on squares as rings and as polygons."""
    p = lambda x, y: (float(x), float(y))
    draw = random.Random(4)
    edges = [(i, i, *[draw.randrange(0, 9) / 2 for _ in range(4)]) for i in range(300)]
    e = spark.createDataFrame([r for r in edges if r[2:4] != r[4:]], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    ring = lambda x, y: [p(x, y), p(x + 1, y), p(x + 1, y + 1), p(x, y + 1)]
    cells = spark.createDataFrame([(4 * x + y, ring(x, y), [ring(x, y)]) for x in range(4) for y in range(4)], "cell_id long, ring array<struct<lon:double,lat:double>>, rings array<array<struct<lon:double,lat:double>>>")
    shown = lambda d: {(r["line"], r["cell_id"]): (round(r["t0"], 9), round(r["t1"], 9)) for r in d.collect()}
    a, b = shown(overlay.edges_in_rings(e, cells, 1.0)), shown(overlay.edges_in_polygons(e, cells, 1.0))
    assert a == b and any(x == y for x, y in a.values()) and any(x < y for x, y in a.values())


def test_an_edge_has_several_parts_in_a_comb_with_holes(spark):
    comb = [(0, 0), (7, 0), (7, 3), (6, 3), (6, 1), (5, 1), (5, 3), (4, 3), (4, 1), (3, 1), (3, 3), (0, 3)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    d = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in r] for r in (comb, hole)])], "cell_id long, rings array<array<struct<lon:double,lat:double>>>")
    e = spark.createDataFrame([(1, 1, -1.0, 1.5, 9.0, 1.5), (2, 1, 0.5, 0.5, 6.5, 0.5), (3, 1, -1.0, 3.0, 9.0, 3.0)], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    got = sorted((r["line"], round(r["t0"] * 10, 6), round(r["t1"] * 10, 6)) for r in overlay.edges_in_polygons(e, d, 2.0).where("t0 < t1").collect())
    assert got == [(1, 1, 2), (1, 3, 4), (1, 5, 6), (1, 7, 8), (2, 0, 10), (3, 1, 4), (3, 5, 6), (3, 7, 8)]


def test_circles_are_turned_without_circles(spark):
    """Triangles, double links and lines between equally far vertices: what is kept is a tree to the outlet."""
    draw = random.Random(2)
    edges = [("A", "O"), ("B", "O"), ("A", "B"), ("B", "A")] + [(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(150)] + [("n0", "O")]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "line long, start string, end string")
    turned = network.orient(d, "O")
    tree = network.remove_loops(turned, [F.desc("line")])
    down = {r["start"]: r["end"] for r in tree.collect()}
    for v in down:
        steps = 0
        while v != "O":
            v, steps = down[v], steps + 1
            assert steps <= len(down)
    assert {x for e in edges for x in e} - {"O"} == set(down)
    orders = network.strahler(network.downstream_lines(tree.select("line", "start", "end")))
    assert orders.count() == len(down)


def test_pruned_branches_follow_their_lower_ones(spark):
    """Ranks instead of walks: what is upstream of dropped lines goes too, whatever the shape of the forest."""
    draw = random.Random(5)
    down = {k: (None if k % 37 == 0 or k < 3 else draw.randrange(max(0, k - 6), k)) for k in range(300)}
    tree = spark.createDataFrame(list(down.items()), "line long, down long")
    dropped = {draw.randrange(300) for _ in range(12)}
    want = set()
    for k in down:
        at = k
        while at is not None and at not in dropped:
            at = down[at]
        if at is not None:
            want.add(k)
    ranks = hydro.upstream_ranks(tree).withColumnRenamed("line", "id")
    got = {r["id"] for r in hydro._upstream_of(ranks, spark.createDataFrame([(k,) for k in dropped], "id long"), block=16).collect()}
    assert got == want
