"""Cases that a reviewer's odd inputs and larger tables brought up, each in small."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fluvia import queries
from fluvia.functions import geo
from fluvia.operators import network, overlay, raster, shapes
from fluvia.sources import shapefile
from tests.compare import difference

C = F.col


def table_dir(spark, tmp_path, **tables) -> str:
    """A folder of tables as the registered queries read them."""
    for name, d in tables.items():
        d.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def opened(sf_dir: str, *tables: str):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    return con


def events(spark, users: list[int], each: int):
    """``each`` events of every user, numbered through, a second apart."""
    ids = spark.range(len(users) * each)
    user = F.element_at(F.array(*[F.lit(u).cast("long") for u in users]), (C("id") % len(users) + 1).cast("int"))
    return ids.select((C("id") * 37 + 5).alias("event_id"), F.timestamp_seconds(C("id")).alias("ts"), user.alias("user_id"))


def test_areas_beyond_a_pole_are_summed(spark, tmp_path):
    """Users above 1,440 have latitudes beyond 90 degrees in this fixture: their faces count as all others."""
    sf = table_dir(spark, tmp_path, events=events(spark, [3, 1439, 1441, 2000, 4321], 12))
    assert difference(queries.QUERIES["agg_sum_area"](spark, sf), opened(sf, "events"), queries.ORACLES["agg_sum_area"]) == ""


def test_faces_beyond_a_pole_have_their_areas(spark, tmp_path):
    sf = table_dir(spark, tmp_path, events=events(spark, [1440, 1442, 2000, 4321], 9))
    assert difference(queries.QUERIES["topo_area_diff"](spark, sf), opened(sf, "events"), queries.ORACLES["topo_area_diff"]) == ""


def test_ends_on_a_border_touch_no_cell(spark):
    """Ends on a border from the left and from below, an edge along a border, and one through a corner."""
    r = raster.Raster(0.0, 0.0, 1.0, 4, 4)
    rows = [(1, 0.5, 0.5, 1.0, 0.5), (2, 0.5, 0.5, 0.5, 1.0), (3, 1.0, 0.2, 1.0, 0.8), (4, 0.5, 1.5, 1.5, 0.5), (5, 1.5, 0.5, 1.0, 0.5), (6, 0.5, 0.5, 3.5, 2.5)]
    edges = spark.createDataFrame([(k, 1, *e) for k, *e in rows], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    boxes = raster.cells(spark, r).select("cell_id", *[(C(c) + s).alias(n) for c, s, n in (("lon", -0.5, "x1"), ("lat", -0.5, "y1"), ("lon", 0.5, "x2"), ("lat", 0.5, "y2"))])
    got = {tuple(x) for x in raster.line_cells(edges, r).collect()}
    assert {(k, c) for k, c in got if k < 6} == {(1, 1), (2, 1), (3, 2), (4, 5), (4, 2), (5, 2)}
    assert got == {tuple(x) for x in overlay.edges_in_cells(edges, boxes, 1.0).select("line", "cell_id").collect()}


def test_lengths_are_rounded_as_in_sql(spark, tmp_path):
    """Events whose distances lie a last bit from the middle between two roundings."""
    pairs = [(2424040, 1032804), (355374, 3184261), (114964, 987366), (1762190, 1309790), (1461064, 4511384), (1287374, 2148743), (818012, 3566843)]
    rows = [(e, i, u) for u, pair in enumerate(pairs) for i, e in enumerate(pair)]
    d = spark.createDataFrame(rows, "event_id long, i long, user_id long").select("event_id", F.timestamp_seconds("i").alias("ts"), "user_id")
    sf = table_dir(spark, tmp_path, events=d)
    assert difference(queries.QUERIES["geo_haversine_array"](spark, sf), opened(sf, "events"), queries.ORACLES["geo_haversine_array"]) == ""


def plan(d) -> str:
    return d._jdf.queryExecution().toString()


def test_edges_are_buffered_row_by_row(spark):
    """No group of points is handed to Python an edge, and circles in numpy are those of the expression."""
    edges = spark.createDataFrame([(1, 1, -80.0, 35.0, -75.0, 41.0), (2, 1, 179.9, 10.0, -179.9, 10.0)], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    d = shapes.buffer_edges(edges, 100_000.0, 12)
    assert "FlatMapGroupsInPandas" not in plan(d) and all(len(r["ring"]) > 3 for r in d.collect())
    at = edges.select(geo.circle(C("lon1"), C("lat1"), F.lit(5000.0), 12).alias("c")).collect()
    lon, lat = geo.circle_places(np.array([-80.0, 179.9]), np.array([35.0, 10.0]), 5000.0, 12)
    assert np.allclose([[(p["lon"], p["lat"]) for p in r["c"]] for r in at], np.stack([lon, lat], axis=2), atol=1e-11)


def lines(spark, rows: list[tuple], copies: int, first: int = 0):
    """``copies`` lines of the same edges (lon1, lat1, lon2, lat2)."""
    return spark.createDataFrame([(first + k, i, *r) for k in range(copies) for i, r in enumerate(rows)], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")


def test_pieces_between_foreign_vertices_are_cut_by_different_places(spark):
    """Places and edges that many lines share meet once, before the lines' names are joined."""
    e = lines(spark, [(0.0, 0.0, 0.1, 0.0), (0.1, 0.0, 0.1, 0.1)], 3)
    p = spark.createDataFrame([(1, 0.03, 0.0), (2, 0.03, 0.0), (3, 0.06, 0.0), (4, 0.1, 0.04)], "id long, lon double, lat double")
    found = overlay.places_on_edges(e, p)
    assert found.count() == 3 and "Aggregate" in plan(found)
    got = {(r["line"], r["piece"]): [(q["lon"], q["lat"]) for q in r["points"]] for r in network.split_at_foreign(e, p).collect()}
    assert got == {(k, i + 1): v for k in range(3) for i, v in enumerate([[(0.03, 0.0), (0.06, 0.0)], [(0.06, 0.0), (0.1, 0.0), (0.1, 0.04)]])}


def test_points_on_shared_edges_are_named_after_they_are_found(spark):
    e = lines(spark, [(0.0, 0.0, 0.1, 0.0)], 4)
    p = spark.createDataFrame([(1, 0.03, 0.0), (2, 0.03, 0.0), (3, 0.05, 0.01)], "id long, lon double, lat double")
    d = overlay.points_on_edges(e, p)
    assert "Aggregate" in plan(d) and sorted((r["line"], r["id"]) for r in d.collect()) == [(k, i) for k in range(4) for i in (1, 2)]


def test_shared_edges_meet_once_by_the_least_line(spark):
    a, b = lines(spark, [(0.0, 0.0, 1.0, 1.0)], 3), lines(spark, [(0.0, 1.0, 1.0, 0.0), (0.5, 0.5, 0.75, 0.75)], 3, 7)
    d = overlay.meetings(a, b, 0.25)
    assert plan(d).split("== Optimized")[1].split("== Physical")[0].count("Aggregate") >= 3
    assert {(r["lon"], r["lat"], r["line"]) for r in d.collect()} == {(0.5, 0.5, 7)}


def test_shared_edges_cross_once(spark):
    a, b = lines(spark, [(0.0, 0.0, 1.0, 1.0)], 3), lines(spark, [(0.0, 1.0, 1.0, 0.0)], 2, 7)
    d = overlay.crossings(a, b, 0.25)
    assert "Aggregate" in plan(d)
    assert sorted(tuple(r) for r in d.collect()) == [(k, 0, m, 0, 0.5, 0.5, 0.5) for k in range(3) for m in (7, 8)]


def test_crossings_of_a_shared_edge_are_ordered_once(spark):
    """The window is over different edges of a, whose lines are joined after it."""
    a, b = lines(spark, [(0.0, 0.0, 1.0, 1.0)], 3), lines(spark, [(0.0, 1.0, 1.0, 0.0), (0.0, 0.5, 0.5, 0.0)], 2, 7)
    d = overlay.ordered_crossings(a, b, 0.25, 9)
    assert sorted(tuple(r) for r in d.collect()) == [(k, 0, m, p, n) for k in range(3) for m, p, n in ((7, 0, 3), (7, 1, 1), (8, 0, 4), (8, 1, 2))]
    assert "Join" in plan(d).split("== Optimized")[1].split("Window")[0]


def test_many_ranges_of_records_are_few_tasks(spark, tmp_path, monkeypatch):
    """Ranges of one record each are joined, and what a task writes beyond a number of shapes goes to another file; all is read."""
    d = spark.range(500).select(F.array(F.array(*[F.struct((C("id") + i).cast("double").alias("lon"), F.lit(1.0).alias("lat")) for i in (0, 1)])).alias("parts"), C("id").alias("k")).coalesce(1)
    assert shapefile.write_shapes(d, str(tmp_path / "s"), shapefile.LINE, ["k"]) == 500
    got = shapefile.read_shapes(spark, str(tmp_path / "s"), records=1)
    assert got.rdd.getNumPartitions() <= 64 and sorted(int(r["properties"]["k"]) for r in got.collect()) == list(range(500))

    class Context:
        partitionId = taskAttemptId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(shapefile, "_MOST_SHAPES", 200)
    monkeypatch.setattr(shapefile.TaskContext, "get", lambda: Context)
    (tmp_path / "w").mkdir()
    batch = pa.RecordBatch.from_pylist([{"parts": [[{"lon": float(i), "lat": 0.0}, {"lon": 1.0, "lat": float(i)}]], "k": i} for i in range(500)])
    assert [b.to_pylist() for b in shapefile._writer(f"file://{tmp_path}/w", shapefile.LINE, ["k"], None)(iter([batch]))] == [[{"shapes": 500}]]
    assert sorted(p.name for p in (tmp_path / "w").glob("*.shp")) == ["part-00000-1.shp", "part-00000-2.shp", "part-00000.shp"]
    assert sorted(int(r["properties"]["k"]) for r in shapefile.read_shapes(spark, str(tmp_path / "w")).collect()) == list(range(500))
