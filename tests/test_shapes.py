"""Operators that SQL does not express, against plain versions, and edge cases of files and configuration."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import geo
from fluvia.operators import case, hydro, mesh, overlay, reconstruct, shapes
from fluvia.sources import config, files, shapefile


def haversine(a, b):
    x1, y1, x2, y2 = map(math.radians, (*a, *b))
    return 2 * geo.RADIUS * math.asin(min(1, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))


def test_geodesic_of_a_surveyed_line(spark):
    d = lambda a, b, c: a + b / 60 + c / 3600
    lon, lat = geo.geodesic_point(F.lit(d(144, 25, 29.52440)), F.lit(-d(37, 57, 3.72030)), F.lit(d(306, 52, 5.37)), F.lit(54972.271))
    got = spark.range(1).select(lon, lat).first()
    assert math.isclose(got[0], d(143, 55, 35.38390), abs_tol=2e-8) and math.isclose(got[1], -d(37, 39, 10.15610), abs_tol=2e-8)


def test_hulls_of_few_points(spark):
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 0.0, 0.0), (3, 4.0, 0.0), (3, 2.0, 0.0), (3, 2.0, 1.0), (3, 2.0, 3.0), (3, None, 1.0), (None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = {r["id"]: [tuple(p) for p in r["ring"]] for r in shapes.convex_hulls(d).collect()}
    assert got == {1: [(0, 0)], 2: [(0, 0), (2, 2)], 3: [(0, 0), (4, 0), (2, 3)], None: [(1, 1)]}
    assert shapes.convex_hulls(d.limit(0)).count() == 0


def test_a_buffer_holds_what_is_near(spark):
    metres, line = 5000.0, [(10.0, 45.0), (10.3, 45.1), (10.35, 45.4), (10.1, 45.2)]
    edges = spark.createDataFrame([(7, i, *a, *b) for i, (a, b) in enumerate(zip(line, line[1:]))], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    sides = shapes.buffer_lines(edges, metres, 0.05, 36).cache()
    rng = np.random.default_rng(3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(9.8, 10.6, 1500), rng.uniform(44.8, 45.6, 1500)))]
    inside = {r["id"] for r in overlay.inside_rings(spark.createDataFrame(points, "id long, lon double, lat double"), sides, 0.05).collect()}

    def distance(p):
        steps = [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) for a, b in zip(line, line[1:]) for t in np.linspace(0, 1, 400)]
        return min(haversine(p, s) for s in steps)

    near = [(i, distance((x, y))) for i, x, y in points]
    assert {i for i, d in near if d < 0.985 * metres} <= inside and not {i for i, d in near if d > 1.01 * metres} & inside and len(inside) > 50


def test_a_grown_polygon_holds_the_polygon(spark):
    ring = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.4), (0.0, 0.4)]
    d = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in ring])], "id long, ring array<struct<lon:double,lat:double>>")
    sides = shapes.buffer_polygons(d, 10_000.0, 0.25, 36)
    points = [(1, 0.25, 0.2), (2, 0.58, 0.2), (3, 0.62, 0.2), (4, -0.05, -0.05), (5, -0.08, -0.08), (6, 0.25, 0.48)]
    assert {r["id"] for r in overlay.inside_rings(spark.createDataFrame(points, "id long, lon double, lat double"), sides, 0.25).collect()} == {1, 2, 4, 6}


def test_outlets_are_thinned_as_by_hand(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.uniform(0, 6)), float(rng.uniform(0, 6)), float(rng.integers(1, 40)), int(rng.integers(0, 2))) for i in range(150)]
    kept: list = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(haversine(r[1:3], k[1:3]) >= 80_000 or r[4] == k[4] == 1 for k in kept):
            kept.append(r)
    got = hydro.thin_outlets(spark.createDataFrame(rows, "line long, lon double, lat double, area double, endorheic int"), 80_000.0).collect()
    assert sorted(r["line"] for r in got) == sorted(r[0] for r in kept) and 10 < len(kept) < 150


def test_branches_are_pruned_as_by_hand(spark):
    rng = np.random.default_rng(9)
    down = {1: None} | {k: int(rng.integers(max(1, k - 12), k)) for k in range(2, 90)}
    ups = {k: [x for x in down if down[x] == k] for k in down}
    area, order = {}, {}
    for k in sorted(down, reverse=True):
        area[k] = 1.0 + sum(area[u] for u in ups[k])
        order[k] = 1 if not ups[k] else 2
    place = {k: [(float(x), float(y)) for x, y in zip(rng.uniform(0, 4, 3), rng.uniform(0, 4, 3))] for k in down}

    def path(k):
        while k:
            yield k
            k = down[k]

    def near(a, b):
        return any(haversine(p, q) < 25_000 for p in place[a] for q in place[b])

    kept: dict = {}
    for k in sorted(down, key=lambda k: (-area[k], k)):  # a lower line drains more than its branches
        if down[k] is None:
            kept[k] = True
        elif not kept[down[k]]:
            kept[k] = False
        elif order[k] > 1 and area[k] >= 0.05 * area[1]:
            kept[k] = True
        else:
            rivals = [b for b, yes in kept.items() if yes and down[b] != down[k] and b not in path(k) and k not in path(b) and near(k, b)]
            kept[k] = not rivals
    tree = spark.createDataFrame([(k, down[k], area[k], order[k]) for k in down], "line long, down long, area double, stream_order int")
    vertices = spark.createDataFrame([(k, x, y) for k, ps in place.items() for x, y in ps], "line long, lon double, lat double")
    assert {r["line"]: r["kept"] for r in hydro.prune_branches(tree, vertices, 25_000.0).collect()} == kept and 0 < sum(kept.values()) < 89


def test_a_forked_river_on_a_grid(spark):
    """A stem from north to south and a branch from the east, on cells of one degree; the stem runs through two corners on its way."""
    lines = {1: [(5.5, 9.5), (5.4, 7.2), (5.5, 5.5)], 2: [(9.5, 5.4), (5.5, 5.5)], 3: [(5.5, 5.5), (5.5, 3.5), (6.02, 3.01), (6.01, 2.9), (5.5, 2.5), (5.5, 0.5)]}
    rows = [(k, i, x, y, 0) for k, p in lines.items() for i, (x, y) in enumerate(p if k != 2 else p[::-1])]
    points = spark.createDataFrame(rows, "line long, pos long, lon double, lat double, dam int")
    cells = case.make_mesh(spark, config.template("case", sMesh_type="latlon", dResolution_degree=1.0, dLongitude_left=0, dLongitude_right=10, dLatitude_bot=0, dLatitude_top=10))
    simple = reconstruct.simplify(points, 5.5, 0.5).collect()
    assert sorted((r["segment"], r["stream_order"], r["downstream"]) for r in simple) == [(1, 1, 3), (2, 1, 3), (3, 2, None)]
    segments = {1: 2, 2: 1, 3: 3}
    flow = spark.createDataFrame([(k, i, x, y) for k, p in lines.items() for i, (x, y) in enumerate(p)], "line long, pos long, lon double, lat double")
    given = spark.createDataFrame([(k, v, 2 if k == 3 else 1) for k, v in segments.items()], "line long, segment long, stream_order long")
    built = reconstruct.conceptual(flow, given, cells, 1.0)
    cell = lambda x, y: y * 10 + x + 1
    edges = {(r["start"], r["end"]) for r in built["edges"].collect()}
    # the corner of cell (6, 3) is a short cut and left out, cell (6, 2) is not
    stem = [*[cell(5, y) for y in range(9, 2, -1)], cell(6, 2), *[cell(5, y) for y in range(2, -1, -1)]]
    branch = [cell(x, 5) for x in range(9, 4, -1)]
    assert edges == set(zip(stem, stem[1:])) | set(zip(branch, branch[1:]))
    assert sorted((r["segment"], r["stream_order"], r["downstream"], r["end"]) for r in built["segments"].collect()) == [(1, 1, 3, cell(5, 5)), (2, 1, 3, cell(5, 5)), (3, 2, None, cell(5, 0))]
    run = case.run_basin(points, config.template("basin", dLongitude_outlet_degree=5.5, dLatitude_outlet_degree=0.5), cells, 1.0)
    burnt = {r["cell_id"]: (r["segment"], r["stream_order"], r["downstream"]) for r in run["burnt"].collect()}
    assert burnt[cell(5, 3)] == (3, 2, cell(6, 2)) and burnt[cell(6, 2)] == (3, 2, cell(5, 2)) and burnt[cell(8, 5)][2] == cell(7, 5) and burnt[cell(0, 0)] == (-1, -1, -1)
    numbers = {r["network"]: (r["segments"], r["orders"]) for r in case.lengths(run).collect()}
    assert numbers == {"simplified": (3, 2), "conceptual": (3, 2)}
    assert case.evaluate(run, cells, 1.0).first()["area"] >= 0


def test_walks_lose_their_returns(spark):
    walk = [1, 2, 3, 2, 4, 1, 5, 5, 6]
    d = spark.createDataFrame([(9, i + 1, c) for i, c in enumerate(walk)] + [(8, 1, 7)], "line long, pos long, cell_id long")
    got = sorted((r["line"], r["pos"], r["cell_id"]) for r in reconstruct.erase_returns(d).collect())
    assert got == [(8, 1, 7), (9, 1, 1), (9, 7, 5), (9, 9, 6)]


def test_equal_places_across_a_border_of_squares(spark):
    base = 123.456
    rows = [(1, base, 1e-9 * 0.5), (2, base + 0.9e-9, -1e-9 * 0.4), (3, base + 1.1e-9, 0.0)]
    d = spark.createDataFrame(rows, "id long, lon double, lat double")
    a = d.withColumn("k", geo.tolerance_keys(F.col("lon"), F.col("lat"))[0])
    b = d.toDF("other", "x", "y").withColumn("k", F.explode(geo.tolerance_keys(F.col("x"), F.col("y"))[1]))
    got = {(r["id"], r["other"]) for r in a.join(b, "k").where(geo.same_vertex(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (2, 3), (3, 2)}


def test_shapefiles_of_odd_rows(spark, tmp_path):
    kind = "id long, name string, parts array<array<struct<lon:double,lat:double>>>"
    at = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    rows = [(1, "Größe", [at((0, 0), (1, 1)), at((2, 2), (3, 3), (3, 3), (4, 4))]), (2, None, [at((5, 5), (6, 6))]), (3, "x" * 300, [at((7, 7), (7, 7))])]
    rows = [(i, n, [[{k: float(v) for k, v in p.items()} for p in part] for part in parts]) for i, n, parts in rows]
    d = spark.createDataFrame(rows, kind).coalesce(1)
    assert shapefile.write_shapes(d, str(tmp_path / "s"), shapefile.LINE, ["id", "name"]) == 3
    got = shapefile.read_lines(spark, str(tmp_path / "s")).orderBy("shape", "part").collect()
    assert [(r["properties"]["id"], r["part"], len(r["points"])) for r in got] == [("1", 0, 2), ("1", 1, 3), ("2", 0, 2)]
    assert got[0]["properties"]["name"] == "Größe" and got[2]["properties"]["name"] is None
    assert len(shapefile.read_shapes(spark, str(tmp_path / "s")).where("shape = 2").first()["properties"]["name"]) == 254
    assert shapefile.write_shapes(d.limit(0), str(tmp_path / "e"), shapefile.LINE, ["id"]) == 0


def test_text_that_is_no_line(spark):
    rows = [("LINESTRING (1 2, 3.5 -4)",), ("POINT (0 0)",), ("POLYGON ((0 0))",), ("",), (None,)]
    d = spark.createDataFrame(rows, "t string").select(files.from_wkt(F.col("t")).alias("p"))
    assert [r["p"] and [tuple(x) for x in r["p"]] for r in d.collect()] == [[(1, 2), (3.5, -4)], [(0, 0)], None, None, None]


def test_configuration_is_checked(spark, tmp_path):
    basin = config.template("basin")
    with pytest.raises(KeyError):
        config.set_parameter(basin, "iFlag_dum", 1)
    with pytest.raises(TypeError):
        config.set_parameter(basin, "iFlag_dam", "1")
    path = str(tmp_path / "c.json")
    config.write_json(spark, {"nOutlet": 3}, path)
    config.edit_json(spark, path, {"sMesh_type": "square"})
    assert config.read_case(spark, path, nOutlet=None, iCase_index=4)["iCase_index"] == 4 and config.read_json(spark, path) == {"nOutlet": 3, "sMesh_type": "square"}


def test_flat_hexagons_share_their_sides(spark):
    cells = mesh.hexagon_flat(spark, 0.0, 0.0, 2.0, 5, 6)
    pairs = {(r["a"], r["b"]) for r in mesh.shared_edges(cells).collect()}
    listed = {(r["cell_id"], n) for r in cells.collect() for n in r["neighbors"]}
    assert {(a, b) for a, b in listed if a < b} == pairs and all((b, a) in listed for a, b in listed)
