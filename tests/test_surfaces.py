"""Dual meshes on the sphere, spacing limited in slope, polygons as cells, and rings over the date line and the poles."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
from pyspark.sql import functions as F

from fluvia.functions import geo
from fluvia.operators import mesh, overlay, raster
from fluvia.sources import config

C = F.col


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6378137 * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))


def test_corners_of_a_dual_cell_are_as_far_from_three_points(spark):
    """An octahedron, across the date line and round both poles: every cell has four corners, 54.7 degrees from its point."""
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0), (3, 180.0, 0.0), (4, -90.0, 0.0), (5, 0.0, 90.0), (6, 0.0, -90.0)], "id long, lon double, lat double")
    ring = [1, 2, 3, 4]
    faces = [(i, ring[i], ring[(i + 1) % 4], 5) for i in range(4)] + [(4 + i, ring[(i + 1) % 4], ring[i], 6) for i in range(4)]
    d = mesh.dual(spark.createDataFrame(faces, "triangle long, a long, b long, c long"), points).collect()
    assert len(d) == 6
    for r in d:
        assert not r["open"] and len(r["ring"]) == 4 and len(r["neighbors"]) == 4
        far = [haversine(r["lon"], r["lat"], p["lon"], p["lat"]) / 6378137 for p in r["ring"]]
        assert np.allclose(far, math.acos(1 / math.sqrt(3)))
    few = mesh.dual(spark.createDataFrame(faces[:3], "triangle long, a long, b long, c long"), points)
    state = {r["cell_id"]: (r["open"], len(r["ring"]), r["neighbors"]) for r in few.collect()}
    assert state[5] == (True, 3, [1, 2, 3, 4]) and state[1] == (True, 1, [2, 5]) and 6 not in state
    fan = {r["cell_id"]: [round(p["lon"]) for p in r["ring"]] for r in few.collect()}[5]
    assert fan == [45, 135, -135]  # from one border to the other


def test_spacing_is_limited_in_slope(spark):
    """Least sums of slope times way over the eight neighbours, as by Dijkstra."""
    r = raster.Raster(-80.0, 40.0, 0.25, 12, 15)
    low = {7: 500.0, 100: 900.0, 101: 3000.0}
    layers = [(spark.createDataFrame([(c,)], "cell_id long"), v) for c, v in low.items()]
    got = {x["cell_id"]: x["spacing"] for x in raster.spacing(spark, r, layers, 4000.0, 0.05).collect()}
    best = dict(low)
    todo = [(v, c) for c, v in low.items()]
    while todo:
        v, c = heapq.heappop(todo)
        if v > best[c]:
            continue
        row, col = divmod(c - 1, r.columns)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if (i or j) and 0 <= row + i < r.rows and 0 <= col + j < r.columns:
                    x, y = r.x0 + (col + 0.5) * r.step, r.y0 + (row + 0.5) * r.step
                    w, k = v + 0.05 * haversine(x, y, x + j * r.step, y + i * r.step), (row + i) * r.columns + col + j + 1
                    if w < best.get(k, 4000.0):
                        best[k] = w
                        heapq.heappush(todo, (w, k))
    assert len(got) == 180 and all(abs(v - best.get(c, 4000.0)) < 1e-6 for c, v in got.items()) and sum(v < 4000 for v in got.values()) > 20
    plain = {x["cell_id"]: x["spacing"] for x in raster.spacing(spark, r, layers, 4000.0).collect()}
    assert plain == {c: low.get(c, 4000.0) for c in range(1, 181)}


def test_polygons_with_holes_become_cells(spark):
    draw = random.Random(3)
    r = raster.Raster(0.0, 0.0, 1.0, 20, 20)
    corners = [(10 + draw.uniform(3, 9) * math.cos(a), 10 + draw.uniform(3, 9) * math.sin(a)) for a in np.arange(0, 2 * math.pi, 0.4)]
    hole = [(9.2, 9.1), (9.3, 11.4), (11.2, 11.3), (11.4, 9.3)]
    sides = [(1, *a, *b) for ring in (corners, hole) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    got = {x["cell_id"] for x in raster.polygon_cells(spark.createDataFrame(sides, "polygon long, lon1 double, lat1 double, lon2 double, lat2 double"), r).collect()}
    inside = lambda x, y: sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) for _, x1, y1, x2, y2 in sides) % 2
    assert got == {row * 20 + col + 1 for row in range(20) for col in range(20) if inside(col + 0.5, row + 0.5)}


def test_rings_and_edges_meet_over_the_date_line_and_at_poles(spark):
    p = lambda *xy: [(float(x), float(y)) for x, y in xy]
    rings = [(1, p((179, -1), (-179, -1), (-179, 1), (179, 1))), (2, p((0, 80), (90, 80), (180, 80), (-90, 80))), (3, p((10, -1), (12, -1), (12, 1), (10, 1))), (4, p((-90, -70), (180, -70), (90, -70), (0, -70)))]
    cells = spark.createDataFrame(rings, "cell_id long, ring array<struct<lon:double,lat:double>>")
    shape = {r["cell_id"]: [(q["lon"], q["lat"]) for q in r["w"]] for r in cells.select("cell_id", overlay.unwrapped_ring(C("ring")).alias("w")).collect()}
    assert shape[1] == p((179, -1), (181, -1), (181, 1), (179, 1)) and shape[3] == rings[2][1]
    assert {y for _, y in shape[2]} == {80.0, 90.0} and max(x for x, _ in shape[2]) - min(x for x, _ in shape[2]) == 360 and {y for _, y in shape[4]} == {-70.0, -90.0}
    edges = [(1, 178.0, 0.0, -178.0, 0.0), (2, -179.5, 0.0, -170.0, 0.0), (3, 170.0, 0.5, 179.5, 0.5), (4, 45.0, 70.0, 45.0, 88.0), (5, 9.0, 0.0, 13.0, 0.0), (6, -45.0, -60.0, -45.0, -80.0), (7, -178.0, 0.0, 178.0, 0.0)]
    e = spark.createDataFrame([(i, 1, *r) for i, *r in edges], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {(r["line"], r["cell_id"]): (round(r["t0"], 6), round(r["t1"], 6)) for r in overlay.edges_round_the_globe(e, cells, 5.0).where("t0 < t1").collect()}
    assert got == {(1, 1): (0.25, 0.75), (7, 1): (0.25, 0.75), (2, 1): (0.0, round(0.5 / 9.5, 6)), (3, 1): (round(9 / 9.5, 6), 1.0), (4, 2): (round(10 / 18, 6), 1.0), (5, 3): (0.25, 0.75), (6, 4): (0.5, 1.0)}


def test_great_circles_hold_points_outside_of_their_box(spark):
    """The middle of a long edge along a parallel lies towards the pole."""
    e = spark.createDataFrame([(1, 1, 0.0, 60.0, 2.0, 60.0)], "line long, pos long, lon1 double, lat1 double, lon2 double, lat2 double")
    lon, lat = geo.midpoint(F.lit(0.0), F.lit(60.0), F.lit(2.0), F.lit(60.0))
    points = spark.range(1).select(C("id"), lon.alias("lon"), lat.alias("lat")).unionByName(spark.createDataFrame([(1, 1.0, 60.0), (2, 0.0, 60.0)], "id long, lon double, lat double"))
    assert [r["id"] for r in overlay.points_on_edges(e, points).collect()] == [0]


def test_spacing_follows_the_settings(spark):
    settings = config.template("spacing", ncolumn_space=36, nrow_space=18, dResolution_dam=4.0, dResolution_land=45.0)
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "cell_id long")
    got = {r["cell_id"]: r["spacing"] for r in raster.spacing_of(spark, settings, {"land": one(*range(1, 649)), "dam": one(300, 300)}).collect()}
    assert len(got) == 648 and got[300] == 4000.0 and {v for c, v in got.items() if c != 300} == {45_000.0}  # cells are wider than the slope reaches
