"""Files, small-river rounds and edge cases of the overlay helpers against plain versions."""

import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fluvia.operators import mesh, network, overlay
from fluvia.plans import base
from fluvia.sources import files

SF = "/root/testdata/sf0.001"


def plain_rounds(lines: dict, outlet: int, threshold: float) -> dict:
    """line -> (start, end, length, dam) after three rounds, one line at a time."""
    heads = lambda d: {k for k, v in d.items() if v[0] not in {x[1] for x in d.values()}}
    for _ in range(3):
        if len(lines) > 1:
            top = heads(lines)
            lines = {k: v for k, v in lines.items() if v[3] or k not in top or v[2] > threshold}
        top, touching = heads(lines), Counter()
        for v in lines.values():
            touching.update(v[:2])
        for k in top:
            if lines[k][1] != outlet:
                touching[lines[k][0]] = 1
        below = {v[0]: k for k, v in sorted(lines.items())}
        chains = defaultdict(list)
        for k in lines:
            root, steps = k, 0
            while touching[lines[root][1]] == 2 and lines[root][1] != outlet and lines[root][1] in below:
                root, steps = below[lines[root][1]], steps + 1
            chains[root].append((steps, k))
        lines = {r: (lines[max(c)[1]][0], lines[r][1], sum(lines[k][2] for _, k in c), max(lines[k][3] for _, k in c)) for r, c in chains.items()}
    return lines


def test_small_river_rounds(spark):
    river = base.river(spark, SF)
    want = plain_rounds({r["line"]: (r["start"], r["end"], r["length"], r["dam"]) for r in river.collect()}, 0, 400_000.0)
    got = {r["line"]: (r["start"], r["end"], r["length"], r["dam"]) for r in network.small_river_rounds(river, 0, 400_000.0).collect()}
    assert {k: (v[0], v[1], round(v[2], 3), v[3]) for k, v in got.items()} == {k: (v[0], v[1], round(v[2], 3), v[3]) for k, v in want.items()}


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    other = spark.createDataFrame([(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["node"]: r["root"] for r in network.components(chain.union(other)).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000: 1000, 1001: 1000}
    assert network.components(chain.limit(0)).count() == 0


def test_points_meet_across_the_date_line_and_at_the_pole(spark):
    p = spark.createDataFrame([(1, 179.99999, 0.0), (2, 10.0, 90.0), (3, 50.0, 50.0)], "id long, lon double, lat double")
    o = spark.createDataFrame([(7, -179.99999, 0.0), (8, -120.0, 90.0), (9, 50.1, 50.0)], "other long, lon double, lat double")
    assert sorted(overlay.snap(p, o, 5.0).collect()) == [(1, 7), (2, 8)]
    assert overlay.within(p.limit(0), o, 5.0).count() == 0


def test_loops_are_erased(spark):
    d = spark.createDataFrame([([1, 2, 3, 2, 4, 1, 5],), ([1, 2, 3, 2, 4],), ([],), ([6, 6],), (None,)], "c array<long>")
    assert [r[0] for r in d.select(overlay.erase_loops(F.col("c"))).collect()] == [[1, 5], [1, 2, 4], [], [6], None]


def test_cubed_sphere_covers_the_sphere(spark):
    cells = mesh.cubed_sphere(spark, 4).collect()
    assert len(cells) == 96 and len({(round(c["lon"], 6), round(c["lat"], 6)) for c in cells}) == 96
    corners = Counter((round(p["lon"], 6) % 360, round(p["lat"], 6)) for c in cells for p in c["ring"])
    assert sum(n == 3 for n in corners.values()) == 8 and set(corners.values()) == {3, 4}


def test_feature_collections(spark, tmp_path):
    line = lambda kind, at, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": at}}
    doc = {"type": "FeatureCollection", "features": [
        line("LineString", [[0, 0], [0, 0], [1, 2.5]], lineid=4), line("MultiLineString", [[[0, 0], [1, 1]], [[5, 5], [6, 6], [6, 6]]]),
        {"type": "Feature", "properties": None, "geometry": None}, line("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]], cellid=9)]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    got = files.read_lines(spark, str(tmp_path / "a.geojson")).orderBy("feature", "part").collect()
    assert [(r["feature"], r["part"], [tuple(p) for p in r["points"]]) for r in got] == [(0, 0, [(0, 0), (1, 2.5)]), (1, 0, [(0, 0), (1, 1)]), (1, 1, [(5, 5), (6, 6)])]
    assert got[0]["properties"]["lineid"] == "4"
    rings = files.read_rings(spark, str(tmp_path / "a.geojson")).collect()
    assert [tuple(p) for p in rings[0]["ring"]] == [(0, 0), (1, 0), (1, 1)] and rings[0]["properties"] == {"cellid": "9"}


def test_dam_table_and_placemark(spark, tmp_path):
    (tmp_path / "dams.csv").write_text('lat,lon,a,b,name,id\n40.5,-77,x,y,"Dam, upper",12\n,,,,,\n')
    assert [tuple(r) for r in files.read_dams(spark, str(tmp_path / "dams.csv")).collect()] == [(40.5, -77.0, "Dam, upper", 12), (None, None, None, None)]
    ring = F.expr("array(struct(0.0D AS lon, 1.5D AS lat), struct(2.0D AS lon, 3.0D AS lat))")
    text = spark.range(1).select(files.kml_placemark(F.lit("a<b"), ring)).first()[0]
    assert "<name>a&lt;b</name>" in text and "0.0,1.5 2.0,3.0 0.0,1.5" in text
