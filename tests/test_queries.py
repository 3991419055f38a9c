"""Every registered query of the core against its SQL over the smallest tables."""

import pytest
from pyspark.sql import functions as F

from fluvia import queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_outlets_are_sorted(spark, con):
    got = [tuple(r) for r in queries.QUERIES["sort_area_all"](spark, SF).collect()]
    assert len(got) == 150 and got == con.execute(queries.ORACLES["sort_area_all"]).fetchall()


def test_duplicates_are_counted_without_lists(spark):
    assert "collect_list" not in queries.QUERIES["prd_dup_check"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) == ""


def test_all_parts_of_shapefile_lines_are_read(spark):
    got = queries.QUERIES["src_shp_flowline"](spark, SF).groupBy("line", "part").agg(F.count("*").alias("n"), F.max("n"), F.max("dam")).collect()
    lines = {r["line"] for r in got}
    assert len(lines) == 149 and {(r["line"], r["part"]): r["n"] for r in got} == {(k, p): 2 + p for k in lines for p in (0, 1) if p == 0 or k % 5 == 0}
    assert all(r["n"] == r["max(n)"] and r["max(dam)"] == (r["line"] % 97 == 0) for r in got)


def test_all_features_of_the_grid_file_are_read_with_their_neighbors(spark):
    got = {r["cell_id"]: r for r in queries.QUERIES["src_dggrid_geojson"](spark, SF).collect()}
    assert set(got) == set(range(1, 885)) and sum(r["customer"] is not None for r in got.values()) == 150
    assert all(0 not in r["neighbors"] and k in got[n]["neighbors"] for k, r in got.items() for n in r["neighbors"])
