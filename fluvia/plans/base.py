"""Tables that the registered queries derive from the test data, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import network


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered points, one line a user in the order of (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    lon = ((F.col("event_id") * 7919) % 360000).cast("double") / 1000.0 - 180.0
    lat = ((F.col("event_id") * 104729) % 160000).cast("double") / 1000.0 - 80.0
    return e.select(F.col("user_id").alias("line"), "event_id", "ts", lon.alias("lon"), lat.alias("lat"))


SCATTERED = """
v2 AS (SELECT user_id AS line, event_id, ts,
  CAST((event_id*7919)%360000 AS DOUBLE)/CAST(1000 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
  CAST((event_id*104729)%160000 AS DOUBLE)/CAST(1000 AS DOUBLE) - CAST(80 AS DOUBLE) AS lat FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.split_to_edges(scattered(spark, sf_dir), "line", ["ts", "event_id"])


EDGES = (
    SCATTERED
    + """,
w2 AS (SELECT line, CAST(row_number() OVER w AS BIGINT) AS pos, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2
  FROM v2 WINDOW w AS (PARTITION BY line ORDER BY ts, event_id)),
e AS (SELECT * FROM w2 WHERE lon2 IS NOT NULL AND (lon1 <> lon2 OR lat1 <> lat2))"""
)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each inner vertex (lon, lat) with the one before (lon1, lat1) and after (lon2, lat2)."""
    w = Window.partitionBy("line").orderBy("ts", "event_id")
    d = scattered(spark, sf_dir).select("line", "event_id", "lon", "lat", *[f(c).over(w).alias(c + n) for f, n in ((F.lag, "1"), (F.lead, "2")) for c in ("lon", "lat")])
    return d.where("lon1 IS NOT NULL AND lon2 IS NOT NULL")


TRIPLES = (
    SCATTERED
    + """,
w3 AS (SELECT line, event_id, lon, lat, lag(lon) OVER w AS lon1, lag(lat) OVER w AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2
  FROM v2 WINDOW w AS (PARTITION BY line ORDER BY ts, event_id)),
t AS (SELECT * FROM w3 WHERE lon1 IS NOT NULL AND lon2 IS NOT NULL)"""
)


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small-step trajectories inside the mesh of ``cells``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    move = lambda k: F.sum((F.col("event_id") * k) % 2001 - 1000).over(w).cast("double") / 20000.0
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        u.alias("line"), "event_id", F.row_number().over(w).cast("long").alias("pos"),
        ((u % 10 - 80).cast("double") + move(7919)).alias("lon"), ((F.floor(u / 10) % 10 + 35).cast("double") + move(104729)).alias("lat"),
    )


WALKS = """
w8 AS (SELECT user_id AS line, event_id, CAST(row_number() OVER w AS BIGINT) AS pos,
  CAST(-80 + user_id % 10 AS DOUBLE) + CAST(CAST(sum((event_id*7919)%2001-1000) OVER w AS BIGINT) AS DOUBLE)/CAST(20000 AS DOUBLE) AS lon,
  CAST(35 + CAST(floor(user_id/10) AS BIGINT) % 10 AS DOUBLE) + CAST(CAST(sum((event_id*104729)%2001-1000) OVER w AS BIGINT) AS DOUBLE)/CAST(20000 AS DOUBLE) AS lat
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def cells(spark: SparkSession) -> DataFrame:
    """625 boxes of half a degree."""
    i = F.col("id")
    x, y = F.lit(-81.25) + (i % 25).cast("double") / 2.0, F.lit(34.0) + F.floor(i / 25).cast("double") / 2.0
    return spark.range(625).select((i + 1).alias("cell_id"), x.alias("x1"), y.alias("y1"), (x + 0.5).alias("x2"), (y + 0.5).alias("y2"))


CELLS = """
c5 AS (SELECT i + 1 AS cell_id, CAST(-81.25 AS DOUBLE) + CAST(i % 25 AS DOUBLE)/CAST(2 AS DOUBLE) AS x1, CAST(34 AS DOUBLE) + CAST((i - i % 25)/25 AS DOUBLE)/CAST(2 AS DOUBLE) AS y1 FROM range(625) r(i))"""


def shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced tree: line k runs from node k to node k / 2; line 1 ends at the outlet 0."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").where("o_orderkey >= 1").select(k.alias("line"), k.alias("start"), ((k - k % 2) / 2).cast("long").alias("end"))
    return d.withColumn("down", F.when(F.col("end") > 0, F.col("end")))


SHALLOW = "f3 AS (SELECT o_orderkey AS k, CAST((o_orderkey - o_orderkey % 2)/2 AS BIGINT) AS p FROM orders WHERE o_orderkey >= 1)"


def river(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A river-like deep tree with places: line k runs from node k to node p, the outlet is node 0. Lines have length and dam."""
    from ..functions.geo import haversine

    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    p = k - 1 - ((k * 7919) % 104729) % F.least(k, F.lit(5).cast("long"))
    place = customer.select(k.alias("node"), (F.lit(-80.0) + ((k * 7919) % 20011).cast("double") / 2001.0).alias("lon"), (F.lit(35.0) + ((k * 10473) % 20021).cast("double") / 2002.0).alias("lat"))
    d = customer.where("c_custkey >= 1").select(k.alias("line"), k.alias("start"), p.alias("end"), (k % 97 == 0).cast("int").alias("dam"))
    a, b = place.select(F.col("node").alias("start"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), place.select(F.col("node").alias("end"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    d = d.join(a, "start").join(b, "end")
    d = d.withColumn("length", haversine(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]))
    return d.withColumn("down", F.when(F.col("end") > 0, F.col("end")))


HAVERSINE = "CAST(12756274 AS DOUBLE) * asin(sqrt(pow(sin((radians({3}) - radians({1}))/2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin((radians({2}) - radians({0}))/2), 2)))"
RIVER = (
    """
f4 AS (SELECT c_custkey AS k, c_custkey - 1 - (((c_custkey*7919) % 104729) % least(c_custkey,5)) AS p, CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END AS dam FROM customer WHERE c_custkey >= 1),
n4 AS (SELECT c_custkey AS k,
  CAST(-80 AS DOUBLE)+CAST((c_custkey*7919)%20011 AS DOUBLE)/CAST(2001 AS DOUBLE) AS lon,
  CAST(35 AS DOUBLE)+CAST((c_custkey*10473)%20021 AS DOUBLE)/CAST(2002 AS DOUBLE) AS lat FROM customer),
l4 AS (SELECT f.k AS line, f.k AS "start", f.p AS "end", f.dam, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2,
  """
    + HAVERSINE.format("a.lon", "a.lat", "b.lon", "b.lat")
    + """ AS length FROM f4 f JOIN n4 a ON a.k = f.k JOIN n4 b ON b.k = f.p)"""
)


def braids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("start"), F.col("l_partkey").alias("end"), "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
