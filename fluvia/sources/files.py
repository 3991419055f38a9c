"""Files of lines, cells and tables. Everything is read and written by Spark's own readers and writers.

GeoJSON comes in two layouts: a FeatureCollection, one document that may be one line of any length, and one Feature a line.
Files of both are read in ranges of bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

# Fixed value: the coordinates that GeoJSON has unless a file says otherwise.
WGS84 = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def _strings(raw: np.ndarray, before: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """For each byte whether it lies in a string (its quotes included), and whether the end does, from the state ``inside`` at the start; ``before`` holds the bytes before."""
    quote = raw == 0x22
    for at in np.flatnonzero(quote & np.concatenate([[before[-1:] == b"\\"], raw[:-1] == 0x5C])):
        run, i = 0, at - 1
        while (raw[i] if i >= 0 else before[i] if -i <= len(before) else 0) == 0x5C:
            run, i = run + 1, i - 1
        quote[at] = run % 2 == 0
    odd = (np.cumsum(quote) + inside) % 2 == 1
    return odd | quote, bool(odd[-1]) if len(odd) else inside


def _steps(raw: np.ndarray, text: np.ndarray) -> np.ndarray:
    """+1 at brackets that open and -1 at those that close, outside of strings."""
    opens, closes = (raw == 0x7B) | (raw == 0x5B), (raw == 0x7D) | (raw == 0x5D)
    return np.where(text, 0, opens.astype(np.int8) - closes.astype(np.int8))


def _bytes(path: str, start: int, stop: int) -> tuple[np.ndarray, bytes]:
    back = min(start, 4096)
    raw = store.read_range(path, start - back, stop - start + back)
    return np.frombuffer(raw[back:], np.uint8), raw[:back]


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each range the number of quotes, odd or even, and the change of depth if it begins outside or inside of a string."""
    for pdf in batches:
        rows = []
        for path, range_, start, stop in pdf[["path", "range", "start", "stop"]].itertuples(index=False, name=None):
            raw, before = _bytes(path, start, stop)
            both = [_strings(raw, before, inside) for inside in (False, True)]
            rows.append((path, range_, start, stop, both[0][1], *[int(_steps(raw, text).sum()) for text, _ in both]))
        yield pd.DataFrame(rows, columns=["path", "range", "start", "stop", "turns", "outside", "inside"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of the objects of depth 3 that begin in each range; the last is read on beyond the range to its end."""
    for pdf in batches:
        for path, range_, start, stop, inside, depth, size in pdf[["path", "range", "start", "stop", "in_string", "depth", "size"]].itertuples(index=False, name=None):
            raw, before = _bytes(path, start, stop)
            text, state = _strings(raw, before, inside)
            level = depth + np.cumsum(_steps(raw, text))
            begins = np.flatnonzero((raw == 0x7B) & ~text & (level == 3))
            ends = np.flatnonzero((raw == 0x7D) & ~text & (level == 2))
            ends = ends[ends > begins[0]] if len(begins) else ends[:0]
            found = [raw[a : b + 1].tobytes() for a, b in zip(begins, ends, strict=False)]
            if len(begins) > len(ends):
                tail, at = raw[begins[-1] :].tobytes(), stop
                open_ = int(level[-1]) - 2
                while open_ > 0 and at < size:
                    more, last = _bytes(path, at, min(at + 65_536, size))
                    within, state = _strings(more, last, state)
                    deep = open_ + np.cumsum(_steps(more, within))
                    over = np.flatnonzero(deep == 0)
                    tail += more[: over[0] + 1].tobytes() if len(over) else more.tobytes()
                    open_ = 0 if len(over) else int(deep[-1])
                    at += len(more)
                found.append(tail)
            for i in range(0, len(found), 1000):
                yield pd.DataFrame([(path, range_, i + k, t.decode("utf-8", "replace")) for k, t in enumerate(found[i : i + 1000])], columns=["path", "range", "nth", "value"])


def collection_texts(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """(path, feature, value): the texts of the features of FeatureCollections, numbered from 0 in each file, in ranges of ``size`` bytes.

    A first pass tells for each range how it changes the depth of brackets, whether it begins in a string or not; running
    sums over the ranges (one row each) then tell where it begins, and a second pass cuts the features out. A range may
    begin anywhere: inside of a string, an escape or a number.
    """
    rows = [(p, i, a, min(a + size, n), n) for p, n in store.listed(path, "") for i, a in enumerate(range(0, n, size))]
    ranges = spark.createDataFrame(rows, "path string, range long, start long, stop long, size long").repartition(max(1, min(len(rows), 10_000)), "path", "range")
    seen = ranges.mapInPandas(_scanned, "path string, range long, start long, stop long, turns boolean, outside long, inside long")
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    state = seen.withColumn("in_string", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    state = state.withColumn("step", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    state = state.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))).join(ranges.select("path", "range", "size"), ["path", "range"])
    texts = state.repartition(max(1, min(len(rows), 10_000)), "path", "range").mapInPandas(_cut, "path string, range long, nth long, value string")
    # objects of that depth that are no features (of a crs, say) don't count
    texts = texts.where(F.get_json_object("value", "$.type") == "Feature")
    order = Window.partitionBy("path", "range").orderBy("nth")
    texts = texts.withColumn("nth", F.row_number().over(order) - 1)
    starts = texts.groupBy("path", "range").agg(F.count("*").alias("n")).select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return texts.join(starts, ["path", "range"]).select("path", (F.col("start") + F.col("nth")).alias("feature"), "value")


def read_crs(path: str) -> str:
    """The coordinate system of a FeatureCollection: the name in its ``crs`` member, or the WGS84 of the standard without one or for its own names."""
    first, n = store.listed(path, "")[0]
    for start, size in ((0, 65_536), (max(0, n - 65_536), 65_536)):
        found = re.search(r'"crs"\s*:\s*(\{[^{}]*\{[^{}]*\}\s*\})', store.read_range(first, start, size).decode("utf-8", "replace"))
        if found:
            name = str(json.loads(found[1]).get("properties", {}).get("name", ""))
            return WGS84 if name.upper().endswith((":CRS84", ":4326", "::4326")) or not name else name
    return WGS84


def read_features(spark: SparkSession, path: str, collection: bool = True, size: int = 64 << 20) -> DataFrame:
    """(feature, properties, type, coordinates): coordinates are JSON text; feature is the place in the collection, null for one a line.

    Features without a geometry are left out.
    """
    if collection:
        shape = "properties map<string, string>, geometry struct<type: string, coordinates: string>"
        d = collection_texts(spark, path, size).select(F.col("feature").cast("int").alias("feature"), F.from_json("value", shape).alias("f"))
    else:
        d = spark.read.schema("properties map<string, string>, geometry struct<type: string, coordinates: string>").json(path)
        d = d.select(F.lit(None).cast("int").alias("feature"), F.struct("properties", "geometry").alias("f"))
    return d.select("feature", "f.properties", "f.geometry.type", "f.geometry.coordinates").where("type IS NOT NULL")


def _to_collection(path: str, crs: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store.opened(path)
        named = f', "crs": {{"type": "name", "properties": {{"name": {json.dumps(crs)}}}}}' if crs else ""
        n = 0
        with files.open_output_stream(base + "._part") as out:
            out.write(f'{{"type": "FeatureCollection"{named}, "features": ['.encode())
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write((", " if n else "").encode() + text.encode())
                    n += 1
            out.write(b"]}")
        files.move(base + "._part", base)
        yield pa.RecordBatch.from_pydict({"features": pa.array([n], pa.int64())})

    return run


def write_collection(features: DataFrame, path: str, order: list[str], crs: str | None = None) -> int:
    """Write ``features`` (value: Feature as text) in an ``order`` as one FeatureCollection at ``path``; returns their number.

    The format is one document: rows are sorted by ranges, and one task streams the ranges to the file one after the other.
    """
    files, base = store.opened(path)
    files.create_dir(base.rsplit("/", 1)[0], recursive=True)
    write = _to_collection(path, crs)
    done = features.orderBy(*order).select("value").coalesce(1).mapInArrow(write, "features long").first()
    return done[0] if done else next(write(iter([]))).column(0)[0].as_py()  # Spark runs no task for an empty table


def _points(pairs: Column) -> Column:
    """Coordinate pairs as (lon, lat) structs without consecutive equal points."""
    p = F.transform(pairs, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
    return F.filter(p, lambda v, i: (i == 0) | (v != F.get(p, i - 1)))


def read_lines(spark: SparkSession, path: str, collection: bool = True, size: int = 64 << 20) -> DataFrame:
    """(feature, part, properties, points) of the LineStrings and of the parts of MultiLineStrings."""
    d = read_features(spark, path, collection, size).where("type IN ('LineString', 'MultiLineString')")
    one = F.from_json("coordinates", "array<array<double>>")
    parts = F.when(F.col("type") == "LineString", F.array(one)).otherwise(F.from_json("coordinates", "array<array<array<double>>>"))
    d = d.select("feature", "properties", F.posexplode(parts).alias("part", "pairs"))
    return d.select("feature", "part", "properties", _points(F.col("pairs")).alias("points"))


def read_rings(spark: SparkSession, path: str, collection: bool = True, size: int = 64 << 20) -> DataFrame:
    """(feature, part, properties, ring) of the outer rings of Polygons and MultiPolygons, without the closing point."""
    d = read_features(spark, path, collection, size).where("type IN ('Polygon', 'MultiPolygon')")
    one = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("type") == "Polygon", F.array(one)).otherwise(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    d = d.select("feature", "properties", F.posexplode(parts).alias("part", "rings")).withColumn("ring", _points(F.col("rings")[0]))
    closed = (F.size("ring") > 1) & (F.col("ring")[0] == F.element_at("ring", -1))
    return d.select("feature", "part", "properties", F.when(closed, F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring")).alias("ring"))


def _pairs(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def feature_json(kind: str, coordinates: Column, properties: list[str]) -> Column:
    """One GeoJSON Feature as text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_lines(lines: DataFrame, path: str, properties: list[str]) -> None:
    """``lines`` (points, properties) as LineStrings, one Feature a line."""
    lines.select(feature_json("LineString", _pairs(F.col("points")), properties).alias("value")).write.text(path)


def write_vertices(vertices: DataFrame, path: str, properties: list[str]) -> None:
    vertices.select(feature_json("Point", F.array("lon", "lat"), properties).alias("value")).write.text(path)


def write_rings(cells: DataFrame, path: str, properties: list[str]) -> None:
    """``cells`` (ring, properties) as Polygons with closed rings."""
    closed = F.concat("ring", F.slice("ring", 1, 1))
    cells.select(feature_json("Polygon", F.array(_pairs(closed)), properties).alias("value")).write.text(path)


def kml_placemark(name: Column, points: Column, kind: str = "Polygon") -> Column:
    """A KML Placemark of a Polygon, LineString or Point (the first place) as text; names with markup are escaped."""
    safe = F.replace(F.replace(F.replace(name.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = F.concat(points, F.slice(points, 1, 1)) if kind == "Polygon" else F.slice(points, 1, 1) if kind == "Point" else points
    at = F.array_join(F.transform(shown, lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"))), " ")
    before, after = ("<outerBoundaryIs><LinearRing>", "</LinearRing></outerBoundaryIs>") if kind == "Polygon" else ("", "")
    return F.concat(F.lit("<Placemark><name>"), safe, F.lit(f"</name><{kind}>{before}<coordinates>"), at, F.lit(f"</coordinates>{after}</{kind}></Placemark>"))


def wkt(kind: str, points: Column) -> Column:
    """POINT or LINESTRING as text."""
    at = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    return F.concat(F.lit(kind + " ("), at, F.lit(")"))


def from_wkt(text: Column) -> Column:
    """The points of a POINT or LINESTRING as (lon, lat) structs; null for other text."""
    inner = F.regexp_extract(text, r"^\s*(?:POINT|LINESTRING)\s*\(([^()]*)\)\s*$", 1)
    pairs = F.transform(F.split(inner, r"\s*,\s*"), lambda t: F.split(F.trim(t), r"\s+"))
    return F.when(F.length(inner) > 0, F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("lon"), p[1].cast("double").alias("lat"))))


def skipping(columns: list[str], skip: list[str]) -> Column:
    """A struct of the columns but for those to skip, in their order: what an object's JSON shows."""
    return F.struct(*[c for c in columns if c not in skip])


def read_mesh(spark: SparkSession, path: str, collection: bool = True) -> DataFrame:
    """(cell_id, lon, lat, area, elevation, profile, ring) of a mesh file; Polygons only, fields that are missing are null."""
    d = read_features(spark, path, collection).where("type = 'Polygon'")
    ring = _points(F.from_json("coordinates", "array<array<array<double>>>")[0])
    p = F.col("properties")
    d = d.select(p["cellid"].cast("long").alias("cell_id"), p["longitude"].cast("double").alias("lon"), p["latitude"].cast("double").alias("lat"), p["area"].cast("double").alias("area"), p["elevation_mean"].cast("double").alias("elevation"), p["elevation_profile0"].cast("double").alias("profile"), ring.alias("ring"))
    closed = (F.size("ring") > 1) & (F.col("ring")[0] == F.element_at("ring", -1))
    return d.withColumn("ring", F.when(closed, F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring")))


def mesher_tables(parts: DataFrame, closed: bool) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (part, points): nodes (part, node, lon, lat) numbered from 0 by part and place, edges (part, a, b) between them.

    Numbers are running sums over the parts' sizes (one number a part) and the place within the part.
    """
    sized = parts.select("part", F.size("points").cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = sized.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    d = parts.join(starts, "part").select("part", "n", "start", F.posexplode("points").alias("pos", "p"))
    nodes = d.select("part", (F.col("start") + F.col("pos")).alias("node"), "p.lon", "p.lat")
    onward = d if closed else d.where("pos < n - 1")
    return nodes, onward.select("part", (F.col("start") + F.col("pos")).alias("a"), (F.col("start") + (F.col("pos") + 1) % F.col("n")).alias("b"))


def read_dams(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, name, id) from a CSV file with a header: columns 1, 2, 5 and 6."""
    d = spark.read.option("header", True).csv(path)
    c = [F.col(f"`{x}`") for x in d.columns]
    return d.select(c[0].cast("double").alias("lat"), c[1].cast("double").alias("lon"), c[4].alias("name"), c[5].cast("long").alias("id"))


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """(from, to) from a CSV file with a header: columns 2 and 3."""
    d = spark.read.option("header", True).csv(path)
    return d.select(F.col(f"`{d.columns[1]}`").cast("long").alias("from"), F.col(f"`{d.columns[2]}`").cast("long").alias("to"))
