"""Shapefiles (.shp with its .shx, .dbf and .prj) as tables, and tables as shapefiles.

The index (.shx) tells where each record begins, so that a file is read in ranges of records, each by a task that seeks to
its own part of the three files. A table is written as one shapefile a partition. Files are reached through Arrow's file
systems, so that any shared store will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import projection
from . import store as stores

# Codes of the kinds of shapes.
POINT, LINE, POLYGON = 1, 3, 5
_KIND = {1: POINT, 3: LINE, 5: POLYGON, 11: POINT, 13: LINE, 15: POLYGON, 21: POINT, 23: LINE, 25: POLYGON}
_POINTS = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
_ARROW = pa.schema([("file", pa.string()), ("shape", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("points", _POINTS), ("properties", pa.map_(pa.string(), pa.string()))])
_SCHEMA = "file string, shape int, kind int, part int, points array<struct<lon:double,lat:double>>, properties map<string,string>"


def _parts(content: bytes, body: int) -> Iterator[tuple[int, int, list]]:
    """(kind, part, points) of the parts of the record whose content begins at ``body``."""
    kind = _KIND.get(struct.unpack_from("<i", content, body)[0])
    if kind == POINT:
        yield kind, 0, [struct.unpack_from("<2d", content, body + 4)]
    elif kind:
        parts, points = struct.unpack_from("<2i", content, body + 36)
        starts = [*struct.unpack_from(f"<{parts}i", content, body + 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", content, body + 44 + 4 * parts)
        pairs = list(zip(flat[::2], flat[1::2], strict=True))
        for i in range(parts):
            yield kind, i, pairs[starts[i] : starts[i + 1]]


def _rows(path: str, first: int, last: int) -> Iterator[dict[str, str | None]]:
    """The attributes of the records ``first`` to ``last`` of a .dbf."""
    count, start, width = struct.unpack("<IHH", stores.read_range(path, 4, 8))
    head = stores.read_range(path, 0, start)
    fields, at = [], 32
    while head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), head[at + 16]))
        at += 32
    content = stores.read_range(path, start + first * width, (min(last, count) - first) * width)
    for i in range(len(content) // width):
        at, found = i * width + 1, {}
        for name, size in fields:
            found[name] = content[at : at + size].decode("utf-8", "replace").strip() or None
            at += size
        yield found


#: Ranges of records are joined beyond this number of tasks; shapes of a file that one task writes.
_MOST_TASKS, _MOST_SHAPES = 64, 100_000


@dataclass
class _Records(InputPartition):
    path: str
    first: int
    last: int


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load(path)``: a .shp file or a folder of them, each with its .shx.

    Options: records, the records of a task (default 50,000; a multiple of it where there were more than 64 tasks else); attributes, "false" to leave the .dbf alone.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records", 50_000)), self.options.get("attributes", "true") == "true")


class _Reader(DataSourceReader):
    def __init__(self, path: str, records: int, attributes: bool) -> None:
        self.path, self.records, self.attributes = path, records, attributes

    def partitions(self) -> list[_Records]:
        base = self.path[: -len(".shp")] + ".shx" if self.path.endswith(".shp") else self.path
        sizes = {path[:-4]: (size - 100) // 8 for path, size in stores.listed(base, ".shx")}
        # a task takes several ranges where there are very many, and still holds few records at once
        ranges = sum(-(-n // self.records) for n in sizes.values())
        step = self.records * max(1, -(-ranges // _MOST_TASKS))
        return [_Records(path, a, min(a + step, n)) for path, n in sizes.items() for a in range(0, n, step)] or [_Records("", 0, 0)]

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        path = partition.path
        for first in range(partition.first, partition.last, 5_000):
            last = min(first + 5_000, partition.last)
            index = struct.unpack(f">{2 * (last - first)}i", stores.read_range(path + ".shx", 100 + 8 * first, 8 * (last - first)))
            # records of a range need not follow each other, but nearly always do
            low, high = min(index[::2]) * 2, max(a + b + 4 for a, b in zip(index[::2], index[1::2], strict=True)) * 2
            content = stores.read_range(path + ".shp", low, high - low)
            found = list(_rows(path + ".dbf", first, last)) if self.attributes else [None] * (last - first)
            rows = []
            for i, at in enumerate(index[::2]):
                for kind, part, points in _parts(content, at * 2 - low + 8):
                    if points:
                        rows.append({"file": path, "shape": first + i, "kind": kind, "part": part, "points": [{"lon": x, "lat": y} for x, y in points], "properties": list(found[i].items()) if i < len(found) and found[i] is not None else None})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_shapes(spark: SparkSession, path: str, attributes: bool = True, records: int = 50_000) -> DataFrame:
    """(file, shape, kind, part, points, properties) of all parts of all shapes in the shapefiles under ``path``, ``records`` records a task.

    shape and part count from 0; kind is POINT, LINE or POLYGON, rings closed as they are in the file. Shapes without
    points are left out. properties is a map of text, null for blank values; without ``attributes`` there is none, and
    the .dbf files are not read.
    """
    spark.dataSource.register(ShapefileSource)
    d = spark.read.format("shapefile").option("records", records).option("attributes", str(attributes).lower()).load(path)
    return d if attributes else d.drop("properties")


def read_crs(path: str) -> projection.Crs | None:
    """The projection that the .prj files under ``path`` name; null without one. Files of different projections are an error."""
    base = path[: -len(".shp")] + ".prj" if path.endswith(".shp") else path
    try:
        texts = {stores.read_all(p).decode("utf-8", "replace").strip() for p, _ in stores.listed(base, ".prj")}
    except FileNotFoundError:
        return None
    if len(texts) > 1:
        raise ValueError(f"{len(texts)} different projections under {path}")
    return projection.from_wkt(texts.pop()) if texts else None


def in_degrees(shapes: DataFrame, crs: projection.Crs | None) -> DataFrame:
    """``shapes`` with their points in degrees; without a projection they are taken for degrees."""
    if crs is None:
        return shapes

    def place(p):
        lon, lat = projection.unproject(p["lon"], p["lat"], crs)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return shapes.withColumn("points", F.transform("points", place))


def read_lines(spark: SparkSession, path: str, attributes: bool = True, records: int = 50_000) -> DataFrame:
    """The lines of ``read_shapes`` in degrees (by the .prj), without consecutive equal points; lines of one point are left out."""
    p = F.col("points")
    clean = F.filter(p, lambda v, i: (i == 0) | (v != F.get(p, i - 1)))
    lines = read_shapes(spark, path, attributes, records).where(F.col("kind") == LINE)
    return in_degrees(lines, read_crs(path)).withColumn("points", clean).where("size(points) > 1")


def _head(kind: int, size: int, box: tuple) -> bytes:
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, kind, *box, 0, 0, 0, 0)


def _body(kind: int, parts: list[list[tuple[float, float]]]) -> bytes:
    if kind == POINT:
        return struct.pack("<i2d", POINT, *parts[0][0])
    flat = [c for part in parts for p in part for c in p]
    starts, n = [], 0
    for part in parts:
        starts.append(n)
        n += len(part)
    box = min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2])
    return struct.pack("<i4d2i", kind, *box, len(parts), n) + struct.pack(f"<{len(parts)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)


def _files(kind: int, rows: list[tuple], names: list[str]) -> dict[str, bytes]:
    """The three files of a shapefile of (parts, values) rows; values are text of 254 bytes at most."""
    shp, shx, at = [], [], 100
    for i, (parts, *_) in enumerate(rows):
        body = _body(kind, parts)
        shp.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        shx.append(struct.pack(">2i", at // 2, len(body) // 2))
        at += 8 + len(body)
    x = [p[0] for parts, *_ in rows for part in parts for p in part] or [0.0]
    y = [p[1] for parts, *_ in rows for part in parts for p in part] or [0.0]
    box = min(x), min(y), max(x), max(y)
    values = [[("" if v is None else str(v)).encode("utf-8")[:254] for v in r[1:]] for r in rows]
    widths = [max([1, *(len(r[i]) for r in values)]) for i in range(len(names))]
    fields = b"".join(n.encode("latin-1")[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for n, w in zip(names, widths, strict=True))
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths)) + fields + b"\r"
    dbf += b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in values) + b"\x1a"
    return {"shp": _head(kind, at, box) + b"".join(shp), "shx": _head(kind, 100 + 8 * len(rows), box) + b"".join(shx), "dbf": dbf}


def _writer(path: str, kind: int, names: list[str], prj: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        context = TaskContext.get()

        def write(rows: list[tuple], number: int) -> None:
            name, attempt = f"{base}/part-{context.partitionId():05d}" + (f"-{number}" if number else ""), context.taskAttemptId()
            more = {"prj": prj.encode()} if prj else {}
            for ending, content in (more | _files(kind, rows, names)).items():
                with store.open_output_stream(f"{name}.{attempt}") as out:
                    out.write(content)
                store.move(f"{name}.{attempt}", f"{name}.{ending}")

        rows, files, done = [], 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                rows.append(([[(p["lon"], p["lat"]) for p in part] for part in r["parts"]], *[r[n] for n in names]))
                if len(rows) == _MOST_SHAPES:
                    write(rows, files)
                    rows, files, done = [], files + 1, done + len(rows)
        if rows:
            write(rows, files)
        yield pa.RecordBatch.from_pydict({"shapes": pa.array([done + len(rows)], pa.int64())})

    return run


def write_shapes(shapes: DataFrame, path: str, kind: int, properties: list[str], prj: str | None = None) -> int:
    """Write ``shapes`` (parts: array of arrays of (lon, lat), properties) as shapefiles, one or more a partition; returns their number.

    ``path`` is a folder in a store that all executors share. Names are cut to ten characters, as the format has it. Values are written as text, nulls as blanks; ``prj`` is
    the text of the .prj files, if there are to be any. A file's
    shapes are held by its task, as its head tells their number: a partition of more than 100,000 shapes is several files.
    """
    uri = path if "://" in path else "file://" + path
    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    done = shapes.select("parts", *properties).mapInArrow(_writer(uri, kind, properties, prj), "shapes long")
    return done.agg(F.sum("shapes")).first()[0] or 0
