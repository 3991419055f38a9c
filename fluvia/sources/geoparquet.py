"""GeoParquet: Parquet with geometries as WKB and a ``geo`` key in the footer that describes them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

# The format's codes of shapes.
KINDS = {"Point": 1, "LineString": 2, "Polygon": 3}


def _word(n: Column | int) -> Column:
    """Four bytes, the lowest first."""
    n = n if isinstance(n, Column) else F.lit(n)
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def _double(x: Column) -> Column:
    """The eight bytes of a double, the lowest first, by arithmetic: sign, exponent and fraction."""
    size = F.abs(x)
    least = F.lit(2.0**-1022)
    power = F.greatest(F.floor(F.log2(F.greatest(size, least))), F.lit(-1022).cast("long"))
    # the logarithm may be off by one beside a power of two
    power = F.when(size < F.pow(F.lit(2.0), power), power - 1).when(size >= F.pow(F.lit(2.0), power + 1), power + 1).otherwise(power)
    normal = size >= least
    fraction = F.when(normal, (size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).otherwise(size / F.lit(2.0**-1074))
    top = F.when(normal, power + 1023).otherwise(F.lit(0).cast("long"))
    negative = (x < 0) | (x.cast("string") == "-0.0")
    bits = F.shiftleft(top, 52).bitwiseOR(fraction.cast("long")).bitwiseOR(F.when(negative, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long")))
    digits = F.lpad(F.hex(bits), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def _joined(parts: Column) -> Column:
    """An array of binaries as one, through their hexadecimal digits."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _places(points: Column) -> Column:
    return _joined(F.transform(points, lambda p: F.concat(_double(p["lon"]), _double(p["lat"]))))


def wkb(kind: str, points: Column) -> Column:
    """Well-known binary of a Point (the first place), a LineString, or a Polygon of one open ring of (lon, lat) structs."""
    head = F.concat(F.unhex(F.lit("01")), _word(KINDS[kind]))
    if kind == "Point":
        return F.concat(head, _places(F.slice(points, 1, 1)))
    if kind == "LineString":
        return F.concat(head, _word(F.size(points)), _places(points))
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.concat(head, _word(1), _word(F.size(closed)), _places(closed))


def _writer(path: str, column: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store.opened(path)
        context, out, n = TaskContext.get(), None, 0
        part = f"{base}/_part.{context.taskAttemptId()}"
        for batch in batches:
            if out is None:
                described = {"version": "1.0.0", "primary_column": column, "columns": {column: {"encoding": "WKB", "geometry_types": [kind]}}}
                out = pq.ParquetWriter(files.open_output_stream(part), batch.schema.with_metadata({"geo": json.dumps(described)}))
            out.write_batch(batch)
            n += batch.num_rows
        if out is not None:
            out.close()
            files.move(part, f"{base}/part-{context.partitionId():05d}.parquet")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([n], pa.int64())})

    return run


def write(rows: DataFrame, path: str, kind: str, points: str, geometry: str = "geometry") -> int:
    """Write ``rows`` with their (lon, lat) array ``points`` as WKB in ``geometry``, one file a partition; returns their number."""
    files, base = store.opened(path)
    files.create_dir(base, recursive=True)
    encoded = rows.withColumn(geometry, wkb(kind, F.col(points))).drop(points)
    return encoded.mapInArrow(_writer(path, geometry, kind), "rows long").agg(F.sum("rows")).first()[0] or 0


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, column, encoding, kind): what each file's footer says of its geometry; files without it have nulls."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file in pdf["file"]:
                files, base = store.opened(file)
                with files.open_input_file(base) as f:
                    geo = json.loads((pq.ParquetFile(f).schema_arrow.metadata or {}).get(b"geo", b"{}"))
                column = geo.get("primary_column")
                about = geo.get("columns", {}).get(column, {})
                rows.append((file, geo.get("version"), column, about.get("encoding"), ",".join(about.get("geometry_types", [])) or None))
            yield pdf.__class__(rows, columns=["file", "version", "column", "encoding", "kind"])

    listed = spark.createDataFrame([(p,) for p, _ in store.listed(path, ".parquet")], "file string")
    return listed.mapInPandas(run, "file string, version string, column string, encoding string, kind string")
