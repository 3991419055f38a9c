"""NetCDF files of the classic formats (CDF-1, CDF-2 with 64-bit offsets, CDF-5) as a splittable data source.

A row is one index of the first dimension; variables of more dimensions give arrays. Each task seeks to its own range of
rows of every variable and reads nothing else.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from . import store

# The format's codes of types, and of the lists in a header.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
_ARROW = {"i1": pa.int32(), "S1": pa.string(), ">i2": pa.int32(), ">i4": pa.int32(), ">f4": pa.float32(), ">f8": pa.float64(), "u1": pa.int32(), ">u2": pa.int32(), ">u4": pa.int64(), ">i8": pa.int64(), ">u8": pa.decimal128(20)}


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: str
    begin: int
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    """What a file holds: records is the length of the unlimited dimension, stride the bytes of one record of all variables."""

    dims: list[tuple[str, int]]
    variables: dict[str, Variable]
    attributes: dict
    records: int
    stride: int

    def shape(self, name: str) -> tuple[int, ...]:
        v = self.variables[name]
        return tuple(self.records if i == 0 and self.dims[d][1] == 0 else self.dims[d][1] for i, d in enumerate(v.dims))

    def by_record(self, name: str) -> bool:
        v = self.variables[name]
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0


class _Bytes:
    """A cursor over the head of a file, which is read on as far as it is needed."""

    def __init__(self, path: str, wide: bool) -> None:
        self.path, self.at, self.held, self.wide = path, 4, b"", wide

    def take(self, n: int) -> bytes:
        while len(self.held) < self.at + n:
            more = store.read_range(self.path, len(self.held), max(65_536, n))
            if not more:
                raise ValueError(f"{self.path} ends in its header")
            self.held += more
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else struct.unpack(">i", self.take(4))[0]

    def text(self) -> str:
        n = self.number()
        return self.take(n + -n % 4)[:n].decode()

    def count(self, code: int) -> int:
        found, n = struct.unpack(">i", self.take(4))[0], self.number()
        if found not in (0, code):
            raise ValueError(f"{self.path}: a list of kind {found} where {code} was due")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.count(ATTRIBUTE)):
            name, kind, n = self.text(), TYPES[struct.unpack(">i", self.take(4))[0]], self.number()
            size = n * np.dtype(kind).itemsize
            raw = self.take(size + -size % 4)[:size]
            out[name] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return out


def read_header(path: str) -> Header:
    """Dimensions, variables and attributes of a classic NetCDF file; other formats (HDF5) are an error."""
    magic = store.read_range(path, 0, 4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError(f"{path} is no classic NetCDF file")
    head = _Bytes(path, magic[3] == 5)
    raw = head.take(8 if head.wide else 4)
    records = int.from_bytes(raw, "big")
    dims = [(head.text(), head.number()) for _ in range(head.count(DIMENSION))]
    attributes, variables = head.attributes(), {}
    for _ in range(head.count(VARIABLE)):
        name = head.text()
        ids = [head.number() for _ in range(head.number())]
        own = head.attributes()
        kind = TYPES[struct.unpack(">i", head.take(4))[0]]
        head.number()  # the size is told by the dimensions: the field is too small for large variables
        begin = struct.unpack(">i", head.take(4))[0] if magic[3] == 1 else struct.unpack(">q", head.take(8))[0]
        variables[name] = Variable(name, ids, kind, begin, own)
    out = Header(dims, variables, attributes, 0 if raw == b"\xff" * len(raw) else records, 0)
    sizes = [math.prod(out.dims[d][1] for d in v.dims[1:]) * np.dtype(v.kind).itemsize for n, v in variables.items() if out.by_record(n)]
    out.stride = sizes[0] if len(sizes) == 1 else sum(s + -s % 4 for s in sizes)
    return out


def hyperslab(path: str, header: Header, name: str, start: int, stop: int) -> np.ndarray:
    """Rows ``start`` to ``stop`` of a variable along its first dimension: one read, of all records' bytes where it lies among others'."""
    v, (_, *inner) = header.variables[name], header.shape(name)
    kind = np.dtype(v.kind)
    width = math.prod(inner) * kind.itemsize
    if not header.by_record(name):
        return np.frombuffer(store.read_range(path, v.begin + start * width, (stop - start) * width), kind).reshape(-1, *inner)
    if stop <= start:
        return np.zeros((0, *inner), kind)
    raw = np.frombuffer(store.read_range(path, v.begin + start * header.stride, (stop - start - 1) * header.stride + width), np.uint8)
    rows = np.lib.stride_tricks.as_strided(raw, (stop - start, width), (header.stride, 1))
    return np.frombuffer(rows.tobytes(), kind).reshape(-1, *inner)


def _column(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "S1":
        flat = values.reshape(len(values), -1)
        return pa.array([bytes(r.tolist() and b"".join(r)).rstrip(b"\0 ").decode("utf-8", "replace") for r in flat])
    data = pa.array(np.ascontiguousarray(values.reshape(-1)).astype(np.dtype(kind).newbyteorder("="))).cast(_ARROW[kind])
    for size in reversed(values.shape[1:]):
        data = pa.ListArray.from_arrays(pa.array(np.arange(0, len(data) + 1, size, dtype=np.int32)), data)
    return data


def _arrow_schema(header: Header, names: list[str]) -> pa.Schema:
    fields = [pa.field("file", pa.string()), pa.field("row", pa.int64())]
    for n in names:
        v = header.variables[n]
        kind = _ARROW[v.kind]
        for _ in [] if v.kind == "S1" else v.dims[1:]:
            kind = pa.list_(kind)
        fields.append(pa.field(n, kind))
    return pa.schema(fields)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


class NetcdfSource(DataSource):
    """``spark.read.format("netcdf").option("variables", "a,b").load(path)``: variables that share their first dimension.

    path is a file or a folder of .nc files of one layout. Option rows: the rows of a task (default 1,000,000). A row has
    file, row (its index) and the variables; text variables become strings without their padding.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _names(self) -> list[str]:
        return [n.strip() for n in self.options["variables"].split(",")]

    def schema(self):
        return from_arrow_schema(_arrow_schema(read_header(store.listed(self.options["path"], ".nc")[0][0]), self._names()))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._names(), int(self.options.get("rows", 1_000_000)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], rows: int) -> None:
        self.path, self.names, self.rows = path, names, rows

    def partitions(self) -> list[_Range]:
        out = []
        for path, _ in store.listed(self.path, ".nc"):
            header = read_header(path)
            sizes = {n: header.shape(n)[0] for n in self.names}
            if len(set(sizes.values())) > 1:
                raise ValueError(f"variables of different lengths: {sizes}")
            n = next(iter(sizes.values()))
            out += [_Range(path, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        header = read_header(partition.path)
        schema = _arrow_schema(header, self.names)
        for start in range(partition.start, partition.stop, 50_000):
            stop = min(start + 50_000, partition.stop)
            columns = [_column(hyperslab(partition.path, header, n, start, stop), header.variables[n].kind) for n in self.names]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (stop - start)), pa.array(np.arange(start, stop)), *columns], schema=schema)


def read_arrays(spark: SparkSession, path: str, variables: list[str], rows: int = 1_000_000) -> DataFrame:
    """(file, row, variables) of the NetCDF files at ``path``, ``rows`` rows a task."""
    spark.dataSource.register(NetcdfSource)
    return spark.read.format("netcdf").option("variables", ",".join(variables)).option("rows", rows).load(path)


def encoded(dims: dict[str, int], arrays: dict[str, tuple[list[str], np.ndarray]], version: int = 2, attributes: dict[str, str] | None = None) -> bytes:
    """A classic NetCDF file of ``arrays`` (names of dimensions, values); a dimension of length 0 is the unlimited one."""
    codes = {np.dtype(v): k for k, v in TYPES.items()}
    word = lambda n: struct.pack(">q" if version == 5 else ">i", n)
    name = lambda s: word(len(s.encode())) + s.encode() + bytes(-len(s.encode()) % 4)
    listed = lambda code, items: struct.pack(">i", code if items else 0) + word(len(items)) + b"".join(items)
    text = [name(k) + struct.pack(">i", 2) + name(v) for k, v in (attributes or {}).items()]
    order = list(dims)
    record = {n: bool(d) and dims[d[0]] == 0 for n, (d, _) in arrays.items()}
    records = max([len(v) for n, (_, v) in arrays.items() if record[n]], default=0)
    size = {n: v.nbytes // max(1, len(v)) if record[n] else v.nbytes for n, (_, v) in arrays.items()}
    padded = {n: s + -s % 4 for n, s in size.items()}
    lone = sum(record.values()) == 1

    def head(begin: dict[str, int]) -> bytes:
        offset = lambda n: struct.pack(">i" if version == 1 else ">q", begin[n])
        variables = [name(n) + word(len(d)) + b"".join(word(order.index(x)) for x in d) + listed(ATTRIBUTE, []) + struct.pack(">i", codes[np.dtype(v.dtype)]) + word(min(padded[n], 2**31 - 4)) + offset(n) for n, (d, v) in arrays.items()]
        return b"CDF" + bytes([version]) + word(records) + listed(DIMENSION, [name(k) + word(n) for k, n in dims.items()]) + listed(ATTRIBUTE, text) + listed(VARIABLE, variables)

    begin, at = {}, len(head(dict.fromkeys(arrays, 0)))
    for n in sorted(arrays, key=lambda n: record[n]):
        begin[n] = at
        at += size[n] if record[n] and lone else padded[n]
    body = b"".join(v.tobytes() + bytes(-v.nbytes % 4) for n, (_, v) in arrays.items() if not record[n])
    rows = b"".join(v[i : i + 1].tobytes() + (b"" if lone else bytes(-size[n] % 4)) for i in range(records) for n, (_, v) in arrays.items() if record[n])
    return head(begin) + body + rows


def _writer(path: str, dim: str, kinds: dict[str, tuple[str, int]], version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        n = table.num_rows if table else 0
        if n:
            dims, arrays = {dim: n}, {}
            for c, (kind, width) in kinds.items():
                flat = table.column(c).combine_chunks()
                values = (flat.flatten() if width else flat).to_numpy(zero_copy_only=False).astype(kind)
                if width:
                    dims[f"{c}_width"] = width
                arrays[c] = ([dim, f"{c}_width"], values.reshape(n, width)) if width else ([dim], values)
            files, base = store.opened(path)
            context = TaskContext.get()
            target, part = f"{base}/part-{context.partitionId():05d}", f"{base}/_part.{context.taskAttemptId()}"
            with files.open_output_stream(part) as out:
                out.write(encoded(dims, arrays, version))
            files.move(part, target + ".nc")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([n], pa.int64())})

    return run


def write_arrays(rows: DataFrame, path: str, dim: str, widths: dict[str, int] | None = None, version: int = 2) -> int:
    """Write all columns of ``rows`` as variables over ``dim``, one file a partition; returns the number of rows.

    Columns in ``widths`` are arrays of that many numbers each. The rows of a partition are held by its task.
    """
    codes = {"int": ">i4", "bigint": ">i4" if version < 5 else ">i8", "float": ">f4", "double": ">f8", "smallint": ">i2"}
    widths = widths or {}
    kinds = {c: (codes[t[6:-1] if t.startswith("array") else t], widths.get(c, 0)) for c, t in rows.dtypes}
    files, base = store.opened(path)
    files.create_dir(base, recursive=True)
    return rows.mapInArrow(_writer(path, dim, kinds, version), "rows long").agg(F.sum("rows")).first()[0] or 0
