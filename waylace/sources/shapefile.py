"""ESRI shapefiles as a Spark data source, for reading and writing.

``spark.read.format("waylace_shp").load(path)`` gives ``shape_id, kind, parts``
and the attributes of the .dbf table; ``parts`` is an array of lines or rings.
Writing takes ``geom`` (a line) or ``parts`` and puts one file set for each
task under the path.  Files are read by the tasks, so the path must be one that
they all can open.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ENCODING = "cp949"
KINDS = {0: "Null", 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint", 11: "Point", 13: "LineString", 15: "Polygon"}
_POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: Records that one input partition holds.
RECORDS = 20_000


class UnfitFile(ValueError):
    """The file cannot be used: wrong suffix, missing, empty, or not in metres."""


def is_metre(wkt: str) -> bool:
    """Whether a coordinate system's text names the metre as a unit."""
    low = wkt.lower()
    return any(mark in low for mark in ('unit["metre"', 'unit["meter"', "unit[metre", "unit[meter"))


def epsg_of(wkt: str) -> int | None:
    """The last EPSG number that the text names, or None."""
    found = re.findall(r'(?:AUTHORITY|ID)\["EPSG"\s*,\s*"?(\d+)"?\]', wkt, re.IGNORECASE)
    return int(found[-1]) if found else None


def check_source(path: str) -> str:
    """The path, if it can be loaded: suffix, existence, coordinate system in metres."""
    if not path.lower().endswith(".shp"):
        raise UnfitFile(f"not a .shp file: {path}")
    if not os.path.isfile(path):
        raise UnfitFile(f"no such file: {path}")
    prj = path[:-4] + ".prj"
    if not os.path.isfile(prj):
        raise UnfitFile(f"no coordinate system beside {path}")
    with open(prj, encoding="utf-8", errors="replace") as f:
        if not is_metre(f.read()):
            raise UnfitFile(f"not in metres: {path}")
    if os.path.getsize(path) <= 100:
        raise UnfitFile(f"no shapes in {path}")
    return path


def _fields(dbf: str) -> list[tuple[str, str, int, int]]:
    """``(name, type, length, decimals)`` of a .dbf table."""
    if not os.path.isfile(dbf):
        return []
    with open(dbf, "rb") as f:
        head = f.read(32)
        size = struct.unpack_from("<H", head, 8)[0]
        rows = f.read(size - 32)
    out = []
    for at in range(0, len(rows) - 31, 32):
        if rows[at] == 0x0D:
            break
        name = rows[at : at + 11].split(b"\0")[0].decode(ENCODING, "replace")
        out.append((name, chr(rows[at + 11]), rows[at + 16], rows[at + 17]))
    return out


def _type(kind: str, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.DoubleType() if decimals or kind == "F" else T.LongType()
    return T.BooleanType() if kind == "L" else T.StringType()


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    if kind in "NF":
        return float(text) if decimals or kind == "F" else int(float(text))
    return text.upper() in ("T", "Y") if kind == "L" else text


def parse_shape(content: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """Kind and parts of one record's content."""
    code = struct.unpack_from("<i", content)[0]
    kind = KINDS.get(code, "Unknown")
    if kind == "Point":
        return kind, [[struct.unpack_from("<2d", content, 4)]]
    if kind not in ("LineString", "Polygon"):
        return kind, []
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    begins = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_parts)
    parts = [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(begins, begins[1:], strict=False)]
    return f"Multi{kind}" if kind == "LineString" and n_parts > 1 else kind, parts


@dataclass
class _Slice(InputPartition):
    path: str
    offset: int
    first: int
    count: int

    def __init__(self, path: str, offset: int, first: int, count: int):
        self.path, self.offset, self.first, self.count = path, offset, first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, encoding: str):
        self.path, self.schema, self.encoding = path, schema, encoding

    def partitions(self) -> list[InputPartition]:
        """Runs of records, found by walking the record heads."""
        runs: list[_Slice] = []
        at, end, n = 100, os.path.getsize(self.path), 0
        with open(self.path, "rb") as f:
            while at < end:
                if n % RECORDS == 0:
                    runs.append(_Slice(self.path, at, n, 0))
                f.seek(at)
                at += 8 + 2 * struct.unpack(">2i", f.read(8))[1]
                runs[-1].count += 1
                n += 1
        return runs

    def read(self, partition: _Slice) -> Iterator[tuple]:
        wanted = [f.name for f in self.schema.fields]
        dbf = self.path[:-4] + ".dbf"
        fields = _fields(dbf)
        table = open(dbf, "rb") if fields and any(n in wanted for n, *_ in fields) else None  # noqa: SIM115
        try:
            if table:
                head = table.read(32)
                at, width = struct.unpack_from("<2H", head, 8)
            with open(self.path, "rb") as f:
                f.seek(partition.offset)
                for k in range(partition.count):
                    _, size = struct.unpack(">2i", f.read(8))
                    kind, parts = parse_shape(f.read(2 * size))
                    row = {"shape_id": partition.first + k, "kind": kind, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts]}
                    if table:
                        table.seek(at + (partition.first + k) * width + 1)
                        raw, begin = table.read(width - 1), 0
                        for name, code, length, decimals in fields:
                            row.setdefault(name, _value(raw[begin : begin + length], code, decimals, self.encoding))
                            begin += length
                    yield tuple(row.get(n) for n in wanted)
        finally:
            if table:
                table.close()


@dataclass
class _Written(WriterCommitMessage):
    stem: str
    shapes: int


def shape_record(parts: list[list[tuple[float, float]]]) -> bytes:
    """A polyline record's content."""
    if not parts:
        return struct.pack("<i", 0)
    points = [p for part in parts for p in part]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    begins, at = [], 0
    for part in parts:
        begins.append(at)
        at += len(part)
    return struct.pack(f"<i4d2i{len(parts)}i{2 * len(points)}d", 3, min(xs), min(ys), max(xs), max(ys), len(parts), len(points), *begins, *[v for p in points for v in p])


def write_shapes(stem: str, shapes: list[list[list[tuple[float, float]]]], wkt: str) -> None:
    """``stem``.shp, .shx, .dbf, .prj and .cpg with polylines and their numbers."""
    points = [p for parts in shapes for part in parts for p in part]
    box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else (0.0,) * 4
    records = [shape_record(parts) for parts in shapes]

    def head(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 3, *box, 0, 0, 0, 0)

    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx:
        shp.write(head(50 + sum(4 + len(r) // 2 for r in records)))
        shx.write(head(50 + 4 * len(records)))
        at = 50
        for n, r in enumerate(records, 1):
            shp.write(struct.pack(">2i", n, len(r) // 2) + r)
            shx.write(struct.pack(">2i", at, len(r) // 2))
            at += 4 + len(r) // 2
    with open(f"{stem}.dbf", "wb") as dbf:
        dbf.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, len(records), 65, 11) + struct.pack("<11sc4xBB14x", b"FID", b"N", 10, 0) + b"\r")
        for n in range(len(records)):
            dbf.write(b" " + f"{n:>10}".encode())
        dbf.write(b"\x1a")
    for suffix, text in ((".prj", wkt), (".cpg", ENCODING)):
        with open(stem + suffix, "w", encoding="utf-8") as f:
            f.write(text)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, wkt: str, overwrite: bool):
        self.path, self.names, self.wkt, self.overwrite = path, [f.name for f in schema.fields], wkt, overwrite

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        stem = f"part-{context.partitionId():05}-{context.taskAttemptId()}"
        shapes = []
        for row in rows:
            parts = row["parts"] if "parts" in self.names else [row["geom"]] if row["geom"] is not None else []
            shapes.append([[(p["x"], p["y"]) for p in part] for part in parts if part])
        os.makedirs(self.path, exist_ok=True)
        write_shapes(os.path.join(self.path, "." + stem), shapes, self.wkt)
        return _Written(stem, len(shapes))

    def commit(self, messages) -> None:
        """Files of the tasks that count get their names; older ones go when overwriting."""
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.startswith("part-"):
                    os.remove(os.path.join(self.path, name))
        for m in messages:
            if m is not None:
                for suffix in (".shp", ".shx", ".dbf", ".prj", ".cpg"):
                    os.replace(os.path.join(self.path, f".{m.stem}{suffix}"), os.path.join(self.path, m.stem + suffix))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                for suffix in (".shp", ".shx", ".dbf", ".prj", ".cpg"):
                    if os.path.exists(hidden := os.path.join(self.path, f".{m.stem}{suffix}")):
                        os.remove(hidden)


class ShapefileSource(DataSource):
    """Options: ``path``, ``encoding`` (default cp949), ``wkt`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "waylace_shp"

    def schema(self) -> T.StructType:
        path = check_source(self.options["path"])
        own = [T.StructField("shape_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(_POINTS))]
        taken = {f.name for f in own}
        return T.StructType([*own, *[T.StructField(n, _type(k, d)) for n, k, _, d in _fields(path[:-4] + ".dbf") if n not in taken]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(check_source(self.options["path"]), schema, self.options.get("encoding", ENCODING))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, self.options.get("wkt", 'LOCAL_CS["metric",UNIT["metre",1]]'), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
