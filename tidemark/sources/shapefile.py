"""Shapefiles of polygons as a data source of Spark.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").load("hdfs:///shapes/tracts.shp")

A row is a record: the attributes of its table as text, and its rings. Partitions are ranges of records, whose places
come from the index file, so a file of any size is read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: Fixed values of the format: bytes of a header, of an index entry, of a field's description, and the types of polygons.
_HEADER, _ENTRY, _FIELD = 100, 8, 32
_POLYGONS = (5, 15, 25)
_RINGS = ArrayType(ArrayType(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])))


def _open(path: str):
    """A random-access file of any store that Arrow knows; a plain path is a local one."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(inner)


def _bytes(path: str, start: int, size: int) -> bytes:
    with _open(path) as f:
        return f.read_at(size, start)


@dataclass(frozen=True)
class Attributes:
    """What the attribute table's header says: records, bytes before them and of each, and (name, start, size) of the fields."""

    records: int
    start: int
    size: int
    fields: tuple[tuple[str, int, int], ...]

    @classmethod
    def of(cls, path: str) -> Attributes:
        records, start, size = struct.unpack("<IHH", _bytes(path, 4, 8))
        raw = _bytes(path, _FIELD, start - _FIELD)
        fields, at = [], 1  # a record begins with its deletion mark
        for k in range(0, len(raw) - _FIELD + 1, _FIELD):
            if raw[k] == 0x0D:
                break
            name = raw[k : k + 11].split(b"\0")[0].decode("latin-1")
            fields.append((name, at, raw[k + 16]))
            at += raw[k + 16]
        return cls(records, start, size, tuple(fields))

    def row(self, record: bytes, encoding: str) -> list[str | None]:
        return [record[at : at + size].decode(encoding).strip(" \0") or None for _, at, size in self.fields]


def rings_of(content: bytes) -> list[list[tuple[float, float]]] | None:
    """The rings of a record's content; None for a null shape. Rings end where they begin, as stored; the last point is dropped."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind not in _POLYGONS:
        raise ValueError(f"shape type {kind} is no polygon")
    parts, points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", content, 44 + 4 * parts)
    out = []
    for a, b in zip(starts, starts[1:]):
        ring = list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2]))
        out.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    return out


@dataclass
class Records(InputPartition):
    first: int
    count: int

    def __post_init__(self):
        self.value = self.first


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, encoding: str, records: int):
        self.stem, self.encoding, self.step = path.removesuffix(".shp"), encoding, records

    def partitions(self) -> list[Records]:
        with _open(f"{self.stem}.shx") as f:
            n = (f.size() - _HEADER) // _ENTRY
        return [Records(a, min(self.step, n - a)) for a in range(0, n, self.step)]

    def read(self, partition: Records) -> Iterator[tuple]:
        index = _bytes(f"{self.stem}.shx", _HEADER + _ENTRY * partition.first, _ENTRY * partition.count)
        table = Attributes.of(f"{self.stem}.dbf")
        rows = _bytes(f"{self.stem}.dbf", table.start + table.size * partition.first, table.size * partition.count)
        with _open(f"{self.stem}.shp") as shapes:
            for i, (offset, size) in enumerate(struct.iter_unpack(">2i", index)):  # both in words of two bytes
                record = rows[i * table.size : (i + 1) * table.size]
                if record[:1] != b"*":  # not deleted
                    yield (partition.first + i, *table.row(record, self.encoding), rings_of(shapes.read_at(2 * size, 2 * offset + 8)))


class ShapefileSource(DataSource):
    """Options: ``path`` of the .shp (or its stem), ``encoding`` of the attributes, ``records`` a partition."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _path(self) -> str:
        return self.options["path"].removesuffix(".shp")

    def schema(self) -> StructType:
        fields = [StructField(name, StringType()) for name, _, _ in Attributes.of(f"{self._path()}.dbf").fields]
        return StructType([StructField("record", LongType()), *fields, StructField("rings", _RINGS)])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self._path(), self.options.get("encoding", "latin-1"), int(self.options.get("records", 10_000)))


def read_shapefile(spark: SparkSession, path: str, **options) -> DataFrame:
    """record, the attributes, and rings (null for a null shape)."""
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").options(**options).load(path)


def regions(shapes: DataFrame, *names: str) -> DataFrame:
    """region and ring of ``read_shapefile``'s rows: the named attributes joined by ``-``, as a place's key is, one row a ring."""
    return shapes.select(F.concat_ws("-", *names).alias("region"), F.explode("rings").alias("ring"))
