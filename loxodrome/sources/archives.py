"""Readers of packed binary formats: map extracts (PBF) and shapefiles.

Files come through Spark's binaryFile reader, so each is one task's work and must
fit in it; large extracts are converted to Parquet once with these and read from
there (``readers.read_osm_extract``).
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

OSM_SCHEMA = "kind string, id long, tags map<string,string>, refs array<long>, lat double, lon double, ref_roles array<string>, ref_types array<string>"
_COLUMNS = ["kind", "id", "tags", "refs", "lat", "lon", "ref_roles", "ref_types"]
_KINDS = ("node", "way", "relation")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append((value >> 1) ^ -(value & 1) if signed else value)
    return out


def _sums(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def _blocks(content: bytes) -> Iterator[bytes]:
    """Unpacked data blocks of a PBF file."""
    at = 0
    while at < len(content):
        size = struct.unpack(">I", content[at : at + 4])[0]
        header = dict(_fields(content[at + 4 : at + 4 + size]))
        at += 4 + size
        blob = dict(_fields(content[at : at + header[3]]))
        at += header[3]
        if header[1] == b"OSMData":
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])


def _elements(block: bytes) -> Iterator[tuple]:
    texts, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for field, value in _fields(block):
        if field == 1:
            texts = [v.decode() for _, v in _fields(value)]
        elif field == 2:
            groups.append(value)
        elif field == 17:
            grain = value
        elif field in (19, 20):
            shift = value - (1 << 64) if value >> 63 else value
            lat0, lon0 = (shift, lon0) if field == 19 else (lat0, shift)

    def degrees(value: int, base: int) -> float:
        return (base + grain * value) / 1e9

    for group in groups:
        for field, value in _fields(group):
            if field == 2:
                dense = dict(_fields(value))
                ids, lats, lons = (_sums(_packed(dense.get(k, b""), True)) for k in (1, 8, 9))
                keys, at = _packed(dense.get(10, b"")), 0
                for i, la, lo in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while at < len(keys) and keys[at]:
                        tags[texts[keys[at]]] = texts[keys[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, tags, None, degrees(la, lat0), degrees(lo, lon0), None, None
            elif field in (1, 3, 4):
                parts = dict(_fields(value))
                tags = {texts[k]: texts[v] for k, v in zip(_packed(parts.get(2, b"")), _packed(parts.get(3, b"")), strict=True)}
                if field == 1:
                    number, la, lo = ((parts.get(k, 0) >> 1) ^ -(parts.get(k, 0) & 1) for k in (1, 8, 9))
                    yield "node", number, tags, None, degrees(la, lat0), degrees(lo, lon0), None, None
                elif field == 3:
                    yield "way", parts[1], tags, _sums(_packed(parts.get(8, b""), True)), None, None, None, None
                else:
                    roles = [texts[r] for r in _packed(parts.get(8, b""))]
                    kinds = [_KINDS[t] for t in _packed(parts.get(10, b""))]
                    yield "relation", parts[1], tags, _sums(_packed(parts.get(9, b""), True)), None, None, roles, kinds


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """Nodes, ways and relations of map extracts, in the eight columns of OSM_SCHEMA."""

    def rows(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for content in pdf["content"]:
                for block in _blocks(bytes(content)):
                    yield pd.DataFrame(list(_elements(block)), columns=_COLUMNS)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, OSM_SCHEMA)


def _polygons(shp: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] != 5:
            yield []
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        begins = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        yield [[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _records(dbf: bytes, encoding: str) -> Iterator[dict[str, str]]:
    count, head, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    for i in range(count):
        row, at, out = dbf[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            out[name] = row[at : at + width].decode(encoding).strip()
            at += width
        yield out


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Polygons of zipped shapefiles: file, number, properties, rings (array of arrays of (x, y)); counts of both parts must agree."""

    def rows(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = {x[-4:].lower(): x for x in archive.namelist()}
                    shapes = list(_polygons(archive.read(members[".shp"])))
                    records = list(_records(archive.read(members[".dbf"]), encoding))
                if len(shapes) != len(records):
                    raise ValueError("shapes and records differ in number")
                yield pd.DataFrame({"file": name, "number": range(len(shapes)), "properties": records, "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in s] for s in shapes]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, number int, properties map<string,string>, rings array<array<struct<x:double,y:double>>>")


def iceberg_settings(catalog: str, uri: str, warehouse: str | None = None, token: str | None = None) -> dict[str, str]:
    """Session settings of an Iceberg REST catalog; the token is the caller's to keep."""
    base = f"spark.sql.catalog.{catalog}"
    out = {base: "org.apache.iceberg.spark.SparkCatalog", f"{base}.type": "rest", f"{base}.uri": uri, "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions"}
    return out | ({f"{base}.warehouse": warehouse} if warehouse else {}) | ({f"{base}.token": token} if token else {})
