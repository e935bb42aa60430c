"""Readers of pinned snapshots and exchange formats, each behind a schema gate.

Paths go to Spark's own readers only, so any store that the cluster reads works.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tomllib
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loxodrome.functions.shapes import assemble_rings
from loxodrome.operators.quality import QualityError, require_columns

GEOJSON = "struct<type:string,features:array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
OSM_COLUMNS = {"kind": "string", "id": "bigint", "tags": "map<string,string>", "refs": "array<bigint>", "lat": "double", "lon": "double", "ref_roles": "array<string>", "ref_types": "array<string>"}


@dataclass(frozen=True)
class Snapshot:
    """A pinned version of a table: its id, place in time, and path."""

    snapshot_id: int
    sequence: int
    committed_at: str
    path: str


def snapshot_id(value: object) -> int:
    """A valid id: ASCII digits, above 0 and below 2**63; anything else is an error, so no text reaches a query."""
    text = str(value)
    if not (text.isascii() and text.isdigit()) or not 0 < int(text) < 1 << 63:
        raise ValueError("a snapshot id must be a positive 64-bit number")
    return int(text)


class SnapshotRegistry:
    """Versions of tables, kept as JSON lines (table, snapshot_id, sequence, committed_at, path) in a shared place."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def list(self, table: str) -> list[Snapshot]:
        """Newest first, by time, sequence and id."""
        schema = "table string, snapshot_id long, sequence long, committed_at string, path string"
        rows = self.spark.read.schema(schema).json(self.path).where(F.col("table") == table)
        ordered = rows.orderBy(F.desc("committed_at"), F.desc("sequence"), F.desc("snapshot_id"))
        return [Snapshot(r["snapshot_id"], r["sequence"], r["committed_at"], r["path"]) for r in ordered.collect()]  # one line a version

    def pick(self, table: str, wanted: object | None = None) -> Snapshot:
        """The wanted version, or the newest; a version that is not there is an error, never another one."""
        found = self.list(table)
        if wanted is None:
            if not found:
                raise QualityError(f"no snapshot of {table}")
            return found[0]
        key = snapshot_id(wanted)
        for s in found:
            if s.snapshot_id == key:
                return s
        raise QualityError(f"no snapshot {key} of {table}")

    def read(self, table: str, wanted: object | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
        return read_parquet(self.spark, [self.pick(table, wanted).path], columns or {})


def iceberg_snapshot(spark: SparkSession, table: str, wanted: object) -> DataFrame:
    """A pinned version of an Iceberg table of a configured catalog."""
    return spark.read.option("snapshot-id", str(snapshot_id(wanted))).table(table)


def read_parquet(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str], forbidden: Sequence[str] = ()) -> DataFrame:
    """One or more files or partitioned folders, if they have the required columns."""
    return require_columns(spark.read.parquet(*paths), columns, forbidden)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole documents; what doesn't parse is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """With a header and declared types, so codes keep their leading zeros."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "FAILFAST").csv(path)


def read_zipped_csv(spark: SparkSession, path: str, encoding: str = "cp932", skip: int = 1) -> DataFrame:
    """Rows of the CSV members of ZIP files as (file, member, line, values: map of texts); ``skip`` lines after the header are left out, blanks are kept."""
    import csv

    def rows(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(x for x in archive.namelist() if x.lower().endswith((".csv", ".txt"))):
                        lines = list(csv.reader(io.StringIO(archive.read(member).decode(encoding))))
                        head = lines[0] if lines else []
                        body = lines[1 + skip :]
                        if body:
                            yield pd.DataFrame({"file": name, "member": member, "line": range(len(body)), "values": [dict(zip(head, x, strict=False)) for x in body]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, member string, line int, values map<string,string>")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole files: file, properties (map), geometry_type, coordinates (JSON text), problem (null: none); a file that doesn't parse is one row with its problem."""
    text = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return geojson_features(text, "value")


def geojson_features(texts: DataFrame, column: str) -> DataFrame:
    parsed = texts.withColumn("_doc", F.from_json(column, GEOJSON, {"mode": "PERMISSIVE"}))
    problem = F.when(F.col("_doc.type").isNull(), "not_json").when(F.col("_doc.type") != "FeatureCollection", "not_a_collection").when(F.col("_doc.features").isNull(), "no_features")
    rows = parsed.withColumn("problem", problem).select(*[c for c in texts.columns if c != column], "problem", F.explode_outer("_doc.features").alias("f"))
    return rows.select(*[c for c in texts.columns if c != column], "problem", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def ring_of(coordinates: Column) -> Column:
    """Outer ring of a polygon's coordinates as array of (x, y)."""
    rings = F.from_json(coordinates, "array<array<array<double>>>")
    return F.transform(rings[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def line_of(coordinates: Column) -> Column:
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def check_ring(ring: Column, west: float, south: float, east: float, north: float) -> Column:
    """First fault of a lon, lat ring: unclosed, too_short, out_of_range (swapped axes show here), clockwise, outside; null for none."""
    from loxodrome.operators.spatial import ring_area

    first, last = ring[0], F.element_at(ring, -1)
    ranges = F.forall(ring, lambda p: F.coalesce((F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90), F.lit(False)))
    inside = F.forall(ring, lambda p: p["x"].between(west, east) & p["y"].between(south, north))
    return F.when(ring.isNull() | (F.size(ring) < 4), "too_short").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "unclosed").when(~ranges, "out_of_range").when(ring_area(ring) <= 0, "clockwise").when(~inside, "outside")


def read_osm_extract(spark: SparkSession, *paths: str) -> DataFrame:
    """A map extract with the eight columns of elements, nodes, ways and relations alike."""
    return read_parquet(spark, paths, OSM_COLUMNS)


def way_points(ways: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Ordered points of each way; null if a node is missing, never a shorter line."""
    at = ways.select(key, F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node"))
    met = at.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node", "left")
    whole = met.groupBy(key, "n").agg(F.count("lon").alias("known"), F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")))).alias("ps"))
    return whole.select(key, F.when(F.col("known") == F.col("n"), F.transform("ps", lambda s: s["p"])).alias("points"))


def relation_ways(relations: DataFrame, lines: DataFrame, key: str = "id") -> DataFrame:
    """Member lines of each relation by role, as arrays; null if any member way is missing or broken."""
    member = F.arrays_zip(F.col("refs").alias("ref"), F.col("ref_roles").alias("role"), F.col("ref_types").alias("kind"))
    at = relations.select(key, F.posexplode(member).alias("pos", "m")).where("m.kind = 'way'").select(key, "pos", F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))
    met = at.join(lines.select(F.col(lines.columns[0]).alias("ref"), "points"), "ref", "left")
    sides = [F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "inner") == inner, F.struct("pos", "points")))), lambda s: s["points"]).alias(name) for inner, name in ((False, "outer"), (True, "inner"))]
    sums = met.groupBy(key).agg(F.count("*").alias("n"), F.count("points").alias("known"), *sides)
    return sums.select(key, *[F.when(F.col("known") == F.col("n"), F.col(c)).alias(c) for c in ("outer", "inner")])


def relation_polygons(members: DataFrame, key: str = "id") -> DataFrame:
    """key, outer, inner: closed rings of what ``relation_ways`` returns; both null where a way is missing or a ring stays open."""
    rings = members.select(key, *[assemble_rings(F.col(c)).alias(c) for c in ("outer", "inner")])
    whole = F.col("outer").isNotNull() & F.col("inner").isNotNull() & (F.size("outer") > 0)
    return rings.select(key, *[F.when(whole, F.col(c)).alias(c) for c in ("outer", "inner")])


def _unsigned(blob: Column, little: Column, at: int, bytes_: int) -> Column:
    """The bytes from ``at`` (from 1) as hexadecimal digits, most significant first."""
    part = F.hex(F.substring(blob, at, bytes_))
    turned = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in reversed(range(bytes_))])
    return F.when(little, turned).otherwise(part)


def _float(digits: Column) -> Column:
    """A double from its 16 hexadecimal digits; null if it is no finite number."""
    head = F.conv(F.substring(digits, 1, 3), 16, 10).cast("int")
    sign, exponent = F.when(head >= 2048, -1.0).otherwise(1.0), head % 2048
    fraction = F.conv(F.substring(digits, 4, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    normal = sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023)
    return F.when(exponent == 2047, None).when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022))).otherwise(normal)


def wkb_point(blob: Column | str) -> Column:
    """Struct of x and y of WKB and EWKB points, with or without Z, M and SRID; both are null for null, for other shapes and for cut or empty ones."""
    blob = F.col(blob) if isinstance(blob, str) else blob
    little = F.hex(F.substring(blob, 1, 1)) == F.lit("01")
    kind = F.conv(_unsigned(blob, little, 2, 4), 16, 10).cast("long")
    flags = F.floor(kind / (1 << 29)).cast("long")  # Z 4, M 2, SRID 1
    plain = kind % (1 << 29)
    axes = 2 + F.when(flags.bitwiseAND(F.lit(4)) != 0, 1).otherwise(0) + F.when(flags.bitwiseAND(F.lit(2)) != 0, 1).otherwise(0) + F.when(plain.isin(1001, 2001), 1).when(plain == 3001, 2).otherwise(0)
    named = flags.bitwiseAND(F.lit(1)) != 0
    good = plain.isin(1, 1001, 2001, 3001) & (F.octet_length(blob) == 5 + F.when(named, 4).otherwise(0) + 8 * axes)
    x, y = (F.when(named, _float(_unsigned(blob, little, at + 4, 8))).otherwise(_float(_unsigned(blob, little, at, 8))) for at in (6, 14))
    whole = good & x.isNotNull() & y.isNotNull()
    return F.struct(F.when(whole, x).alias("x"), F.when(whole, y).alias("y"))


@F.pandas_udf(T.BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])


def raster_rows(spark: SparkSession, dist, owner) -> DataFrame:  # noqa: ANN001
    """A small dense raster of the driver as rows (row, col, dist, owner); NaN and negative owners become null."""
    rows = [(i, j, None if d != d else float(d), None if o < 0 else int(o)) for i, (ds, os_) in enumerate(zip(dist, owner, strict=True)) for j, (d, o) in enumerate(zip(ds, os_, strict=True))]
    return spark.createDataFrame(rows, "row long, col long, dist double, owner long")


def response_path(root: str, endpoint: str, query: str) -> str:
    """Where the response to a request is kept: the name is the hash of the request, so nothing is overwritten by another."""
    return f"{root.rstrip('/')}/{hashlib.sha256(f'{endpoint}{chr(10)}{query}'.encode()).hexdigest()}.json"


@dataclass(frozen=True)
class Area:
    """An area of interest: a box in degrees and its centre."""

    name: str
    west: float
    south: float
    east: float
    north: float

    def __post_init__(self) -> None:
        if not (-180 <= self.west < self.east <= 180 and -90 <= self.south < self.north <= 90):
            raise ValueError("an area needs west < east and south < north in degrees")


def load_area(text: str) -> Area:
    """An area from TOML text."""
    d = tomllib.loads(text)
    return Area(str(d["name"]), *[float(d["bbox"][k]) for k in ("west", "south", "east", "north")])


def in_area(lon: Column, lat: Column, area: Area) -> Column:
    """Inclusive on all sides."""
    return lon.between(area.west, area.east) & lat.between(area.south, area.north)
