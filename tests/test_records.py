import io
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loxodrome.functions import cells, crs, shapes
from loxodrome.operators import records
from loxodrome.operators.quality import QualityError
from loxodrome.sources import archives


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_lines(spark):
    bent = line((0, 0), (10, 0), (10, 20))
    got = one(spark, shapes.line_length(bent), shapes.midpoint(bent), shapes.point_along(bent, F.lit(99.0)), shapes.point_along(bent, F.lit(4.0)), shapes.representative(F.array(line((0, 0), (1, 0)), bent)), F.size(shapes.densify_ring(line((0, 0), (1, 0), (1, 1), (0, 0)), 4)))
    assert (got[0], tuple(got[1]), tuple(got[2]), tuple(got[3]), tuple(got[4]), got[5]) == (30, (10, 5), (10, 20), (4, 0), (10, 5), 13)


def test_ellipsoid_area(spark):
    octant = shapes.densify_ring(line((0, 0), (90, 0), (90, 90), (0, 90), (0, 0)), 64)
    assert abs(one(spark, shapes.ellipsoid_area(octant))[0] - 510065621724078.0 / 8) < 1e6
    mesh = shapes.ellipsoid_area(shapes.box_ring(cells.mesh_bounds(F.lit("533944461"))))
    plane = shapes.projected(shapes.densify_ring(shapes.box_ring(cells.mesh_bounds(F.lit("533944461"))), 8), crs.JAPAN_9)
    from loxodrome.operators.spatial import ring_area

    a, b = one(spark, mesh, ring_area(plane))
    assert abs(a / 261447 - 1) < 0.01 and abs(a / b - 1) < 3e-4


def test_mgrs(spark):
    got = one(spark, shapes.mgrs(F.lit(139.5796), F.lit(35.7034), 54, 0), shapes.mgrs(F.lit(139.5796), F.lit(35.7034), 54, 2), shapes.mgrs(F.lit(2.2945), F.lit(48.8584), 31, 5), shapes.mgrs(F.lit(2.0), F.lit(48.0), 54))
    assert got[0] == "54SUE" and got[1][:5] == "54SUE" and len(got[1]) == 9 and got[2].startswith("31UDQ4825") and got[3] is None


def test_row_index(spark):
    values = [(random.Random(i).randrange(10**6), i) for i in range(500)]
    got = records.with_row_index(spark.createDataFrame(values, "k long, v long").repartition(7), "k", "v").orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(500)) and [(r.k, r.v) for r in got] == sorted(values)


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string"), spark.createDataFrame([(1, 1), (2, 2)], "id long, b int")
    assert records.one_to_one(a, b, "id").count() == 2
    for bad in (b.union(b), b.where("id = 1")):
        with pytest.raises(QualityError):
            records.one_to_one(a, bad, "id")


def test_acquire(spark):
    lon, lat = crs.JAPAN_9.inverse(F.col("px"), F.col("py"))
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 499.0, 499.0), (3, 501.0, 0.0), (4, 3000.0, 0.0), (1, 0.0, 0.0)], "id long, px double, py double").select("id", lon.alias("lon"), lat.alias("lat"))
    assert sorted(r.id for r in records.acquire(places, [(0, 0), (3000, 0)], 500, crs.JAPAN_9).collect()) == [1, 2, 4]
    with pytest.raises(QualityError):
        records.acquire(places.union(places.selectExpr("id", "lon + 1e-5", "lat")), [(0, 0)], 500, crs.JAPAN_9)


def test_file_receipt(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    good = spark.createDataFrame([("a.bin", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")], "name string, sha256 string")
    assert records.verify_files(spark, str(tmp_path), good).first().length == 3
    (tmp_path / "b.bin").write_bytes(b"more")
    with pytest.raises(QualityError):
        records.verify_files(spark, str(tmp_path), good)


def test_boundary_distance(spark):
    ring = line((0, 0), (100, 0), (100, 100), (0, 100), (0, 0))
    polygons = spark.range(1).select(F.lit(5).alias("polygon_id"), ring.alias("ring"))
    points = spark.createDataFrame([(1, 50.0, 40.0), (2, 130.0, 140.0), (3, 900.0, 900.0)], "id long, x double, y double")
    assert {r.id: r.boundary_m for r in records.boundary_distance(points, polygons, 60).collect()} == {1: 40.0, 2: 50.0, 3: None}


def test_meshes_cover_their_square(spark):
    square = spark.createDataFrame([(1, -22941.7, -32905.06)], "region_id long, x double, y double")
    got = records.meshes_of_squares(square, crs.JAPAN_9, 500.0).collect()
    assert len({r.mesh_code for r in got}) == len(got) == 9 and abs(sum(r.area_m2 for r in got) - 1e6) < 1 and "533944461" in {r.mesh_code for r in got}


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def zigzag(*values):
    out, last = b"", 0
    for v in values:
        d, last = v - last, v
        out += varint((d << 1) ^ (d >> 63))
    return out


def test_pbf(spark, tmp_path):
    texts = b"".join(field(1, t) for t in (b"", b"highway", b"path", b"outer"))
    dense = field(1, zigzag(7, 9)) + field(8, zigzag(350000000, 350000010)) + field(9, zigzag(1390000000, -10)) + field(10, varint(1) + varint(2) + varint(0) + varint(0))
    way = field(1, 20) + field(2, varint(1)) + field(3, varint(2)) + field(8, zigzag(7, 9))
    relation = field(1, 30) + field(8, varint(3)) + field(9, zigzag(20)) + field(10, varint(1))
    block = field(1, texts) + field(2, field(2, dense)) + field(2, field(3, way) + field(4, relation))
    out = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = field(3, zlib.compress(body))
        header = field(1, kind) + field(3, len(blob))
        out += struct.pack(">I", len(header)) + header + blob
    (tmp_path / "x.osm.pbf").write_bytes(out)
    got = {(r.kind, r.id): r for r in archives.read_pbf(spark, str(tmp_path)).collect()}
    assert set(got) == {("node", 7), ("node", 9), ("way", 20), ("relation", 30)}
    assert got["node", 7].tags == {"highway": "path"} and got["node", 9].tags == {} and abs(got["node", 7].lat - 35) < 1e-9 and abs(got["node", 9].lon + 1e-6) < 1e-12
    assert got["way", 20].refs == [7, 9] and got["relation", 30].ref_roles == ["outer"] and got["relation", 30].ref_types == ["way"]


def test_shapefile(spark, tmp_path):
    points = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in points)
    shp = bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body
    dbf = struct.pack("<B3BIHH20x", 3, 1, 1, 1, 1, 65, 6) + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15) + b"\x0d" + b" Japan"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("w.shp", shp)
        z.writestr("w.dbf", dbf)
    (tmp_path / "w.zip").write_bytes(data.getvalue())
    r = archives.read_shapefile(spark, str(tmp_path)).first()
    assert r.properties == {"NAME": "Japan"} and [tuple(p) for p in r.rings[0]] == points
