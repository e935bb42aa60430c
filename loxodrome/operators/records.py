"""Row indexes, checked merges, acquisitions and verified files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.functions.cells import mesh_bounds, mesh_code
from loxodrome.functions.crs import TransverseMercator
from loxodrome.functions.shapes import box_ring, densify_ring, projected, segments
from loxodrome.operators.quality import QualityError
from loxodrome.operators.spatial import nearest_segment
from loxodrome.operators.territory import clip_ring
from loxodrome.plans.lineage import cut


def with_row_index(df: DataFrame, *keys: str, name: str = "row_index", counted: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with numbers 0, 1, ... in order of the keys, without bringing all rows together.

    ``counted`` adds columns with the number of rows, up to and with this one, that
    meet a condition.  Rows are range-partitioned and numbered within a part; the
    parts' sizes, one line each, give where a part begins.
    """
    counted = counted or {}
    marks = {f"_c{i}": c.cast("long") for i, c in enumerate(counted.values())}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.withColumns(marks).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in marks])
    before = Window.orderBy("_part")  # one line a part
    begins = sizes.select("_part", *[(F.sum(c).over(before) - F.col(c)).alias(f"_begin{c}") for c in ("_n", *marks)])
    inside = Window.partitionBy("_part").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumns({"_i": F.row_number().over(inside) - 1, **{f"_r{c}": F.sum(c).over(upto) for c in marks}})
    joined = numbered.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin_n") + F.col("_i"))
    joined = joined.withColumns({n: F.col(f"_begin{c}") + F.col(f"_r{c}") for n, c in zip(counted, marks, strict=True)})
    return joined.drop("_part", "_begin_n", "_i", *[x for c in marks for x in (c, f"_begin{c}", f"_r{c}")])


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by a key that must be unique and present on both sides."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "_a"), (right, "_b")))
    wrong = a.join(b, key, "full").where("coalesce(_a, 0) <> 1 OR coalesce(_b, 0) <> 1")
    if not wrong.isEmpty():
        raise QualityError(f"{key} isn't one to one")
    return left.join(right, key)


def acquire(places: DataFrame, centers: Sequence[tuple[float, float]], half: float, projection: TransverseMercator, key: str = "id", licenses: Sequence[str] | None = None) -> DataFrame:
    """Places inside any of the projected squares (edges included), merged; an id with two versions or an unlisted license is an error."""
    x, y = projection.forward(F.col("lon"), F.col("lat"))
    found = places.withColumns({"x": x, "y": y})
    inside = F.lit(False)
    for cx, cy in centers:
        inside = inside | ((F.abs(F.col("x") - cx) <= half) & (F.abs(F.col("y") - cy) <= half))
    found = found.where(inside).distinct()
    if not found.groupBy(key).count().where("count > 1").isEmpty():
        raise QualityError("an id has two versions")
    if licenses is not None and not found.where(~F.coalesce(F.col("license").isin(*licenses), F.lit(False))).isEmpty():
        raise QualityError("a license isn't listed")
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length, sha256 of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, receipt: DataFrame) -> DataFrame:
    """The digests, if the files are those of the receipt (name, sha256), no fewer and no more."""
    found = cut(file_digests(spark, path))
    wrong = found.join(receipt.select("name", F.col("sha256").alias("_want")), "name", "full").where("NOT coalesce(sha256 = _want, false)")
    if not wrong.isEmpty():
        raise QualityError("files differ from their receipt")
    return found


def boundary_distance(points: DataFrame, polygons: DataFrame, reach: float, key: str = "id") -> DataFrame:
    """Distance of each point to the nearest side of any ring, up to ``reach``; null beyond it."""
    sides = polygons.select(F.posexplode(segments(F.col("ring"))).alias("pos", "s"), *[c for c in polygons.columns if c != "ring"])
    named = sides.select(F.struct(*[c for c in polygons.columns if c != "ring"], "pos").alias("edge_id"), F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    found = nearest_segment(points.select(key, "x", "y"), named, reach, key)
    return points.join(found.select(key, F.col("offset_m").alias("boundary_m")), key, "left")


def meshes_of_squares(squares: DataFrame, projection: TransverseMercator, half: float, length: int = 9, key: str = "region_id") -> DataFrame:
    """key, mesh_code, area_m2 of the common area of each square with each mesh it overlaps (beyond a millionth of a square metre).

    Meshes are listed over the corners' range with a margin of one, outlined with
    eight parts a side and clipped in the plane; squares of one place are clipped once.
    """
    factor = 1 << (length - 8)
    rows, squares = squares.select(key, F.col("x").alias("_x"), F.col("y").alias("_y")), squares.select("x", "y").distinct()
    around = F.array(*[F.struct((F.col("x") + dx * half).alias("x"), (F.col("y") + dy * half).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])

    def back(p: Column) -> Column:
        lon, lat = projection.inverse(p["x"], p["y"])
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    squares = squares.withColumn("_around", F.transform(around, back))
    lons, lats = F.col("_around.lon"), F.col("_around.lat")
    spans = [F.sequence(F.floor(F.array_min(v) * k - o * k) - 1, F.floor(F.array_max(v) * k - o * k) + 1) for v, k, o in ((lons, 80 * factor, 100), (lats, 120 * factor, 0))]
    cells = squares.withColumn("i", F.explode(spans[0])).withColumn("j", F.explode(spans[1]))
    coded = cells.withColumn("mesh_code", mesh_code((F.col("j") + 0.5) / (120 * factor), 100 + (F.col("i") + 0.5) / (80 * factor), length)).where("mesh_code IS NOT NULL")
    ring = projected(densify_ring(box_ring(mesh_bounds(F.col("mesh_code"))), 8), projection)
    parts = int(squares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = coded.select("mesh_code", "x", "y").repartition(parts, "x", "y", "mesh_code")  # few bytes take long
    shaped = coded.select("mesh_code", "x", "y", ring.alias("r")).select("mesh_code", "x", "y", F.col("r.x").alias("xs"), F.col("r.y").alias("ys"))

    def areas(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            found = [clip_ring(np.column_stack([xs, ys]), (x - half, y - half), (x + half, y + half)) for xs, ys, x, y in zip(pdf["xs"], pdf["ys"], pdf["x"], pdf["y"], strict=True)]
            yield pdf[["x", "y", "mesh_code"]].assign(area_m2=np.array(found, float))

    found = shaped.mapInPandas(areas, "x double, y double, mesh_code string, area_m2 double").where("area_m2 > 1e-6")
    return found.join(rows, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select(key, "mesh_code", "area_m2")
