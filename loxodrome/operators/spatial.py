"""Spatial joins: a grid of buckets turns a distance condition into an equi-join.

Points are two double columns.  A bucket is as wide as the reach of the join, so
all partners lie in the 3 x 3 buckets around a point; the smaller side is copied
to these nine, and the exact condition is checked on what meets.  Work follows
the number of close pairs, and AQE splits a crowded bucket.

Rows of one place are alike in all that depends on it: places meet once, and what
they find goes to their rows by an equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.plans.lineage import cut


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def _around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """``df`` nine times, with the buckets _bx, _by around each point."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("_bx", F.explode(F.transform(near, lambda d: _bucket(F.col(x), size) + d))).withColumn("_by", F.explode(F.transform(near, lambda d: _bucket(F.col(y), size) + d)))


def _close(left: DataFrame, right: DataFrame, size: float, prefixes: tuple[str, str]) -> DataFrame:
    a, b = prefixes
    here = _prefixed(left, a)
    here = here.withColumns({"_bx": _bucket(F.col(f"{a}x"), size), "_by": _bucket(F.col(f"{a}y"), size)})
    # Few bytes make many pairs: a number of parts that AQE doesn't lower.
    here = here.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"{a}x", f"{a}y")
    return here.join(_around(_prefixed(right, b), f"{b}x", f"{b}y", size), ["_bx", "_by"]).drop("_bx", "_by")


def _near_places(left: DataFrame, right: DataFrame, radius: float, prefixes: tuple[str, str]) -> DataFrame:
    """Each place of the left with each of the right at most ``radius`` away, and distance_m."""
    if not radius > 0:
        raise ValueError("radius must be positive")
    a, b = prefixes
    distance = F.hypot(F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y"))
    return _close(left.select("x", "y").distinct(), right.select("x", "y").distinct(), radius, prefixes).withColumn("distance_m", distance).where(F.col("distance_m") <= radius)


def within_distance(left: DataFrame, right: DataFrame, radius: float, prefixes: tuple[str, str] = ("left_", "right_"), places: int | None = None) -> DataFrame:
    """All pairs at most ``radius`` apart (inclusive), with distance_m (rounded to ``places``, if given); ``right``, the smaller side, is copied to nine buckets."""
    a, b = prefixes
    near = _near_places(left, right, radius, prefixes)
    if places is not None:
        near = near.withColumn("distance_m", F.round("distance_m", places))
    here, there = _prefixed(left, a), _prefixed(right, b)
    return near.join(there, [f"{b}x", f"{b}y"]).join(here, [f"{a}x", f"{a}y"]).select(*here.columns, *there.columns, "distance_m")


def covered_by_squares(points: DataFrame, centers: DataFrame, half: float, prefixes: tuple[str, str] = ("point_", "square_")) -> DataFrame:
    """Each point with each square of half width ``half`` that covers it; all edges belong to the square."""
    a, b = prefixes
    near = (F.abs(F.col(f"{a}x") - F.col(f"{b}x")) <= half) & (F.abs(F.col(f"{a}y") - F.col(f"{b}y")) <= half)
    return _close(points, centers, half, prefixes).where(near)


def overlapping_squares(centers: DataFrame, width: float, key: str = "id") -> DataFrame:
    """Pairs a < b of squares of one width whose common area is positive; touching ones have none."""
    pairs = _close(centers.select(key, "x", "y"), centers.select(key, "x", "y"), width, ("a_", "b_"))
    dx, dy = (F.greatest(F.lit(float(width)) - F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), F.lit(0.0)) for c in "xy")
    return pairs.where(F.col(f"a_{key}") < F.col(f"b_{key}")).withColumn("overlap_m2", dx * dy).where("overlap_m2 > 0").select(F.col(f"a_{key}").alias("region_a"), F.col(f"b_{key}").alias("region_b"), "overlap_m2")


def nearest(queries: DataFrame, points: DataFrame, k: int, reach: float, query_key: str = "id", point_key: str = "id", prefixes: tuple[str, str] = ("query_", "point_")) -> DataFrame:
    """The k nearest points of each query within ``reach``, ranked from 1; equal distances by the point's key.

    A place's k first points are all that can be among a query's k nearest, and
    queries of one place have the same ones.
    """
    a, b = prefixes
    place = Window.partitionBy(f"{a}x", f"{a}y")
    near = _near_places(queries, points, reach, prefixes).withColumn("_at", F.rank().over(place.orderBy("distance_m"))).where(F.col("_at") <= k).drop("_at")
    here, there = _prefixed(queries, a), _prefixed(points, b)
    few = there.withColumn("_at", F.row_number().over(Window.partitionBy(f"{b}x", f"{b}y").orderBy(f"{b}{point_key}"))).where(F.col("_at") <= k).drop("_at")
    found = near.join(few, [f"{b}x", f"{b}y"]).withColumn("rank", F.row_number().over(place.orderBy("distance_m", f"{b}{point_key}"))).where(F.col("rank") <= k)
    return here.join(found, [f"{a}x", f"{a}y"]).select(*here.columns, *there.columns, "distance_m", "rank")


def least_total(queries: DataFrame, points: DataFrame, k: int, reach: float, cost: str, query_key: str = "id", point_key: str = "id") -> DataFrame:
    """Of a query's k nearest points, the one with the least cost plus distance (nearer first); all queries are kept, with nulls if none is in reach."""
    close = nearest(queries, points, k, reach, query_key, point_key)
    total = F.col(f"point_{cost}") + F.col("distance_m")
    best = close.groupBy(F.col(f"query_{query_key}").alias(query_key)).agg(F.min(F.struct(total.alias("total"), "rank", F.col(f"point_{point_key}").alias("point"))).alias("_best"))
    return queries.join(best, query_key, "left").withColumns({"total": F.col("_best.total"), "nearest_id": F.col("_best.point")}).drop("_best")


def all_within_or_nearest(queries: DataFrame, points: DataFrame, radius: float, query_key: str = "id", point_key: str = "id") -> DataFrame:
    """All points within ``radius``; for a query without any, its single nearest point, however far.

    The nearest is searched in rings that grow fourfold, at most until they reach
    across queries and points.  A query or point without finite coordinates has
    no row.
    """
    finite = F.lit(True)
    for c in "xy":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    queries, points = cut(queries.where(finite)), cut(points.where(finite))
    near = within_distance(queries, points, radius, ("query_", "point_"))
    left = cut(queries.join(near.select(F.col(f"query_{query_key}").alias(query_key)).distinct(), query_key, "left_anti"))
    box = queries.select("x", "y").union(points.select("x", "y")).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    if points.isEmpty() or left.isEmpty():
        return near
    across = math.hypot(box["highx"] - box["lowx"], box["highy"] - box["lowy"])
    reach, out = 2.0 * radius, near
    while not left.isEmpty():
        found = cut(nearest(left, points, 1, reach, query_key, point_key))
        out = out.unionByName(found.drop("rank"))
        left = cut(left.join(found.select(F.col(f"query_{query_key}").alias(query_key)), query_key, "left_anti"))
        if reach > across:
            break
        reach *= 4
    return out


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length along a segment to the foot of a point, inside the segment."""
    length2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.coalesce(F.try_divide((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1), length2), F.lit(0.0))
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * F.sqrt(length2)


def nearest_segment(points: DataFrame, segments: DataFrame, reach: float, point_key: str = "id", segment_key: str = "edge_id") -> DataFrame:
    """Nearest segment of each point within ``reach``: segment, offset_m, position_m along it; equal distances by the segment's key.

    Segments (x1, y1, x2, y2) lie in all buckets that their box meets, points in
    the nine around theirs.  Of equal segments the first by key can be nearest, and
    points of one place have the same one.
    """
    ends = ["x1", "y1", "x2", "y2"]
    segments = segments.groupBy(*ends).agg(F.min(segment_key).alias(segment_key))
    cells = [F.sequence(_bucket(F.least(f"{c}1", f"{c}2"), reach), _bucket(F.greatest(f"{c}1", f"{c}2"), reach)) for c in "xy"]
    spread = segments.withColumn("_bx", F.explode(cells[0])).withColumn("_by", F.explode(cells[1]))
    met = _around(points.select("x", "y").distinct(), "x", "y", reach).join(spread, ["_bx", "_by"])
    p = along(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    t = F.coalesce(F.try_divide(p, length), F.lit(0.0))
    offset = F.hypot(F.col("x") - F.col("x1") - t * (F.col("x2") - F.col("x1")), F.col("y") - F.col("y1") - t * (F.col("y2") - F.col("y1")))
    best = F.min(F.struct(offset.alias("offset_m"), F.col(segment_key).alias("segment"), p.alias("position_m")))
    found = met.groupBy("x", "y").agg(best.alias("_best")).where(F.col("_best.offset_m") <= reach)
    found = points.select(point_key, "x", "y").join(found, ["x", "y"]).groupBy(point_key).agg(F.min("_best").alias("_best"))
    return found.select(point_key, F.col("_best.segment").alias(segment_key), F.col("_best.offset_m").alias("offset_m"), F.col("_best.position_m").alias("position_m"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring, an array of structs (x, y); points on the left or lower edge are inside."""
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(pairs, crosses)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring; positive if it runs counter-clockwise."""
    sides = F.greatest(F.size(ring) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), sides).alias("a"), F.slice(ring, F.lit(2), sides).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, polygon_key: str = "polygon_id") -> DataFrame:
    """Each point with each polygon (column ring) that holds it; polygons lie in all buckets of ``size`` that their box meets.

    Each place meets each ring once, whatever share them.
    """
    low, high = ({c: f(F.transform("ring", lambda p: p[c])) for c in "xy"} for f in (F.array_min, F.array_max))
    spread = polygons.select("ring").distinct().withColumn("_bx", F.explode(F.sequence(_bucket(low["x"], size), _bucket(high["x"], size)))).withColumn("_by", F.explode(F.sequence(_bucket(low["y"], size), _bucket(high["y"], size))))
    here = points.select("x", "y").distinct().withColumns({"_bx": _bucket(F.col("x"), size), "_by": _bucket(F.col("y"), size)})
    met = here.join(spread, ["_bx", "_by"]).where(in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("x", "y", "ring")
    held = met.join(polygons, "ring").drop("ring")
    others = [c for c in held.columns if c not in ("x", "y")]
    return points.join(held, ["x", "y"]).select(*points.columns, *others)
