"""Rows of one place: met once, and all there in the results."""

import math

import pytest
from pyspark.sql import functions as F

from loxodrome.functions import crs
from loxodrome.operators import chains, graph, matching, records, regions, spatial, stats, territory, vectors

PLACES = [(0.0, 0.0), (30.0, 40.0), (200.0, 10.0), (35.0, 45.0)]
ROWS = [(i, *PLACES[i % 4]) for i in range(40)]


def points(spark):
    return spark.createDataFrame(ROWS, "id long, x double, y double")


@pytest.fixture
def met(monkeypatch):
    """Rows of both sides of each spatial join."""
    seen, real = [], spatial._close
    monkeypatch.setattr(spatial, "_close", lambda left, right, *rest: seen.append((left.count(), right.count())) or real(left, right, *rest))
    return seen


def test_within_distance(spark, met):
    got = {(r.left_id, r.right_id, r.distance_m) for r in spatial.within_distance(points(spark), points(spark), 50.0, places=3).collect()}
    assert got == {(i, j, round(math.dist(p, q), 3)) for i, *p in ROWS for j, *q in ROWS if math.dist(p, q) <= 50} and met == [(4, 4)]


def test_nearest(spark, met):
    got = {(r.query_id, r["rank"]): r.point_id for r in spatial.nearest(points(spark), points(spark), 12, 60.0).collect()}
    want = {}
    for i, *p in ROWS:
        near = sorted((math.dist(p, q), j) for j, *q in ROWS if math.dist(p, q) <= 60)[:12]
        want |= {(i, n): j for n, (_, j) in enumerate(near, 1)}
    assert got == want and met == [(4, 4)]


def test_nearest_segment(spark, monkeypatch):
    segments = spark.createDataFrame([(k, 0.0, 5.0, 100.0, 5.0) for k in (9, 4, 7)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    seen, real = [], spatial._around
    monkeypatch.setattr(spatial, "_around", lambda df, *rest: seen.append(df.count()) or real(df, *rest))
    got = {r.id: (r.edge_id, r.offset_m) for r in spatial.nearest_segment(points(spark), segments, 50.0).collect()}
    assert got == {i: (4, abs(y - 5)) for i, x, y in ROWS if x <= 100} and seen == [4]


def test_polygons(spark, monkeypatch):
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)]
    areas = spark.createDataFrame([(k, ring) for k in (1, 2)], "area_id long, ring array<struct<x:double,y:double>>")
    want = {(i, k) for i, x, y in ROWS if x < 100 for k in (1, 2)}
    assert {(r.id, r.area_id) for r in spatial.points_in_polygons(points(spark), areas, 50.0, "area_id").collect()} == want
    plain = regions.assign_to_polygons(points(spark), areas, regions.polygon_grid(areas, 50), 50).groupBy("area_id", "cell_id").agg(F.count("*").alias("n"))
    seen, real = [], regions.assign_to_polygons
    monkeypatch.setattr(regions, "assign_to_polygons", lambda p, a, *rest, **given: seen.append((p.count(), a.count())) or real(p, a, *rest, **given))
    assert set(map(tuple, regions.count_in_polygons(points(spark), areas, 50).collect())) == set(map(tuple, plain.collect())) and seen == [(4, 1)]


def test_profiles(spark, met):
    rows = points(spark).withColumn("category_group", F.when(F.col("id") % 3 == 0, "A").otherwise("B"))
    one = {r.region_id: r for r in regions.region_profiles(rows, points(spark), ["A", "B"], 50.0, 25.0).collect()}
    for i, *p in ROWS:
        near = [j for j, *q in ROWS if max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 50]
        assert one[i].poi_count == len(near) and one[i].A_share == sum(j % 3 == 0 for j in near) / len(near)
    wide = regions.width_profiles(rows, points(spark), (20, 50), 25.0).collect()
    assert {(r.region_id, r.half): r.poi_count for r in wide} == {(i, h): sum(max(abs(x - u), abs(y - v)) <= h for _, u, v in ROWS) for i, x, y in ROWS for h in (20.0, 50.0)}
    assert met == [(4, 4), (4, 4)]


def test_weighted_overlap(spark):
    rows = [(1, i % 2 == 0, i % 3 == 0, "AB"[i % 5 == 0]) for i in range(30)]
    whole = spark.createDataFrame(rows, "x long, a boolean, b boolean, category_group string")
    counted = whole.groupBy("x", "a", "b", "category_group").agg(F.count("*").alias("n"))
    assert stats.overlap(counted, [("a", "b")], ["x"], ["A", "B"], weight="n").collect() == stats.overlap(whole.withColumnRenamed("x", "k"), [("a", "b")], ["k"], ["A", "B"]).withColumnRenamed("k", "x").collect()


def test_independent_subset(spark, met):
    got = sorted(r.region_id for r in vectors.independent_subset(points(spark).withColumnRenamed("id", "region_id").union(spark.createDataFrame([(90, None, 0.0), (91, None, 0.0)], "id long, x double, y double")), 100.0).collect())
    assert got == [0, 2, 90, 91] and met == [(6, 6)]


def test_neighbours_of_kinds(spark):
    """More regions than are allowed kinds; as each region ranked on its own."""
    rows = [(n, i, float(i % 6 * 10), 0.0, float((i % 6) ** 2 * (1 + k) % 7), float(i % 3)) for k, n in enumerate("ab") for i in range(30)]
    frames = spark.createDataFrame(rows, "name string, region_id long, x double, y double, p double, q double")
    got = {r.region_id: (r.common_top, round(r.spearman, 9)) for r in chains.compare_neighbours(frames, [("a", "b")], ["p", "q"], 15.0, top=4, most=6).collect()}
    of = {(r[0], r[1]): r[2:] for r in rows}
    for i in range(30):
        others = [j for j in range(30) if abs(of["a", j][0] - of["a", i][0]) >= 15]
        d, e = ([round(math.dist(of[n, i][2:], of[n, j][2:]), 9) for j in others] for n in "ab")
        top = [set(sorted(range(len(others)), key=lambda k: (z[k], others[k]))[:4]) for z in (d, e)]
        r, s = ([sum(v < w for v in z) + (sum(v == w for v in z) + 1) / 2 for w in z] for z in (d, e))
        m = sum(r) / len(r)
        rho = sum((a - m) * (b - m) for a, b in zip(r, s)) / math.sqrt(sum((a - m) ** 2 for a in r) * sum((b - m) ** 2 for b in s))
        assert got[i] == (len(top[0] & top[1]), round(rho, 9)), i
    assert len(got) == 30


def test_road_by_place_gives_the_raster_of_all_rows(spark):
    spots = [(10.0, 10.0), (90.0, 20.0), (150.0, 90.0), (60.0, 130.0), (20.0, 90.0)]
    nodes = spark.createDataFrame([(i, *spots[i * 7 % 11 % 5]) for i in range(23)], "node_id long, x double, y double")
    stations = spark.createDataFrame([(1, 5.0, 5.0), (2, 155.0, 95.0), (3, 155.0, 95.0)], "id long, x double, y double")

    def cells(nodes, edges, lengthless=False, **given):
        sources = spatial.nearest(stations, nodes.select("node_id", "x", "y"), 1, 300, "id", "node_id").select(F.col("point_node_id").alias("node"), F.col("distance_m").alias("dist"), F.col("query_id").alias("owner"))
        known = nodes.join(graph.nearest_owners(edges, sources).withColumnRenamed("node", "node_id"), "node_id")
        edges = edges.where("length_m > 0") if lengthless else edges
        found = territory.raster(territory.densify(edges, known, 30.0, **given), 0.0, 0.0, 8, 8, 20.0, 60.0)
        return sorted((r.row, r.col, r.dist if r.dist is None else round(r.dist, 9), r.owner) for r in found.collect())

    close = spatial.within_distance(nodes.withColumnRenamed("node_id", "id"), nodes.withColumnRenamed("node_id", "id"), 100).where("left_id < right_id")
    rows = close.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"), F.col("distance_m").alias("length_m"), F.xxhash64("left_id", "right_id").alias("edge_id"))
    zero = rows.where("length_m = 0").count()
    known, edges = territory.place_roads(nodes, 100)
    assert zero > 0 and known.count() == 5 and edges.count() <= 20
    want = cells(nodes, rows, lengthless=True)
    assert cells(known, edges, copies=True) == want and len({r[3] for r in want}) > 1


def test_names_of_a_place_meet_once_and_all_pairs_are_there(spark):
    left = [(f"l{i}", f"n{i % 2}", None if i % 7 == 3 else float(i % 3), 0.5) for i in range(30)] + [("none", "", 0.0, 0.0)]
    right = [(f"r{i}", f"n{i % 3}", float(i % 2) / 3, None if i % 5 == 4 else 0.0) for i in range(24)]
    a, b = (spark.createDataFrame(rows, "source_id string, name_normalized string, x double, y double") for rows in (left, right))

    def distance(p, q):
        return None if None in (*p[2:], *q[2:]) else round(math.hypot(p[2] - q[2], p[3] - q[3]), 3)

    want = sorted((p[0], q[0], str(distance(p, q))) for p in left for q in right if p[1] == q[1] != "")
    found = matching.exact_name_distances(a, b, each=2, places=3)
    assert sorted((r.left_id, r.right_id, str(r.distance_m)) for r in found.collect()) == want


def test_squares_of_a_place_are_clipped_once(spark, monkeypatch):
    squares = spark.createDataFrame([(i, -22941.7 + i % 2 * 300, -32905.06) for i in range(60)], "region_id long, x double, y double")
    seen, kind = [], type(squares)
    plain = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, *given, **more: (seen.append(self.count()), plain(self, *given, **more))[1])
    got = records.meshes_of_squares(squares, crs.JAPAN_9, 500.0).collect()
    assert seen[0] < 60 and {r.region_id for r in got} == set(range(60))
    for i in range(60):
        own = [r for r in got if r.region_id == i]
        assert abs(sum(r.area_m2 for r in own) - 1e6) < 1 and len({r.mesh_code for r in own}) == len(own)
