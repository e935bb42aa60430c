"""DataFrame operators on small invented tables."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loxodrome.functions import shapes
from loxodrome.operators import categories, graph, matching, quality, regions, similarity, spatial, stats, territory, vectors


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_within_distance_matches_all_pairs(spark):
    r = random.Random(1)
    a, b = ([(i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(n)] for n in (80, 50))
    a.append((900, 0.0, 0.0))
    b.append((900, 30.0, 40.0))
    got = spatial.within_distance(*[spark.createDataFrame(x, "id long, x double, y double") for x in (a, b)], 50)
    want = sorted([(i, j) for i, x, y in a for j, u, v in b if np.hypot(x - u, y - v) <= 50], key=str)
    assert rows(got, "left_id", "right_id") == want and (900, 900) in want


def test_overlap_is_strict(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0), (1, 999.0, 0.0), (2, 1000.0, 0.0), (3, 2500.0, 0.0)], "id long, x double, y double")
    assert rows(spatial.overlapping_squares(s, 1000), "region_a", "region_b", "overlap_m2") == [(0, 1, 1000.0), (1, 2, 999000.0)]


def test_nearest_segment_ties_take_the_smaller_key(spark):
    segments = spark.createDataFrame([(2, 0.0, 0.0, 100.0, 0.0), (1, 0.0, 20.0, 100.0, 20.0), (3, 5.0, 5.0, 5.0, 5.0)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(7, 50.0, 10.0), (8, 130.0, -40.0), (9, 500.0, 500.0)], "id long, x double, y double")
    assert rows(spatial.nearest_segment(points, segments, 100), "id", "edge_id", "offset_m", "position_m") == [(7, 1, 10.0, 50.0), (8, 2, 50.0, 100.0)]


def test_nearest_is_found_however_far(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 90000.0, 0.0)], "id long, x double, y double")
    p = spark.createDataFrame([(5, 1.0, 0.0), (6, 2.0, 0.0), (7, 3.0, 4.0)], "id long, x double, y double")
    assert rows(spatial.all_within_or_nearest(q, p, 2.0), "query_id", "point_id") == [(1, 5), (1, 6), (2, 7)]


def test_grid_edges(spark):
    points = spark.createDataFrame([(0.0, 0.0), (250.0, 250.0), (500.0, 500.0), (250.0, 0.0), (0.0, 250.0)], "x double, y double")
    got = regions.assign(points, (0.0, 0.0), (500.0, 500.0), 250)
    assert sorted(map(tuple, got.select("ix", "iy").collect())) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1)]
    cells = regions.grid(spark, (0.0, 0.0), (300.0, 250.0), 250)
    inside = regions.count_cells(regions.assign(spark.createDataFrame([(275.0, 10.0)], "x double, y double"), (0.0, 0.0), (300.0, 250.0), 250), cells)
    assert rows(inside, "ix", "area_m2", "poi_count", "density_per_km2", "partial_cell") == [(0, 62500.0, 0, 0.0, False), (1, 12500.0, 1, 80.0, True)]


def test_partition_ids_and_shares(spark):
    points = spark.createDataFrame([(-2000.0, -2000.0, "a"), (-1750.0, -1750.0, "__OTHER__"), (0.0, 0.0, "a"), (2000.0, 2000.0, "a"), (2000.0, -2000.0, "__MISSING__")], "x double, y double, category_group string")
    got = regions.partition(points, 250, 250, ["a"])
    assert got.count() == 256 and rows(got.where("poi_count > 0"), "cell_id") == [(0,), (136,), (15,), (17,), (255,)]
    assert got.where("poi_count = 0 AND a_share IS NOT NULL").isEmpty() and got.where("cell_id = 15").first().missing_share == 1.0


def test_profile_of_an_empty_region(spark):
    points = spark.createDataFrame([(0.0, 0.0, "a"), (10.0, 0.0, "__OTHER__"), (500.0, 500.0, "__MISSING__")], "x double, y double, category_group string")
    place = spark.createDataFrame([(1, 0.0, 0.0), (2, 9000.0, 0.0)], "id long, x double, y double")
    full, empty = regions.region_profiles(points, place, ["a"]).orderBy("region_id").collect()
    assert (full.poi_count, full.a_share, full.other_share, full.category_missing_share, full.peak_density_250m) == (3, 1 / 3, 1 / 3, 1 / 3, 32.0)
    assert empty.poi_count == 0 and empty.a_share is None and empty.peak_to_mean_density_250m is None and empty.poi_density_per_km2 == 0


def test_competition_rank(spark):
    df = spark.createDataFrame([("c", 9), ("a", 10), ("b", 9), ("d", None), ("e", 1)], "key string, v long")
    assert rows(stats.competition_rank(df, "v", "key", 2), "key", "rank", "in_head") == [("a", 1, True), ("b", 2, True), ("c", 2, False)]


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (100.0,), (100.1,)], "distance_m double")
    assert {r.bin: r.n for r in stats.distance_histogram(df).collect() if r.n} == {"5": 2, "10": 1, "100": 1, ">100": 1}


def test_overlap_and_composition(spark):
    df = spark.createDataFrame([(1, True, i < 15, "cafe" if i < 15 else "other") for i in range(30)] + [(2, False, None, "cafe")], "r long, a boolean, b boolean, category_group string")
    one, none = stats.overlap(df, [("a", "b")], ["r"], ["cafe", "other"]).orderBy("r").collect()
    assert (one.jaccard, one.count_difference, one.composition_tvd, one.cafe_difference_pp, one.low_poi) == (0.5, -15, 0.5, 50.0, False)
    assert none.jaccard is None and none.composition_tvd is None and none.low_poi


def test_spearman_with_ties_and_constants(spark):
    r = random.Random(2)
    data = [("s", r.randrange(5), r.randrange(5), 1) for _ in range(50)]
    got = {(x["first"], x["second"]): x.rho for x in stats.spearman_pairs(spark.createDataFrame(data, "g string, a int, b int, c int"), "g", ["a", "b", "c"]).collect()}
    frame = pd.DataFrame(data, columns=["g", "a", "b", "c"])
    want = np.corrcoef(frame.a.rank(), frame.b.rank())[0, 1]
    assert abs(got["a", "b"] - want) < 1e-12 and got["a", "c"] is None


def view(spark, side, data):
    return spark.createDataFrame([(side, i, n, n.lower(), float(x), 0.0, p, [], []) for i, n, x, p in data], "source string, source_id string, name string, name_normalized string, x double, y double, phones array<string>, websites array<string>, address_parts array<map<string,string>>")


def test_matching_truth_table(spark):
    left = view(spark, "l", [("a", "Cafe X", 0, ["0312345678"]), ("b", "Bar", 1000, []), ("c", "", 2000, []), ("d", "Dup", 3000, []), ("e", "Far", 4000, []), ("f", "Clash", 5000, ["0311111111"]), ("g", "Alone", 9000, [])])
    right = view(spark, "r", [("A", "Cafe X", 10, ["0312345678"]), ("B", "Bart", 1010, []), ("C", "Any", 2010, []), ("D", "Dup", 3010, []), ("D2", "Dup", 3020, []), ("E", "Far", 4050, []), ("F", "Clash", 5010, ["0322222222"])])
    pairs = matching.classify_pairs(matching.candidate_pairs(left, right))
    got = {(r.left_id, r.right_id): (r.status, r.reasons) for r in pairs.collect()}
    assert got["a", "A"] == ("high_confidence", "")
    assert got["b", "B"] == ("unmatched", "no_name_evidence")
    assert got["c", "C"] == ("unmatched", "missing_name")
    assert got["d", "D"] == ("ambiguous", "multiple_exact_name_candidates;competing_candidate")
    assert got["e", "E"] == ("ambiguous", "distance_over_auto_threshold")
    assert got["f", "F"] == ("ambiguous", "conflicting_phone")
    left_over = {(r.source, r.source_id): r.reason for r in matching.unmatched_records(left, right, pairs).collect()}
    assert left_over["l", "g"] == "no_spatial_candidate" and left_over["l", "c"] == "insufficient_evidence" and ("l", "a") not in left_over
    with pytest.raises(ValueError):
        matching.candidate_pairs(left, right, 1001)


def test_category_descendants(spark):
    d = spark.createDataFrame([("1", "Café", None), ("2", "Roastery", "1"), ("3", "Cafeteria", None)], "category_id string, category_name string, level1 string")
    wanted = categories.descendants(d, ["Cafe"], ["level1"])
    assert rows(wanted, "category_id") == [("1",), ("2",)]
    places = spark.createDataFrame([("p", ["1", "2", "9"]), ("q", ["3"]), ("r", []), ("s", None)], "id string, ids array<string>")
    assert rows(categories.having_any(places, "ids", wanted, "id"), "id") == [("p",)]
    assert rows(categories.unknown_ids(places, "ids", d), "category_id") == [("9",)]


def test_reference_check(spark):
    df = spark.createDataFrame([("a", "b;c"), ("b", "a"), ("c", ""), ("d", "x")], "k string, t string")
    assert rows(categories.check_references(df, "k", "t"), "direction", "from_key", "to_key") == [("missing", "d", "x"), ("one_way", "a", "c"), ("one_way", "d", "x")]


def test_gates(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    assert quality.gate(df, "id", {}, 2) is df
    for bad in ({"conditions": {"v": F.col("v") > 0}}, {"conditions": {}, "expected": 3}):
        with pytest.raises(quality.QualityError):
            quality.gate(df, "id", **bad)
    with pytest.raises(quality.QualityError):
        quality.gate(df.union(df), "id", {})
    with pytest.raises(quality.QualityError):
        quality.require_columns(df, {"id": "int"})
    with pytest.raises(quality.QualityError):
        quality.require_columns(df, {"id": "bigint"}, ["v"])
    assert rows(quality.violations(df, {"small": F.col("v") < 1, "id": F.col("id") < 2}), "id", "rule") == [(1, "small"), (2, "id")]
    assert quality.conserved(df, df, ["id"], "v").isEmpty()


def test_scale_of_zero_stops_the_ranking(spark):
    data = [(i, 5, 5.0, 0.5, 1.0) for i in range(4)]
    profiles = spark.createDataFrame(data, "region_id long, poi_count long, poi_density_per_km2 double, a_share double, peak_to_mean_density_250m double")
    with pytest.raises(Exception, match="is zero"):
        similarity.robust_transform(profiles, ["a_share"]).collect()


def test_rankings_and_stability(spark):
    r = random.Random(42)
    profiles = spark.createDataFrame([(i, 10 + i, r.uniform(1, 90), r.random(), r.random(), r.uniform(1, 9)) for i in range(30)] + [(99, 0, 0.0, None, None, None)], "region_id long, poi_count long, poi_density_per_km2 double, a_share double, b_share double, peak_to_mean_density_250m double")
    places = spark.createDataFrame([(i, 400.0 * i, 0.0) for i in [*range(30), 99]], "region_id long, x double, y double")
    main = similarity.rank_regions(profiles, places, 3, ["a_share", "b_share"]).collect()
    assert len(main) == 29 and sorted(x.region_id for x in main if x.excluded_from_main) == [1, 2, 4, 5] and sorted(x["rank"] for x in main if x["rank"]) == list(range(1, 26))
    assert all(abs(x.density_contribution + x.composition_contribution + x.concentration_contribution - 1) < 1e-9 for x in main)
    table = {x.mode: x for x in similarity.stability(profiles, places, 3, ["a_share", "b_share"]).collect()}
    assert table["main"].top_overlap == 10 and table["main"].top_jaccard == 1.0 and set(table) == set(similarity.MODES)


def plain_dijkstra(edges, sources):
    out = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
        out.setdefault(v, []).append((u, w))
    heap, best = [(d, o, n) for n, d, o in sources], {}
    heapq.heapify(heap)
    while heap:
        d, o, n = heapq.heappop(heap)
        if n not in best:
            best[n] = (d, o)
            for v, w in out.get(n, []):
                heapq.heappush(heap, (d + w, o, v))
    return {(n, d, o) for n, (d, o) in best.items()}


def test_owners_match_dijkstra(spark):
    r = random.Random(31)
    edges = [(r.randrange(60), r.randrange(60), float(r.randrange(1, 9))) for _ in range(110)] + [(200, 201, 1.0)]
    sources = [(3, 0.0, 7), (40, 2.0, 5), (3, 0.0, 6), (500, 1.0, 9)]
    e, s = spark.createDataFrame(edges, "u long, v long, length_m double"), spark.createDataFrame(sources, "node long, dist double, owner long")
    want = plain_dijkstra(edges, sources)
    for block in (None, F.floor(F.col("node") / 10), F.lit(0)):
        assert {tuple(x) for x in graph.nearest_owners(e, s, block).collect()} == want


def test_intervals(spark):
    def cut(length, du, dv, budget, offset=None, position=None):
        args = [F.lit(x).cast("double") for x in (length, du, dv, budget)]
        own = {} if offset is None else {"station_offset": F.lit(float(offset)), "station_position": F.lit(float(position))}
        return [tuple(x) for x in spark.range(1).select(graph.reachable_intervals(*args, **own)).first()[0]]

    assert cut(100, 0, None, 30) == [(0, 30)] and cut(100, 90, 90, 100) == [(0, 10), (90, 100)] and cut(100, 40, 40, 100) == [(0, 100)]
    assert cut(100, None, None, 20, 5, 50) == [(35, 65)] and cut(100, None, None, 3, 5, 50) == [] and cut(100, 0, None, 40, 0, 50) == [(0, 90)]


def test_station_groups_chain(spark):
    data = [(0, "g1", "A", "4号線丸ノ内線", "o", 0.0, 0.0), (1, "g2", "A", "x", "o", 600.0, 0.0), (2, "g3", "A", "x", "o", 1200.0, 0.0), (3, "g4", "B", None, "o", 0.0, 0.0)]
    got = {r.key: r for r in graph.merge_groups(spark.createDataFrame(data, "station_row long, group string, name string, line string, operator string, x double, y double"), 600).collect()}
    assert set(got) == {"g1|g2|g3", "g4"} and got["g1|g2|g3"].x == 600 and [x.line for x in got["g1|g2|g3"].lines] == ["x", "丸ノ内線"] and got["g4"].lines == []


def test_allocation_conserves(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 7), (0, 1, 2.0, 8), (1, 0, 3.0, 7), (1, 1, None, None)], "row long, col long, dist double, owner long")
    zone = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.5, 30.0)], "zone_id long, west double, south double, east double, north double, people double")
    got = {r.owner: (r.area_m2, r.people) for r in territory.allocate(zone, cells, 0.0, 0.0, 1.0, ["people"]).collect()}
    assert got == {7: (1.5, 15.0), 8: (1.0, 10.0), None: (0.5, 5.0)}


def test_clipped_area(spark):
    df = spark.createDataFrame([([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0], 1.0), ([0.0, 2.0, 0.0], [0.0, 0.0, 2.0], 2.0), ([9.0, 10.0, 9.0], [9.0, 9.0, 10.0], 0.0)], "xs array<double>, ys array<double>, want double")
    got = df.select(territory.clipped_area(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("a"), "want").collect()
    assert [r.a for r in got] == [1.0, 1.0, 0.0]


def test_tfidf_on_a_subset(spark):
    counts = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "b", 1), (1, "c", 1)], "region_id long, term string, n long")
    got = {(r.region_id, r.term): r.weight for r in vectors.tfidf(counts).collect()}
    a, b = 2 * (np.log(3 / 2) + 1), 1.0
    assert abs(got[0, "a"] - a / np.hypot(a, b)) < 1e-12
    fitted = {(r.region_id, r.term): r.weight for r in vectors.tfidf(counts, F.col("region_id") == 0).collect()}
    assert abs(fitted[1, "c"] / fitted[1, "b"] - (np.log(2) + 1)) < 1e-12


def test_singular_vectors(spark):
    x = np.random.default_rng(5).normal(size=(40, 5))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")))
    v, s = vectors.singular_vectors(df, list("abcde"), 2)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:2])
    got = np.array([r.embedding for r in vectors.project(df, list("abcde"), v, ["a"]).collect()])
    assert np.allclose(np.linalg.norm(got, axis=1), 1)


def plain_ward(x, k):
    """Merging the pair whose union raises the sum of squares least, by brute force."""
    groups = [[i] for i in range(len(x))]

    def rise(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: rise(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_ward_matches_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(45, 3))
    for k, labels in vectors.ward(x, [1, 2, 5, 9, 45]).items():
        assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == plain_ward(x, k)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(45)))
    got = {r.id: (r.ward_2, r.ward_5) for r in vectors.ward_labels(df, list("abc"), [2, 5], "id").collect()}
    assert {frozenset(i for i in got if got[i][1] == c) for c in range(5)} == plain_ward(x, 5)
    with pytest.raises(ValueError):
        vectors.ward_labels(df, list("abc"), [2], "id", most=44)


def test_neighbours_and_silhouettes_do_not_depend_on_tiles(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(70, 4))
    x[10] = x[11]
    x[20] = 0
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)] + [(99, None, 0)], "vec_id long, embedding array<double>, label int")
    for metric in ("cosine", "euclidean"):
        got = [sorted((a.query, a["rank"], a.id) for a in vectors.top_neighbours(df, 3, df.where("vec_id % 5 = 0"), metric=metric, tile=t).collect()) for t in (7, 1000)]
        assert got[0] == got[1] and len(got[0]) >= 39
    known = df.where("embedding IS NOT NULL")
    a, b = ({s.vec_id: s.silhouette for s in vectors.silhouettes(known, "label", tile=t).collect()} for t in (9, 1000))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_shared_items_and_names_are_split(spark):
    r = random.Random(3)
    rows = {(r.randrange(40), r.choice(["hot", f"i{r.randrange(30)}"])) for _ in range(500)}
    df = spark.createDataFrame([*rows, (None, "hot"), (1, None)], "r long, i string")
    got = {(x.a, x.b): (x.shared, x.jaccard) for x in vectors.shared_items(df, "r", "i", each=5).collect()}
    items = {a: {i for b, i in rows if b == a} for a, _ in rows}
    want = {(a, b): (len(items[a] & items[b]), len(items[a] & items[b]) / len(items[a] | items[b])) for a in items for b in items if a < b and items[a] & items[b]}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    view = spark.createDataFrame([(f"s{i}", "same" if i % 3 else f"n{i}", float(i), 0.0) for i in range(30)], "source_id string, name_normalized string, x double, y double")
    assert matching.exact_name_distances(view, view, each=4).count() == 20 * 20 + 10


def test_nearest_of_all_ends_with_null_coordinates(spark):
    schema = "id long, x double, y double"
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 5.0), (3, float("nan"), 0.0), (4, 9000.0, 9000.0)], schema)
    points = spark.createDataFrame([(10, 1.0, 0.0), (11, 2.0, None), (12, 300.0, 0.0)], schema)
    got = sorted((r.query_id, r.point_id) for r in spatial.all_within_or_nearest(queries, points, 5.0).collect())
    assert got == [(1, 10), (4, 12)]
    assert spatial.all_within_or_nearest(queries, points.limit(0), 5.0).collect() == []


def test_independent_subset(spark):
    r = random.Random(9)
    data = [(i, r.uniform(0, 6000), r.uniform(0, 6000)) for i in range(80)]
    want = []
    for i, x, y in data:
        if all(abs(x - u) >= 1000 or abs(y - v) >= 1000 for _, u, v in want):
            want.append((i, x, y))
    got = vectors.independent_subset(spark.createDataFrame(data, "region_id long, x double, y double"))
    assert rows(got, "region_id") == sorted([(w[0],) for w in want], key=str)


def test_ward_and_alignment(spark):
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (12, 2)) for c in (0, 5, 9)])
    labels = vectors.ward(x, [3])[3]
    assert [len(set(labels[i : i + 12])) for i in (0, 12, 24)] == [1, 1, 1] and len(set(labels)) == 3
    df = spark.createDataFrame([(1, 2)] * 5 + [(2, 3)] * 4 + [(3, 1)] * 3 + [(1, 1)], "a long, b long")
    assert vectors.best_alignment(df, "a", "b") == {2: 1, 3: 2, 1: 3}


def test_rings_are_assembled_in_any_direction(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    cases = [
        ([ring[:3], ring[2:]], [ring]), ([ring[:3], ring[2:][::-1]], [ring]), ([ring, [(9.0, 9.0), (10.0, 9.0)], [(9.0, 9.0), (9.0, 10.0), (10.0, 9.0)]], [ring, [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0), (9.0, 9.0)]]),
        ([ring[:3]], None), ([ring, ring[:2]], None), ([], []), ([ring[:2], ring[3:], ring[1:4]], [ring]),
    ]
    df = spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in line] for line in lines]) for i, (lines, _) in enumerate(cases)], "i int, lines array<array<struct<x:double,y:double>>>")
    got = {r.i: r.r and [[tuple(p) for p in ring] for ring in r.r] for r in df.select("i", shapes.assemble_rings(F.col("lines")).alias("r")).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i] is None) == (want is None)
        assert want is None or [(len(r), set(r), r[0] == r[-1]) for r in got[i] or []] == [(len(r), set(r), True) for r in want]


def test_polygon_edges_belong_to_it(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in [(0, 0), (20, 0), (20, 10), (0, 10), (0, 0)]]
    areas = spark.createDataFrame([(1, ring)], "area_id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 20.0, 10.0), (2, 20.0, 5.0), (3, 10.0, 5.0), (4, 0.0, 0.0), (5, 20.1, 5.0), (6, 10.0, 10.0)], "id long, x double, y double")
    cells = regions.polygon_grid(areas, 10)
    assert sorted((r.cell_id, r.area_m2, r.partial_cell) for r in cells.collect()) == [("10:0:0", 100.0, False), ("10:1:0", 100.0, False)]
    got = {r.point: r.cell_id for r in regions.assign_to_polygons(points, areas, cells, 10).collect()}
    assert got == {1: "10:1:0", 2: "10:1:0", 3: "10:1:0", 4: "10:0:0", 6: "10:0:0"}


def test_arrays_and_redaction(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5, 7), (1, 1, None, None), (0, 1, 2.5, 8), (9, 9, 1.0, 1)], "row long, col long, dist double, owner long")
    dist, owner = territory.to_arrays(cells, 2, 2)
    assert owner.tolist() == [[7, 8], [-1, -1]] and dist[0].tolist() == [1.5, 2.5] and np.isnan(dist[1]).all()
    territory.write_arrays(str(tmp_path / "a.npz"), owner=owner)
    assert np.load(tmp_path / "a.npz")["owner"].tolist() == owner.tolist()
    with pytest.raises(FileExistsError):
        territory.write_arrays(str(tmp_path / "a.npz"), owner=owner)
    assert quality.redacted("at http://x/?k=a%2Fb&t=a/b%20 abc", ["a/b", "", "abc"]) == "at http://x/?k=[redacted]&t=[redacted]%20 [redacted]"
