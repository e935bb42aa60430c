"""Queries over whole analyses: three providers, widths of areas, clusters, polygons, checks of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions import crs, shapes
from loxodrome.functions import text as X
from loxodrome.operators import categories, chains, graph, matching, records, regions
from loxodrome.operators.spatial import in_ring, points_in_polygons
from loxodrome.plans.inputs import SQL, lonlat, pois, stations, table
from loxodrome.plans.registry import Registry, rounded
from loxodrome.sources import readers

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# --- three providers


_PROVIDERS = ("alpha", "beta", "gamma")


def providers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers, suppliers moved a little, and suppliers moved the other way, with names and phones by key."""
    k = F.col("id")
    base = {"alpha": pois(spark, sf_dir).select("id", "x", "y"), "beta": stations(spark, sf_dir).select("id", F.col("x") + 5, F.col("y") - 3).toDF("id", "x", "y"), "gamma": stations(spark, sf_dir).select("id", F.col("x") - 4, F.col("y") + 2).toDF("id", "x", "y")}
    name = F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("Shop N"), (k % 12).cast("string")))
    phone = F.when(k % 4 == 0, F.array()).otherwise(F.array(F.concat(F.lit("+81 3-1234-567"), (k % 3).cast("string"))))
    return {s: matching.comparison_view(s, rows, source_id=k, name=name, x=F.col("x"), y=F.col("y"), phones=phone, ascii_only=True) for s, rows in base.items()}


_MATCHED = f"""WITH {SQL}, n AS (SELECT source, CAST(id AS VARCHAR) AS source_id, x, y, CASE WHEN id % 9 = 0 THEN '' ELSE 'shop n' || (id % 12) END AS nn, CASE WHEN id % 4 <> 0 THEN id % 3 END AS phone
  FROM (SELECT 'alpha' AS source, id, x, y FROM poi UNION ALL SELECT 'beta', id, x + 5, y - 3 FROM station UNION ALL SELECT 'gamma', id, x - 4, y + 2 FROM station)),
c AS (SELECT a.source || '-' || b.source AS providers, a.source_id AS left_id, b.source_id AS right_id, a.nn AS ln, b.nn AS rn, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, a.nn <> '' AND a.nn = b.nn AS exact,
  CASE WHEN a.phone IS NULL OR b.phone IS NULL THEN 'unavailable' WHEN a.phone = b.phone THEN 'supporting' ELSE 'conflicting' END AS phone FROM n a JOIN n b ON a.source < b.source AND abs(a.x-b.x) <= 100 AND abs(a.y-b.y) <= 100 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 100),
r AS (SELECT unnest([30.0, 50.0, 100.0]::DOUBLE[]) AS radius), k AS (SELECT r.radius, c.* FROM r JOIN c ON d <= radius),
w AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY radius, providers, left_id) AS le, count(*) FILTER (exact) OVER (PARTITION BY radius, providers, right_id) AS re FROM k),
m AS (SELECT *, CASE WHEN exact AND d <= 30 AND le <= 1 AND re <= 1 AND phone <> 'conflicting' THEN 'high_confidence' WHEN exact OR phone = 'supporting' THEN 'ambiguous' ELSE 'unmatched' END AS status FROM w)"""
_COUNTS = "count(*) AS candidates, count(*) FILTER (status = 'high_confidence') AS high_confidence, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched"


def compared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return chains.compare_providers(providers(spark, sf_dir), similarity=False)


@query(f"{_MATCHED} SELECT providers, {_COUNTS} FROM m WHERE radius = 100 GROUP BY providers")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)["summary"]


@query(f"{_MATCHED} SELECT providers, radius, {_COUNTS} FROM m GROUP BY providers, radius")
def provider_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)["radii"]


@query(f"{_MATCHED}, h AS (SELECT * FROM m WHERE radius = 100 AND status = 'high_confidence') SELECT x.left_id AS a, x.right_id AS b, y.right_id AS c FROM h x JOIN h y ON x.providers = 'alpha-beta' AND y.providers = 'alpha-gamma' AND x.left_id = y.left_id JOIN h z ON z.providers = 'beta-gamma' AND z.left_id = x.right_id AND z.right_id = y.right_id")
def provider_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)["triples"]


@query(f"{_MATCHED}, s AS (SELECT a AS p, unnest(string_split(a, '-')) AS source FROM (SELECT unnest(['alpha-beta', 'alpha-gamma', 'beta-gamma']) AS a)), l AS (SELECT providers AS p, string_split(providers, '-')[1] AS source, left_id AS source_id, status FROM m WHERE radius = 100 UNION ALL SELECT providers, string_split(providers, '-')[2], right_id, status FROM m WHERE radius = 100),\n"
       "g AS (SELECT p, source, source_id, bool_or(status = 'high_confidence') AS high, bool_or(status = 'ambiguous') AS amb FROM l GROUP BY ALL) SELECT p AS providers, source, CASE WHEN high IS NULL THEN 'no_spatial_candidate' WHEN amb THEN 'ambiguous_candidate_exists' WHEN nn = '' THEN 'insufficient_evidence' ELSE 'spatial_candidate_but_no_name_evidence' END AS reason, count(*) AS n FROM s JOIN n USING (source) LEFT JOIN g USING (p, source, source_id) WHERE NOT coalesce(high, false) GROUP BY ALL")  # fmt: skip
def provider_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)["unmatched"].groupBy("providers", "source", "reason").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT s_suppkey AS id, s_suppkey % 3 AS a, s_suppkey % 5 AS b FROM supplier) SELECT id, CASE WHEN a = 0 OR b = 0 THEN 'unavailable' WHEN a = b THEN 'not_comparable' ELSE 'conflicting' END AS evidence FROM p")
def address_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")

    def parts(n: int):  # noqa: ANN202
        return F.when(k % n == 0, F.array()).otherwise(F.array(F.create_map(F.lit("postcode"), F.concat(F.lit("180-000"), (k % n).cast("string")))))

    return table(spark, sf_dir, "supplier").select(k.alias("id"), X.address_evidence(parts(3), parts(5)).alias("evidence"))


# --- widths of areas


def _widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per half width and region: log density, and peak over mean density with all cells and with full ones only."""
    wide = regions.width_profiles(pois(spark, sf_dir), stations(spark, sf_dir), (500, 600, 700, 800)).where("poi_count > 0")
    return wide.join(stations(spark, sf_dir).select(F.col("id").alias("region_id"), "x", "y"), "region_id")


def _features(rows: DataFrame, name: str, peak: str) -> DataFrame:
    made = rows.select(F.concat(F.lit(name), F.col("half").cast("int").cast("string")).alias("name"), "region_id", "x", "y", F.log1p("density").alias("dense"), F.log1p(F.col(peak) / F.col("density")).alias("peaked"))
    return chains.robust_scaled(made, "name", ["dense", "peaked"])


_WIDTHS = f"""WITH {SQL}, h AS (SELECT unnest([500.0, 600.0, 700.0, 800.0]::DOUBLE[]) AS half), m AS (SELECT s.id AS sid, half, ceil(2 * half / 250) AS w, p.x - s.x + half AS u, p.y - s.y + half AS v FROM poi p JOIN station s ON abs(p.x-s.x) <= 800 AND abs(p.y-s.y) <= 800, h WHERE abs(p.x-s.x) <= half AND abs(p.y-s.y) <= half),
c AS (SELECT sid, half, least(floor(u / 250), w - 1) AS ix, least(floor(v / 250), w - 1) AS iy, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT *, least(250, 2 * half - ix * 250) * least(250, 2 * half - iy * 250) AS area FROM c),
k AS (SELECT sid, half, sum(n) / (4 * half * half / 1e6) AS density, max(n / (area / 1e6)) AS peak, coalesce(max(CASE WHEN area >= 62499 THEN n / (area / 1e6) END), 0) AS full_peak FROM a GROUP BY sid, half),
v AS (SELECT 'all' || CAST(half AS INT) AS name, sid, ln(1 + density) AS dense, ln(1 + peak / density) AS peaked FROM k UNION ALL SELECT 'full' || CAST(half AS INT), sid, ln(1 + density), ln(1 + full_peak / density) FROM k),
q AS (SELECT name, quantile_cont(dense, [0.25, 0.5, 0.75]) AS d, quantile_cont(peaked, [0.25, 0.5, 0.75]) AS p FROM v GROUP BY name), z AS (SELECT v.name, sid, s.x, s.y, (dense - d[2]) / (d[3] - d[1]) AS dense, (peaked - p[2]) / (p[3] - p[1]) AS peaked FROM v JOIN q USING (name) JOIN station s ON s.id = sid),
e AS (SELECT a.name, a.sid AS region_id, b.sid AS other, round(sqrt(pow(a.dense - b.dense, 2) + pow(a.peaked - b.peaked, 2)), 9) AS d FROM z a JOIN z b ON a.name = b.name AND a.sid <> b.sid AND (abs(a.x - b.x) >= 1600 OR abs(a.y - b.y) >= 1600))"""


def _compared_sql(pairs: list[tuple[str, str]]) -> str:
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""{_WIDTHS}, t AS (SELECT * FROM (VALUES {listed}) x(name, reference)), j AS (SELECT t.name, t.reference, a.region_id, a.other, a.d AS d, b.d AS e FROM t JOIN e a ON a.name = t.name JOIN e b ON b.name = t.reference AND b.region_id = a.region_id AND b.other = a.other),
    n AS (SELECT *, row_number() OVER (w ORDER BY d, other) AS i, row_number() OVER (w ORDER BY e, other) AS k, rank() OVER (w ORDER BY d) + (count(*) OVER (PARTITION BY name, reference, region_id, d) - 1) / 2.0 AS r, rank() OVER (w ORDER BY e) + (count(*) OVER (PARTITION BY name, reference, region_id, e) - 1) / 2.0 AS s FROM j WINDOW w AS (PARTITION BY name, reference, region_id)),
    f AS (SELECT name, reference, region_id, count(*) FILTER (i <= 10 AND k <= 10) AS common_top, CASE WHEN count(DISTINCT r) > 1 AND count(DISTINCT s) > 1 THEN corr(r, s) END AS spearman FROM n GROUP BY name, reference, region_id)"""


_WIDTH_PAIRS = [(f"all{h}", "all500") for h in (500, 600, 700, 800)]
_FULL_PAIRS = list(dict.fromkeys((f"full{h}", r) for h in (500, 600, 700, 800) for r in ("all500", f"all{h}")))


@query(f"{_compared_sql(_WIDTH_PAIRS)} SELECT name, reference, region_id, common_top, round(spearman, 6) AS spearman FROM f")
def aoi_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each station's neighbours change with the half width of its area."""
    return rounded(chains.compare_neighbours(_features(_widths(spark, sf_dir), "all", "peak_density"), _WIDTH_PAIRS, ["dense", "peaked"], 1600.0))


@query(f"{_compared_sql(_FULL_PAIRS)} SELECT name, reference, count(*) AS regions, round(avg(common_top), 6) AS common_top_mean, median(common_top) AS common_top_median, round(avg(spearman), 6) AS spearman_mean, round(median(spearman), 6) AS spearman_median FROM f GROUP BY name, reference")
def aoi_full_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with peaks of full cells only, against the first width and against all cells of the same width."""
    rows = _widths(spark, sf_dir)
    frames = _features(rows, "all", "peak_density").unionByName(_features(rows, "full", "full_cell_peak"))
    return rounded(chains.summarise_stability(chains.compare_neighbours(frames, _FULL_PAIRS, ["dense", "peaked"], 1600.0)))


# --- clusters


_PARTS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"d{i}" for i in range(64)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query(f"""WITH {_PARTS}, c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), d AS (SELECT e.label, vec_id, round(sqrt(sum(pow(v - m, 2))), 9) AS d FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY e.label, vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM d) SELECT label, n, 'near' AS role, CAST(place AS INT) AS place, vec_id AS key, round(d, 6) AS distance FROM r WHERE place <= 3 UNION ALL SELECT label, n, 'far', CAST(place AS INT), vec_id, round(d, 6) FROM r WHERE place = n""")
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _vectors(spark, sf_dir)
    return rounded(chains.describe_clusters(rows, "label", names, "vec_id"))


@query(f"""WITH {_PARTS}, w AS (SELECT i, avg(v) AS m FROM e GROUP BY i), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), r AS (SELECT label, c.i, c.m - w.m AS difference, row_number() OVER (PARTITION BY label ORDER BY round(abs(c.m - w.m), 12) DESC, c.i) AS place FROM c JOIN w ON w.i = c.i)
SELECT label, 'd' || (i - 1) AS feature, round(difference, 6) AS difference, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
def cluster_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _vectors(spark, sf_dir)
    return rounded(chains.contrast_features(rows, "label", names))


# --- polygons


def _bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of two boxes around each station: all of the lower half, and the left of the upper."""
    corners = [(-400, -300), (400, -300), (400, 0), (0, 0), (0, 300), (-400, 300), (-400, -300)]
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corners])
    return stations(spark, sf_dir).select(F.col("id").alias("area_id"), ring.alias("ring"))


_BENDS = f"""WITH {SQL}, b AS (SELECT id AS area_id, x - 400 AS w, y - 300 AS s, x + 400 AS e, y AS n FROM station UNION ALL SELECT id, x - 400, y, x, y + 300 FROM station), g AS (SELECT ix, iy, ix * 250 AS cw, iy * 250 AS cs FROM range(-11, 11) a(ix), range(-11, 11) c(iy)),
cell AS (SELECT area_id, ix, iy, sum(greatest(least(e, cw + 250) - greatest(w, cw), 0) * greatest(least(n, cs + 250) - greatest(s, cs), 0)) AS area FROM b JOIN g ON cw < e AND cw + 250 > w AND cs < n AND cs + 250 > s GROUP BY ALL)"""


@query(f"{_BENDS} SELECT area_id, '250:' || ix || ':' || iy AS cell_id, round(area, 6) AS area_m2, area < 62500 - 1e-6 AS partial_cell FROM cell WHERE area > 0")
def polygon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.polygon_grid(_bends(spark, sf_dir), 250).select("area_id", "cell_id", "area_m2", "partial_cell"))


@query(f"""{_BENDS}, i AS (SELECT DISTINCT area_id, p.id, p.x, p.y FROM b JOIN poi p ON p.x BETWEEN w AND e AND p.y BETWEEN s AND n), t AS (SELECT i.area_id, i.id, ix, iy, row_number() OVER (PARTITION BY i.area_id, i.id ORDER BY NOT (ix = floor(x / 250) AND iy = floor(y / 250)), iy, ix) AS k
FROM i JOIN cell c ON c.area_id = i.area_id AND area > 0 AND x BETWEEN ix * 250 AND ix * 250 + 250 AND y BETWEEN iy * 250 AND iy * 250 + 250) SELECT area_id, '250:' || ix || ':' || iy AS cell_id, count(*) AS n FROM t WHERE k = 1 GROUP BY ALL""")
def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.count_in_polygons(pois(spark, sf_dir), _bends(spark, sf_dir), 250)


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box with a hole around each station, from nodes, ways in both directions and relations; every fifth lacks a side."""
    k = F.col("id")
    base = stations(spark, sf_dir)
    outer, inner = [(-200, -100), (200, -100), (200, 100), (-200, 100)], [(-20, -10), (20, -10), (20, 10), (-20, 10)]
    nodes = base.select(F.explode(F.array(*[F.struct((k * 10 + i).alias("id"), (F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat")) for i, (dx, dy) in enumerate([*outer, *inner])])).alias("n")).select("n.*")
    at = [k * 10 + i for i in range(8)]
    lines = [(0, [at[0], at[1], at[2]]), (1, [at[0], at[3], at[2]]), (2, [at[4], at[5], at[6], at[7], at[4]])]
    ways = base.select(k.alias("rel"), F.explode(F.array(*[F.struct((k * 10 + i).alias("id"), F.array(*refs).alias("refs")) for i, refs in lines])).alias("w")).where("NOT (rel % 5 = 0 AND w.id % 10 = 1)").select("w.*")
    refs = F.when(k % 5 == 0, F.array(k * 10, k * 10 + 2)).otherwise(F.array(k * 10, k * 10 + 1, k * 10 + 2))
    roles = F.when(k % 5 == 0, F.array(F.lit("outer"), F.lit("inner"))).otherwise(F.array(F.lit("outer"), F.lit("outer"), F.lit("inner")))
    relations = base.select("id", refs.alias("refs"), roles.alias("ref_roles"), F.transform(refs, lambda _: F.lit("way")).alias("ref_types"))
    return readers.relation_polygons(readers.relation_ways(relations, readers.way_points(ways, nodes)))


@query(f"WITH {SQL} SELECT id, CASE WHEN id % 5 <> 0 THEN 1 END AS outers, CASE WHEN id % 5 <> 0 THEN 1 END AS inners, CASE WHEN id % 5 <> 0 THEN CAST(80000 - 800 AS DOUBLE) END AS area_m2 FROM station")
def relation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _relations(spark, sf_dir)
    return rounded(found.select("id", F.size("outer").alias("outers"), F.size("inner").alias("inners"), shapes.rings_area(F.col("outer"), F.col("inner")).alias("area_m2")))


@query(f"WITH {SQL} SELECT s.id, count(*) AS n FROM station s JOIN poi p ON s.id % 5 <> 0 AND p.x >= s.x - 200 AND p.x < s.x + 200 AND p.y >= s.y - 100 AND p.y < s.y + 100 AND NOT (p.x >= s.x - 20 AND p.x < s.x + 20 AND p.y >= s.y - 10 AND p.y < s.y + 10) GROUP BY s.id")
def relation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _relations(spark, sf_dir).where("outer IS NOT NULL")
    box = found.select("id", "inner", F.explode("outer").alias("ring")).withColumnRenamed("id", "polygon_id")
    hit = points_in_polygons(pois(spark, sf_dir).select("id", "x", "y"), box, 400)
    return hit.where(~F.exists("inner", lambda r: in_ring(F.col("x"), F.col("y"), r))).groupBy(F.col("polygon_id").alias("id")).agg(F.count("*").alias("n"))


# --- roads and checks


@query(f"WITH {SQL}, e AS (SELECT a.id AS u, b.id AS v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM station a JOIN station b ON b.id = a.id + 1) SELECT u, v, round(sqrt(pow(ax-bx, 2)+pow(ay-bz, 2)), 6) AS length_m FROM e WHERE greatest(ax, bx) >= -700 AND least(ax, bx) <= 700 AND greatest(ay, bz) >= -700 AND least(ay, bz) <= 700 AND (ax <> bx OR ay <> bz)")
def local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = stations(spark, sf_dir).select(F.col("id").alias("node_id"), "x", "y")
    known = nodes.select((F.col("node_id") - 1).alias("u"), F.col("node_id").alias("v")).union(nodes.select(F.col("node_id") + 1, "node_id"))
    return rounded(graph.local_edges(nodes, known, 0.0, 0.0, 700.0).select("u", "v", "length_m"))


@query("""WITH p AS (SELECT o_orderkey AS id, CAST(o_orderkey % 150 AS DOUBLE) AS off, CAST(o_orderkey % 40 AS DOUBLE) AS pos, 40.0::DOUBLE AS l, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 300 AS DOUBLE) END AS du, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 3 % 300 AS DOUBLE) END AS dv, o_orderkey % 13 = 0 AS same, CAST(o_orderkey % 30 AS DOUBLE) AS so, CAST(o_orderkey % 37 AS DOUBLE) AS sp FROM orders),
b AS (SELECT *, least(coalesce(du, 'inf'::DOUBLE) + pos, coalesce(dv, 'inf'::DOUBLE) + l - pos, CASE WHEN same THEN so + abs(pos - sp) ELSE 'inf'::DOUBLE END) AS best FROM p) SELECT id, CASE WHEN off > 100 THEN 'connector_over_limit' WHEN isinf(best) THEN 'disconnected' ELSE 'connected' END AS status, CASE WHEN off <= 100 AND NOT isinf(best) THEN best + off END AS distance_m FROM b""")
def snapped_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")

    def part(n: int, factor: int = 1):  # noqa: ANN202
        return (k * factor % n).cast("double")

    du, dv = F.when(k % 11 != 0, part(300)), F.when(k % 7 != 0, part(300, 3))
    found = graph.network_distance(part(150), part(40), F.lit(40.0), du, dv, k % 13 == 0, part(30), part(37))
    return table(spark, sf_dir, "orders").select(k.alias("id"), found.alias("d")).select("id", "d.status", "d.distance_m")


@query("SELECT o_custkey AS key FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def lost_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return categories.lost_keys(rows, rows.where("o_orderkey % 3 = 0"), ["o_custkey"]).select(F.col("o_custkey").alias("key"))


@query("""WITH r AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(s_suppkey + 1 AS VARCHAR) AS b1, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey - 1 AS VARCHAR) END AS b2 FROM supplier), l AS (SELECT k AS a, b1 AS b FROM r UNION ALL SELECT k, b2 FROM r WHERE b2 IS NOT NULL)
SELECT 'missing' AS direction, a AS from_key, b AS to_key FROM l WHERE b NOT IN (SELECT k FROM r) UNION ALL SELECT 'one_way', a, b FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.a = l.b AND x.b = l.a)""")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("key"), F.concat_ws(";", (k + 1).cast("string"), F.when(k % 4 != 0, (k - 1).cast("string"))).alias("targets"))
    return categories.check_references(rows, "key", "targets")


@query("SELECT c_custkey AS key, c_acctbal AS balance, upper(c_mktsegment) AS segment FROM customer")
def merged_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    return records.one_to_one(rows.select("key", F.col("c_acctbal").alias("balance")), rows.select("key", F.upper("c_mktsegment").alias("segment")), "key")


_TRIPS = [("north100", 0.0, 100.0), ("east500", 90.0, 500.0), ("northeast500", 45.0, 500.0), ("south1000", 180.0, 1000.0)]


@query(f"""WITH {SQL}, t AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {d})" for n, _, d in _TRIPS)}) x(point, m)) SELECT id, point, crs, round(CAST(m AS DOUBLE), 4) AS geodesic_m, crs = 'plane' AS close FROM poi, t, (SELECT unnest(['plane', 'mercator']) AS crs)""")
def distance_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to points at known distances, by the ellipsoid, in the plane of the zone (right to a part in 5,000) and in web Mercator (which isn't)."""
    found = chains.distance_errors(lonlat(pois(spark, sf_dir)), _TRIPS, {"plane": crs.JAPAN_9.forward, "mercator": crs.web_mercator})
    return found.select("id", "point", "crs", F.round("geodesic_m", 4).alias("geodesic_m"), (F.abs("error_pct") < 0.02).alias("close"))
