"""Queries over grids, regions, spatial joins and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions.grid import cell_index
from loxodrome.operators import regions, spatial, stats
from loxodrome.operators.similarity import rank_regions, robust_transform
from loxodrome.plans.inputs import GROUPS, SQL, pois, stations
from loxodrome.plans.registry import Registry, rounded

LOW, HIGH = (-2000.0, -2000.0), (2000.0, 2000.0)
query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(f"WITH {SQL} SELECT p.id AS left_id, s.id AS right_id, round(sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)), 6) AS distance_m FROM poi p JOIN station s ON abs(p.x-s.x) <= 300 AND (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y) <= 90000")
def point_dwithin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_distance(pois(spark, sf_dir).select("id", "x", "y"), stations(spark, sf_dir).select("id", "x", "y"), 300, places=6).select("left_id", "right_id", "distance_m")


@query(f"""WITH {SQL}, d AS (SELECT s.id AS query_id, p.id AS point_id, sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS d FROM station s JOIN poi p ON abs(p.x-s.x) <= 300 AND abs(p.y-s.y) <= 300),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) AS rank FROM d WHERE d <= 300) SELECT query_id, point_id, round(d, 6) AS distance_m, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest(stations(spark, sf_dir).select("id", "x", "y"), pois(spark, sf_dir).select("id", "x", "y"), 8, 300).select("query_id", "point_id", "distance_m", "rank"))


@query(f"""WITH {SQL}, d AS (SELECT s.id, p.id AS point_id, p.balance, sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS d FROM station s JOIN poi p ON abs(p.x-s.x) <= 100 AND abs(p.y-s.y) <= 100),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, point_id) AS rank FROM d WHERE d <= 100), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY balance + d, rank) AS best FROM r WHERE rank <= 8)
SELECT station.id, round(balance + d, 6) AS total, point_id AS nearest_id FROM station LEFT JOIN b ON b.id = station.id AND best = 1""")
def knn_min_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.least_total(stations(spark, sf_dir).select("id", "x", "y"), pois(spark, sf_dir).select("id", "x", "y", "balance"), 8, 100, "balance").select("id", "total", "nearest_id"))


@query(f"""WITH {SQL}, d AS (SELECT s.id AS query_id, p.id AS point_id, sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS d FROM station s, poi p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) AS n FROM d)
SELECT query_id, point_id, round(d, 6) AS distance_m FROM r WHERE d <= 20 OR (n = 1 AND d > 20)""")
def within_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.all_within_or_nearest(stations(spark, sf_dir).select("id", "x", "y"), pois(spark, sf_dir).select("id", "x", "y"), 20).select("query_id", "point_id", "distance_m"))


@query(f"WITH {SQL} SELECT p.id AS point_id, s.id AS square_id FROM poi p JOIN station s ON abs(p.x-s.x) <= 500 AND abs(p.y-s.y) <= 500")
def square_covers_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.covered_by_squares(pois(spark, sf_dir).select("id", "x", "y"), stations(spark, sf_dir).select("id", "x", "y"), 500).select("point_id", "square_id")


@query(f"WITH {SQL} SELECT a.id AS region_a, b.id AS region_b, (1000-abs(a.x-b.x))*(1000-abs(a.y-b.y)) AS overlap_m2 FROM station a JOIN station b ON a.id < b.id AND abs(a.x-b.x) < 1000 AND abs(a.y-b.y) < 1000")
def square_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlapping_squares(stations(spark, sf_dir), 1000)


_EDGE = "edge AS (SELECT id AS edge_id, x AS x1, y AS y1, x + CAST(id % 7 * 40 AS DOUBLE) AS x2, y + CAST(id % 5 * 30 AS DOUBLE) AS y2 FROM station)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return stations(spark, sf_dir).select(k.alias("edge_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + (k % 7 * 40).cast("double")).alias("x2"), (F.col("y") + (k % 5 * 30).cast("double")).alias("y2"))


@query(f"""WITH {SQL}, {_EDGE}, t AS (SELECT p.id, p.x, p.y, e.*, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS l2, (p.x-x1)*(x2-x1)+(p.y-y1)*(y2-y1) AS dot FROM poi p JOIN edge e ON p.x BETWEEN x1 - 100 AND x2 + 100 AND p.y BETWEEN y1 - 100 AND y2 + 100),
u AS (SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE least(greatest(dot / l2, 0), 1) END AS f FROM t), d AS (SELECT *, sqrt(pow(x-x1-f*(x2-x1), 2)+pow(y-y1-f*(y2-y1), 2)) AS o FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(o, 6), edge_id) AS n FROM d WHERE o <= 100)
SELECT id, round(o, 5) AS offset_m FROM r WHERE n = 1""")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest_segment(pois(spark, sf_dir).select("id", "x", "y"), edges(spark, sf_dir), 100).select("id", "offset_m"), 5)


@query(f"""WITH {SQL} SELECT p.id, s.id AS polygon_id FROM poi p JOIN station s ON p.x >= s.x - 150 AND p.x < s.x + 150 AND p.y >= s.y - 100 AND p.y < s.y + 100""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [(-150, -100), (150, -100), (150, 100), (-150, 100), (-150, -100)]
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corners])
    polygons = stations(spark, sf_dir).select(F.col("id").alias("polygon_id"), ring.alias("ring"))
    return spatial.points_in_polygons(pois(spark, sf_dir).select("id", "x", "y"), polygons, 300).select("id", "polygon_id")


_CELL = "least(CAST(floor({c} / {s}.0) AS BIGINT), CAST(2000 / {s} - 1 AS BIGINT))"


def _cells_sql(size: int) -> str:
    n = 2000 // size
    return f"""WITH {SQL}, c AS (SELECT {_CELL.format(c='x', s=size)} AS ix, {_CELL.format(c='y', s=size)} AS iy, count(*) AS n FROM poi GROUP BY ALL),
    g AS (SELECT CAST(a AS BIGINT) AS ix, CAST(b AS BIGINT) AS iy FROM range(-{n}, {n}) t(a), range(-{n}, {n}) u(b))
    SELECT '{size}:' || g.ix || ':' || g.iy AS cell_id, CAST(coalesce(n, 0) AS BIGINT) AS poi_count, round(coalesce(n, 0) / {size * size / 1e6}, 6) AS density_per_km2 FROM g LEFT JOIN c USING (ix, iy)"""


def _counted(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    cells = regions.grid(spark, LOW, HIGH, size)
    return regions.count_cells(regions.assign(pois(spark, sf_dir), LOW, HIGH, size), cells)


@query(_cells_sql(250))
def grid_counts_250(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_counted(spark, sf_dir, 250).select("cell_id", "poi_count", "density_per_km2"))


@query(_cells_sql(500))
def grid_counts_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_counted(spark, sf_dir, 500).select("cell_id", "poi_count", "density_per_km2"))


@query(f"""WITH {SQL}, c AS (SELECT {_CELL.format(c='x', s=500)} AS ix, {_CELL.format(c='y', s=500)} AS iy, count(*) AS n FROM poi GROUP BY ALL),
g AS (SELECT CAST(a AS BIGINT) AS ix, CAST(b AS BIGINT) AS iy FROM range(-4, 4) t(a), range(-4, 4) u(b)) SELECT g.ix, g.iy, CAST(coalesce(n, 0) AS BIGINT) AS children_sum, CAST(coalesce(n, 0) AS BIGINT) AS parent_count FROM g LEFT JOIN c USING (ix, iy)""")
def grid_parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the four child cells beside the parent's own count: they must agree."""
    child = _counted(spark, sf_dir, 250).groupBy(F.floor(F.col("ix") / 2).alias("ix"), F.floor(F.col("iy") / 2).alias("iy")).agg(F.sum("poi_count").alias("children_sum"))
    return child.join(_counted(spark, sf_dir, 500).select("ix", "iy", F.col("poi_count").alias("parent_count")), ["ix", "iy"])


@query(f"""WITH {SQL}, p AS (SELECT {_CELL.format(c='x', s=500)} AS ix, {_CELL.format(c='y', s=500)} AS iy, category_group FROM poi), l AS (SELECT DISTINCT category_group FROM p UNION SELECT '__MISSING__'),
g AS (SELECT CAST(a AS BIGINT) AS ix, CAST(b AS BIGINT) AS iy FROM range(-4, 4) t(a), range(-4, 4) u(b)), n AS (SELECT ix, iy, category_group, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT ix, iy, count(*) AS d FROM p GROUP BY ALL)
SELECT '500:' || g.ix || ':' || g.iy AS cell_id, category_group, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(d, 0) AS BIGINT) AS denominator, round(coalesce(n, 0) / d, 6) AS share FROM g CROSS JOIN l LEFT JOIN n USING (ix, iy, category_group) LEFT JOIN d USING (ix, iy)""")
def dense_group_level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = regions.grid(spark, LOW, HIGH, 500)
    return rounded(regions.level_table(regions.assign(pois(spark, sf_dir), LOW, HIGH, 500), cells, "category_group"))


_PAIR = "m AS (SELECT s.id AS sid, p.x - s.x AS dx, p.y - s.y AS dy, p.category_group FROM poi p JOIN station s ON abs(p.x-s.x) <= 500 AND abs(p.y-s.y) <= 500)"
_PROFILE = f"""{_PAIR}, c AS (SELECT sid, least(CAST(floor((dx + 500) / 250) AS BIGINT), 3) AS ix, least(CAST(floor((dy + 500) / 250) AS BIGINT), 3) AS iy, count(*) AS n FROM m GROUP BY ALL),
peaks AS (SELECT sid, max(n) / 0.0625 AS peak FROM c GROUP BY sid), totals AS (SELECT sid, count(*) AS n, {', '.join(f"count(*) FILTER (category_group = '{g}') AS g{i}" for i, g in enumerate([*GROUPS, '__OTHER__', '__MISSING__']))} FROM m GROUP BY sid),
profile AS (SELECT s.id AS region_id, CAST(1.0 AS DOUBLE) AS area_km2, CAST(coalesce(n, 0) AS BIGINT) AS poi_count, CAST(coalesce(n, 0) AS DOUBLE) AS poi_density_per_km2, {', '.join(f'CAST(g{i} AS DOUBLE) / n AS {g}_share' for i, g in enumerate([*GROUPS, 'other', 'category_missing']))},
CAST(coalesce(peak, 0) AS DOUBLE) AS peak_density_250m, CAST(peak AS DOUBLE) / n AS peak_to_mean_density_250m FROM station s LEFT JOIN totals ON totals.sid = s.id LEFT JOIN peaks ON peaks.sid = s.id)"""
_SHARES = [f"{g}_share" for g in (*GROUPS, "other", "category_missing")]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_profiles(pois(spark, sf_dir), stations(spark, sf_dir), GROUPS)


@query(f"WITH {SQL}, {_PROFILE} SELECT region_id, area_km2, poi_count, poi_density_per_km2, {', '.join(f'round({s}, 6) AS {s}' for s in _SHARES)}, round(peak_density_250m, 6) AS peak_density_250m, round(peak_to_mean_density_250m, 6) AS peak_to_mean_density_250m FROM profile")
def region_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles(spark, sf_dir))


@query(f"""WITH {SQL}, h AS (SELECT unnest([500.0, 600.0, 700.0, 800.0]::DOUBLE[]) AS half), m AS (SELECT s.id AS sid, half, ceil(2 * half / 250) AS w, p.x - s.x + half AS u, p.y - s.y + half AS v FROM poi p JOIN station s ON abs(p.x-s.x) <= 800 AND abs(p.y-s.y) <= 800, h WHERE abs(p.x-s.x) <= half AND abs(p.y-s.y) <= half),
c AS (SELECT sid, half, least(floor(u / 250), w - 1) AS ix, least(floor(v / 250), w - 1) AS iy, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT *, least(250, 2 * half - ix * 250) * least(250, 2 * half - iy * 250) AS area FROM c),
k AS (SELECT sid, half, sum(n) AS n, max(n / (area / 1e6)) AS peak, max(CASE WHEN area >= 62499 THEN n / (area / 1e6) END) AS full_peak, count(*) FILTER (area < 62499) AS part FROM a GROUP BY ALL)
SELECT s.id AS region_id, h.half, CAST(coalesce(n, 0) AS BIGINT) AS poi_count, round(coalesce(n, 0) / (4 * h.half * h.half / 1e6), 6) AS density, round(coalesce(peak, 0), 6) AS peak_density, round(coalesce(full_peak, 0), 6) AS full_cell_peak, CAST(coalesce(part, 0) AS BIGINT) AS occupied_partial_cells FROM station s CROSS JOIN h LEFT JOIN k ON k.sid = s.id AND k.half = h.half""")
def aoi_half_width_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.width_profiles(pois(spark, sf_dir), stations(spark, sf_dir), (500, 600, 700, 800)))


SCHEMES = {"square250": (250, 250), "square500": (500, 500), "square1000": (1000, 1000), "wide": (1000, 250), "tall": (250, 1000)}
_NAMES = (*GROUPS, "other", "missing")


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (w, h) in SCHEMES.items():
        one = regions.partition(pois(spark, sf_dir), w, h, GROUPS).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _partition_sql() -> str:
    parts = []
    for name, (w, h) in SCHEMES.items():
        nx, ny = 4000 // w, 4000 // h
        counts = ", ".join(f"count(id) FILTER (category_group = '{g}') AS \"{n}_count\"" for g, n in zip((*GROUPS, "__OTHER__", "__MISSING__"), _NAMES, strict=True))
        parts.append(f"""SELECT '{name}' AS scheme, CAST(g.c AS BIGINT) AS cell_id, CAST(count(id) AS BIGINT) AS poi_count, count(id) / {w * h / 1e6} AS density_per_km2, {counts} FROM range(0, {nx * ny}) g(c) LEFT JOIN
        (SELECT *, least(floor((y + 2000) / {h}), {ny - 1}) * {nx} + least(floor((x + 2000) / {w}), {nx - 1}) AS c FROM poi) p ON p.c = g.c GROUP BY g.c""")
    return f"cell AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {SQL}, {_partition_sql()} SELECT scheme, cell_id, poi_count, round(density_per_km2, 6) AS density_per_km2, {', '.join(f'\"{n}_count\", round(\"{n}_count\" / nullif(poi_count, 0), 6) AS \"{n}_share\"' for n in _NAMES)} FROM cell")
def maup_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(schemes(spark, sf_dir).select("scheme", "cell_id", "poi_count", "density_per_km2", *[f"{n}_{k}" for n in _NAMES for k in ("count", "share")]))


@query(f"""WITH {SQL}, {_partition_sql()}, l AS (SELECT scheme, 'poi_count' AS metric, CAST(poi_count AS DOUBLE) AS v FROM cell UNION ALL SELECT scheme, 'BUILDING_share', "BUILDING_count" / nullif(poi_count, 0) FROM cell)
SELECT scheme, metric, count(*) AS n, count(v) AS valid_n, count(*) - count(v) AS undefined_n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS maximum FROM l GROUP BY scheme, metric""")
def maup_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.distributions(schemes(spark, sf_dir), "scheme", ["poi_count", "BUILDING_share"]))


def _spearman_sql() -> str:
    ranks = ", ".join(f'rank() OVER (PARTITION BY scheme ORDER BY "{g}_count") + (count(*) OVER (PARTITION BY scheme, "{g}_count") - 1) / 2.0 AS r{i}' for i, g in enumerate(GROUPS))
    pairs = [(i, j) for i in range(len(GROUPS)) for j in range(i + 1, len(GROUPS))]
    rows = " UNION ALL ".join(f"SELECT scheme, count(*) AS n, '{GROUPS[i]}_count' AS first, '{GROUPS[j]}_count' AS second, CASE WHEN count(DISTINCT r{i}) > 1 AND count(DISTINCT r{j}) > 1 THEN corr(r{i}, r{j}) END AS rho FROM r GROUP BY scheme" for i, j in pairs)
    return f"""WITH {SQL}, {_partition_sql()}, r AS (SELECT scheme, {ranks} FROM cell), k AS ({rows})
    SELECT k.scheme, k.n, k.first, k.second, round(k.rho, 6) AS rho, round(k.rho - b.rho, 6) AS delta_from_baseline FROM k JOIN k b ON b.scheme = 'square500' AND b.first = k.first AND b.second = k.second"""


@query(_spearman_sql())
def maup_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman_pairs(schemes(spark, sf_dir), "scheme", [f"{g}_count" for g in GROUPS], "square500"))


MASKS = [("square", "straight400"), ("square", "straight500"), ("straight500", "straight800"), ("straight400", "straight800")]
_MASK_SQL = f"""m AS (SELECT s.id AS region_id, p.category_group AS g, abs(p.x-s.x) <= 500 AND abs(p.y-s.y) <= 500 AS square, hypot.d <= 400 AS straight400, hypot.d <= 500 AS straight500, hypot.d <= 800 AS straight800
FROM poi p JOIN station s ON abs(p.x-s.x) <= 800 AND abs(p.y-s.y) <= 800, LATERAL (SELECT sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS d) hypot WHERE hypot.d <= 800 OR (abs(p.x-s.x) <= 500 AND abs(p.y-s.y) <= 500)),
cmp AS ({" UNION ALL ".join(f'''SELECT region_id, '{a}' AS first, '{b}' AS second, count(*) FILTER ({a}) AS n_first, count(*) FILTER ({b}) AS n_second, count(*) FILTER ({a} AND {b}) AS shared, count(*) FILTER ({a} OR {b}) AS union_n,
count(*) FILTER ({a} AND {b}) / CAST(nullif(count(*) FILTER ({a} OR {b}), 0) AS DOUBLE) AS jaccard, count(*) FILTER ({b}) - count(*) FILTER ({a}) AS count_difference, count(*) FILTER ({a} OR {b}) < 30 AS low_poi,
({" + ".join(f"abs(count(*) FILTER ({b} AND g = '{x}') / CAST(nullif(count(*) FILTER ({b}), 0) AS DOUBLE) - count(*) FILTER ({a} AND g = '{x}') / CAST(nullif(count(*) FILTER ({a}), 0) AS DOUBLE))" for x in (*GROUPS, '__OTHER__', '__MISSING__'))}) / 2 AS composition_tvd FROM m GROUP BY region_id''' for a, b in MASKS)})"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y of stations' places, n points of each group in each set of masks."""
    names = [*GROUPS, "__OTHER__", "__MISSING__"]
    places = pois(spark, sf_dir).groupBy("x", "y").agg(*[F.count_if(F.col("category_group") == g).alias(f"g{i}") for i, g in enumerate(names)])
    pairs = spatial.covered_by_squares(places, stations(spark, sf_dir).select("x", "y").distinct(), 800)
    dx, dy = F.abs(F.col("point_x") - F.col("square_x")), F.abs(F.col("point_y") - F.col("square_y"))
    marks = ["square", *[f"straight{r}" for r in (400, 500, 800)]]
    found = pairs.select(F.col("square_x").alias("x"), F.col("square_y").alias("y"), *[f"point_g{i}" for i in range(len(names))], ((dx <= 500) & (dy <= 500)).alias("square"), *[(F.hypot(dx, dy) <= r).alias(f"straight{r}") for r in (400, 500, 800)])
    sums = found.where("straight800 OR square").groupBy("x", "y", *marks).agg(*[F.sum(f"point_g{i}").alias(f"g{i}") for i in range(len(names))])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("category_group"), F.col(f"g{i}").alias("n")) for i, g in enumerate(names)]))
    return sums.select("x", "y", *marks, each.alias("e")).select("x", "y", *marks, "e.*")


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of one place have the same figures."""
    found = stats.overlap(masks(spark, sf_dir), MASKS, ["x", "y"], [*GROUPS, "__OTHER__", "__MISSING__"], weight="n")
    return stations(spark, sf_dir).select(F.col("id").alias("region_id"), "x", "y").join(found, ["x", "y"]).drop("x", "y")


@query(f"WITH {SQL}, {_MASK_SQL} SELECT region_id, first, second, n_first, n_second, shared, union_n, round(jaccard, 6) AS jaccard, count_difference, low_poi, round(composition_tvd, 6) AS composition_tvd FROM cmp")
def mask_overlap_tvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparisons(spark, sf_dir).select("region_id", "first", "second", "n_first", "n_second", "shared", "union_n", "jaccard", "count_difference", "low_poi", "composition_tvd"))


_Q = ", ".join(f"round(quantile_cont(CAST({m} AS DOUBLE), {p}), 6) AS {m}_{n}" for m in ("jaccard", "count_difference", "composition_tvd") for p, n in ((0.0, "min"), (0.1, "p10"), (0.5, "median"), (0.9, "p90"), (1.0, "max")))


@query(f"""WITH {SQL}, {_MASK_SQL}, e AS (SELECT *, unnest(['all', CASE WHEN low_poi THEN 'union_lt30' ELSE 'union_ge30' END]) AS cohort FROM cmp), t AS (SELECT *, max(CASE WHEN region_id = 7 THEN jaccard END) OVER (PARTITION BY first, second, cohort) AS tj FROM e)
SELECT first, second, cohort, count(*) AS valid_regions, count(jaccard) AS jaccard_defined, count(*) FILTER (jaccard >= 0.9) AS ge_09, count(*) FILTER (jaccard < 0.7) AS lt_07, {_Q},
round(CASE WHEN max(tj) IS NOT NULL THEN 100 * (count(*) FILTER (jaccard < tj) + 0.5 * count(*) FILTER (jaccard = tj)) / nullif(count(jaccard), 0) END, 6) AS target_percentile FROM t GROUP BY first, second, cohort""")
def cohort_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.cohorts(comparisons(spark, sf_dir), F.col("region_id") == 7))


_F = ("poi_density_per_km2", *[f"{g}_share" for g in GROUPS], "peak_to_mean_density_250m")
_LOGGED = ("poi_density_per_km2", "peak_to_mean_density_250m")
_V = ", ".join(f"{'ln(1 + ' + f + ')' if f in _LOGGED else f} AS {f}" for f in _F)


def _ranking_sql(standard: bool, target: int = 7, off: tuple[int, ...] = ()) -> str:
    center, scale = (("avg({f})", "stddev_pop({f})") if standard else ("quantile_cont({f}, 0.5)", "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"))
    sq = {f: f"pow((v.{f} - t.{f}) / p.s{i}, 2)" for i, f in enumerate(_F)}
    blocks = [sq[_F[0]], f"({' + '.join(sq[f] for f in _F[1:-1])}) / {len(GROUPS)}", sq[_F[-1]]]
    b0, b1, b2 = ("0.0::DOUBLE" if i in off else b for i, b in enumerate(blocks))
    return f"""WITH {SQL}, {_PROFILE}, v AS (SELECT region_id, {_V} FROM profile WHERE poi_count > 0), p AS (SELECT {', '.join(f'{scale.format(f=f)} AS s{i}' for i, f in enumerate(_F))} FROM v), t AS (SELECT * FROM v WHERE region_id = {target}),
    d AS (SELECT v.region_id, {b0} AS b0, {b1} AS b1, {b2} AS b2 FROM v, t, p WHERE v.region_id <> {target}),
    r AS (SELECT d.*, sqrt(b0+b1+b2) AS distance, row_number() OVER (ORDER BY sqrt(b0+b1+b2), region_id) AS audit_rank, abs(s.x-k.x) < 1000 AND abs(s.y-k.y) < 1000 AS excluded FROM d JOIN station s ON s.id = d.region_id, (SELECT * FROM station WHERE id = {target}) k)
    SELECT region_id, round(distance, 6) AS distance, round(b0/(b0+b1+b2), 6) AS density_contribution, CAST(audit_rank AS BIGINT) AS audit_rank, excluded AS excluded_from_main, CASE WHEN NOT excluded THEN CAST(sum(CASE WHEN excluded THEN 0 ELSE 1 END) OVER (ORDER BY distance, region_id) AS BIGINT) END AS rank FROM r"""


def _ranked(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    found = rank_regions(profiles(spark, sf_dir), stations(spark, sf_dir).withColumnRenamed("id", "region_id"), 7, [f"{g}_share" for g in GROUPS], mode=mode)
    return rounded(found.select("region_id", "distance", "density_contribution", "audit_rank", "excluded_from_main", "rank"))


def stability_sql(top: int = 10) -> str:
    modes = {"main": (False, ()), "standard": (True, ()), "density_only": (False, (1, 2)), "no_density": (False, (0,)), "no_concentration": (False, (2,))}
    ranks = " UNION ALL ".join(f"SELECT '{m}' AS mode, region_id, rank FROM ({_ranking_sql(standard, off=off)}) WHERE rank IS NOT NULL" for m, (standard, off) in modes.items())
    return f"""WITH k AS ({ranks}), m AS (SELECT region_id FROM k WHERE mode = 'main' AND rank <= {top}), j AS (SELECT k.*, m.region_id IS NOT NULL AS main FROM k LEFT JOIN m USING (region_id))
    SELECT mode, count(*) FILTER (rank <= {top} AND main) AS top_overlap, round(count(*) FILTER (rank <= {top} AND main) / CAST(count(*) FILTER (rank <= {top} OR main) AS DOUBLE), 6) AS top_jaccard, count(*) AS candidate_count FROM j GROUP BY mode"""


@query(_ranking_sql(False))
def similarity_ranking_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "main")


@query(_ranking_sql(True))
def similarity_ranking_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "standard")


@query(f"""WITH {SQL}, {_PROFILE}, v AS (SELECT region_id, {_V} FROM profile WHERE poi_count > 0), p AS (SELECT {', '.join(f'quantile_cont({f}, 0.5) AS m{i}, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS s{i}' for i, f in enumerate(_F))} FROM v)
SELECT region_id, {', '.join(f'round((v.{f} - m{i}) / s{i}' + (f' / sqrt({len(GROUPS)})' if f not in _LOGGED else '') + f', 6) AS {f}' for i, f in enumerate(_F))} FROM v, p""")
def robust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust_transform(profiles(spark, sf_dir), [f"{g}_share" for g in GROUPS]))


@query(f"""WITH {SQL}, {_PROFILE}, r AS (SELECT region_id, poi_count, rank() OVER (ORDER BY poi_count DESC) AS rank, row_number() OVER (ORDER BY poi_count DESC, region_id) AS n FROM profile WHERE region_id % 3 <> 0)
SELECT region_id, poi_count, rank, n <= 10 AS in_head FROM r WHERE rank <= (SELECT max(rank) FROM r WHERE n <= 10)""")
def competition_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.competition_rank(profiles(spark, sf_dir).select("region_id", "poi_count"), "poi_count", "region_id", 10, F.col("region_id") % 3 != 0)


@query(f"""WITH {SQL}, d AS (SELECT sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS d FROM poi p JOIN station s ON abs(p.x-s.x) <= 120 AND abs(p.y-s.y) <= 120), b AS (SELECT CASE WHEN d <= 5 THEN '5' WHEN d <= 10 THEN '10' WHEN d <= 20 THEN '20' WHEN d <= 30 THEN '30' WHEN d <= 50 THEN '50' WHEN d <= 100 THEN '100' ELSE '>100' END AS bin FROM d WHERE d <= 120)
SELECT k.bin, CAST(count(b.bin) AS BIGINT) AS n FROM (SELECT unnest(['5','10','20','30','50','100','>100']) AS bin) k LEFT JOIN b USING (bin) GROUP BY k.bin""")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distance_histogram(spatial.within_distance(pois(spark, sf_dir).select("id", "x", "y"), stations(spark, sf_dir).select("id", "x", "y"), 120)).select("bin", "n")


@query(f"""WITH {SQL}, d AS (SELECT sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) AS d FROM poi p JOIN station s ON abs(p.x-s.x) <= 100 AND abs(p.y-s.y) <= 100), r AS (SELECT unnest([30, 50, 100]) AS radius) SELECT CAST(radius AS INTEGER) AS radius, CAST(count(d) AS BIGINT) AS pairs FROM r LEFT JOIN d ON d <= radius GROUP BY radius""")
def radius_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.within_distance(pois(spark, sf_dir).select("id", "x", "y"), stations(spark, sf_dir).select("id", "x", "y"), 100)
    return pairs.agg(*[F.count_if(F.col("distance_m") <= r).alias(str(r)) for r in (30, 50, 100)]).unpivot([], ["30", "50", "100"], "radius", "pairs").withColumn("radius", F.col("radius").cast("int"))


@query(f"""WITH {SQL} SELECT id, CAST(floor(x / 25.0) AS BIGINT) AS col, CAST(floor(y / 25.0) AS BIGINT) AS "row" FROM poi""")
def raster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois(spark, sf_dir).select("id", cell_index(F.col("x"), 25).alias("col"), cell_index(F.col("y"), 25).alias("row"))
