"""Queries over lines, outlines and rows, and whole chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions import crs, shapes
from loxodrome.functions.categories import display_group, known
from loxodrome.operators import graph, records, regions, similarity, spatial, territory, vectors
from loxodrome.plans.inputs import GROUPS, SQL, lonlat, pois, stations, table
from loxodrome.plans.queries_regions import profiles, stability_sql
from loxodrome.plans.registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_row_index(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_index")


@query(f"""WITH {SQL}, b AS (SELECT id AS k, x - 150 AS w, x + 150 AS e, y - 100 AS s, y + 100 AS n FROM station), d AS (SELECT p.id, CASE WHEN x BETWEEN w AND e AND y BETWEEN s AND n THEN least(x - w, e - x, y - s, n - y) ELSE sqrt(pow(greatest(w - x, 0, x - e), 2) + pow(greatest(s - y, 0, y - n), 2)) END AS d FROM poi p, b)
SELECT p.id, round(CASE WHEN min(d) <= 120 THEN min(d) END, 6) AS boundary_m FROM poi p LEFT JOIN d USING (id) GROUP BY p.id""")
def boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct((F.col("x") - 150).alias("west"), (F.col("y") - 100).alias("south"), (F.col("x") + 150).alias("east"), (F.col("y") + 100).alias("north"))
    polygons = stations(spark, sf_dir).select(F.col("id").alias("polygon_id"), shapes.box_ring(box).alias("ring"))
    return rounded(records.boundary_distance(pois(spark, sf_dir).select("id", "x", "y"), polygons, 120).select("id", "boundary_m"))


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS k, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_partkey % 89 AS DOUBLE) AS y, l_partkey FROM lineitem), s AS (SELECT id, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM p WINDOW w AS (PARTITION BY id ORDER BY k, l_partkey))
SELECT id, round(coalesce(sum(d), 0), 6) AS length_m FROM s GROUP BY id""")
def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct("l_linenumber", "l_partkey", (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_partkey") % 89).cast("double").alias("y"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("line"))
    return rounded(lines.select("id", shapes.line_length(F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("length_m")))


@query(f"WITH {SQL}, c AS (SELECT DISTINCT CAST(floor(x / 500) AS BIGINT) AS ix, CAST(floor(y / 500) AS BIGINT) AS iy FROM poi), d AS (SELECT unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy) SELECT ix, iy, ix + dx AS nx, iy + dy AS ny FROM c, d")
def cell_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pois(spark, sf_dir).select(F.floor(F.col("x") / 500).alias("ix"), F.floor(F.col("y") / 500).alias("iy")).distinct()
    return cells.withColumn("n", F.explode(shapes.square_neighbours(F.col("ix"), F.col("iy")))).select("ix", "iy", F.col("n.ix").alias("nx"), F.col("n.iy").alias("ny"))


@query()
def military_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lonlat(pois(spark, sf_dir)).select("id", shapes.mgrs(F.col("lon"), F.col("lat"), 54, 2).alias("mgrs"))


@query()
def meshes_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.JAPAN_9.forward(F.col("lon"), F.col("lat"))
    return rounded(records.meshes_of_squares(lonlat(stations(spark, sf_dir)).select(F.col("id").alias("region_id"), x.alias("x"), y.alias("y")), crs.JAPAN_9, 500.0), 3)


@query(stability_sql())
def similarity_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five modes of the ranking, against the main one."""
    return rounded(similarity.stability(profiles(spark, sf_dir), stations(spark, sf_dir).withColumnRenamed("id", "region_id"), 7, [f"{g}_share" for g in GROUPS]))


@query()
def cluster_number_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to eight clusters, ten seeds each, over all dimensions, against Ward's."""
    names = [f"d{i}" for i in range(64)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return vectors.compare_k(rows, range(3, 9), range(10), names, "vec_id")


@query()
def territory_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road to owners to points along edges to a raster to the figures of each territory."""
    nodes, edges = territory.place_roads(pois(spark, sf_dir).select(F.col("id").alias("node_id"), "x", "y"), 120)
    snapped = spatial.nearest(stations(spark, sf_dir), nodes, 1, 300, "id", "node_id")
    sources = snapped.select(F.col("point_node_id").alias("node"), F.col("distance_m").alias("dist"), F.col("query_id").alias("owner"))
    owners = graph.nearest_owners(edges, sources, F.floor(F.col("node") / 256))
    known = nodes.join(owners.withColumnRenamed("node", "node_id"), "node_id")
    cells = territory.raster(territory.densify(edges, known, 60.0, copies=True), -2000.0, -2000.0, 40, 40, 100.0, 300.0)
    return rounded(territory.owner_stats(cells, 10_000.0, 300.0))


@query(f"""WITH {SQL} SELECT CASE WHEN category IS NULL THEN '__MISSING__' WHEN category IN ('BUILDING', 'HOUSEHOLD') THEN 'home' WHEN category = 'AUTOMOBILE' THEN 'road' ELSE '__OTHER__' END AS shown, coalesce(category, '__MISSING__') AS category, count(*) AS n FROM poi GROUP BY ALL""")
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = display_group(F.col("category"), {"home": ["BUILDING", "HOUSEHOLD"], "road": ["AUTOMOBILE"]})
    return pois(spark, sf_dir).groupBy(shown.alias("shown"), known(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH {SQL}, p AS (SELECT least(CAST(floor(x / 500) AS BIGINT), 3) AS ix, least(CAST(floor(y / 500) AS BIGINT), 3) AS iy FROM poi)
SELECT '500:' || ix || ':' || iy AS cell_id, count(*) AS denominator, count(*) AS s, true AS conserved FROM p GROUP BY ix, iy
UNION ALL SELECT '500:' || a.i || ':' || b.i, 0, 0, true FROM range(-4, 4) a(i), range(-4, 4) b(i) WHERE NOT EXISTS (SELECT 1 FROM p WHERE ix = a.i AND iy = b.i)""")
def level_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every cell: its points, the sum over its levels, and whether they agree."""
    cells = regions.grid(spark, (-2000.0, -2000.0), (2000.0, 2000.0), 500)
    levels = regions.level_table(regions.assign(pois(spark, sf_dir), (-2000.0, -2000.0), (2000.0, 2000.0), 500), cells, "category_group")
    sums = levels.groupBy("cell_id", "denominator").agg(F.sum("n").alias("s"))
    return sums.withColumn("conserved", F.col("s") == F.col("denominator"))
