"""Queries over graphs, territories, weights, neighbours and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.operators import graph, territory, vectors
from loxodrome.operators.components import connected_components
from loxodrome.plans.inputs import GROUPS, SQL, pois, stations, table
from loxodrome.plans.registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_EDGES = "n AS (SELECT count(*) AS c FROM part), e1 AS (SELECT i AS u, i + s AS v, 1 + i % 13 AS w FROM n, range(0, n.c) t(i), (SELECT unnest([1, 7]) AS s) WHERE i + s < n.c), e AS (SELECT u, v, w FROM e1 UNION ALL SELECT v, u, w FROM e1)"


def road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes 0 to N-1, edges to the next and the seventh next, of length 1 + i % 13."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("c"))
    step = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("u"), "c").withColumn("s", F.explode(F.array(F.lit(1), F.lit(7))))
    return step.select("u", (F.col("u") + F.col("s")).alias("v"), (1 + F.col("u") % 13).cast("double").alias("length_m"), "c").where("v < c").drop("c")


def _paths(sources: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, r(node, code) USING KEY (node) AS ({sources} UNION SELECT c.node, min(c.code) FROM (SELECT e.v AS node, r.code + CAST(e.w * 1000 AS BIGINT) AS code FROM r JOIN e ON e.u = r.node) c
    LEFT JOIN recurring.r o ON o.node = c.node WHERE c.code < coalesce(o.code, 9000000000000000) GROUP BY c.node)"""


@query(_paths("SELECT CAST(5 AS BIGINT) AS node, CAST(0 AS BIGINT) AS code") + " SELECT node, CAST(code // 1000 AS DOUBLE) AS dist FROM r")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.createDataFrame([(5, 0.0, 0)], "node long, dist double, owner long")
    return graph.nearest_owners(road(spark, sf_dir), source, F.floor(F.col("node") / 4096)).select("node", "dist")


_UNIT = 1_000_000_000


@query(_paths(f"SELECT s_suppkey * 17 % (SELECT c FROM n) AS node, min((s_suppkey % 5) * {_UNIT} + s_suppkey) AS code FROM supplier GROUP BY 1").replace("e.w * 1000", f"e.w * {_UNIT}") + f" SELECT node, CAST(code // {_UNIT} AS DOUBLE) AS dist, code % {_UNIT} AS owner FROM r")
def multi_source_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a source."""
    k = F.col("s_suppkey")
    nodes = table(spark, sf_dir, "part").agg(F.count("*").alias("c"))
    sources = table(spark, sf_dir, "supplier").join(F.broadcast(nodes)).select((k * 17 % F.col("c")).alias("node"), (k % 5).cast("double").alias("dist"), k.alias("owner"))  # one row
    return graph.nearest_owners(road(spark, sf_dir), sources, F.floor(F.col("node") / 4096))


_LINKS = "l1 AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey % 7 <> 0), l AS (SELECT a, b FROM l1 WHERE a <> b UNION SELECT b, a FROM l1 WHERE a <> b)"


@query(f"""WITH RECURSIVE {_LINKS}, r(node, component) USING KEY (node) AS (SELECT a, a FROM l UNION SELECT c.node, min(c.label) FROM (SELECT l.b AS node, r.component AS label FROM r JOIN l ON l.a = r.node) c LEFT JOIN recurring.r o ON o.node = c.node WHERE c.label < o.component GROUP BY c.node)
SELECT node, component FROM r""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of customers; every seventh key starts one, having no link upwards."""
    k = F.col("c_custkey")
    links = table(spark, sf_dir, "customer").select(k.alias("a"), F.when(k % 7 != 0, F.floor(k / 3)).otherwise(k).alias("b"))
    return connected_components(links)


_REACH = "e AS (SELECT o_orderkey AS id, CAST(20 + o_orderkey % 200 AS DOUBLE) AS l, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 300 AS DOUBLE) END AS du, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 3 % 300 AS DOUBLE) END AS dv FROM orders)"


@query(f"""WITH {_REACH}, s AS (SELECT id, l, least(l, greatest(0, 150 - coalesce(du, 1e9))) AS h1, least(l, greatest(0, l - 150 + coalesce(dv, 1e9))) AS l2 FROM e)
SELECT id, CASE WHEN h1 > 0 AND l2 < l AND l2 <= h1 THEN 1 ELSE CAST(h1 > 0 AS INT) + CAST(l2 < l AS INT) END AS parts, round(CASE WHEN h1 > 0 AND l2 < l AND l2 <= h1 THEN l ELSE h1 + (l - l2) END, 6) AS covered_m FROM s""")
def reachable_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (20 + k % 200).cast("double").alias("l"), F.when(k % 11 != 0, (k % 300).cast("double")).alias("du"), F.when(k % 7 != 0, (k * 3 % 300).cast("double")).alias("dv"))
    parts = rows.withColumn("p", graph.reachable_intervals(F.col("l"), F.col("du"), F.col("dv"), F.lit(150.0)))
    return rounded(parts.select("id", F.size("p").alias("parts"), F.aggregate("p", F.lit(0.0), lambda s, x: s + x["high"] - x["low"]).alias("covered_m")))


@query("SELECT least(a, b) AS u, greatest(a, b) AS v, min(w) AS way_id FROM (SELECT l_orderkey AS w, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2")
def edges_of_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("refs"))
    key = F.col("p_partkey")
    lone = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).union(table(spark, sf_dir, "part").select("p_partkey")).distinct()
    return graph.edges_of_ways(ways, lone.select(key.alias("node_id"), (key % 97).cast("double").alias("x"), (key % 89).cast("double").alias("y"))).select("u", "v", "way_id")


@query(f"""WITH RECURSIVE {SQL}, b AS (SELECT CAST(id % 60 AS VARCHAR) AS g, 'S' || (id % 6) AS name, avg(x) AS x, avg(y) AS y FROM station GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY g) AS i FROM b),
l AS (SELECT a.i AS a, c.i AS b FROM n a JOIN n c ON a.i <> c.i AND a.name = c.name AND sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) <= 600),
r(node, comp) USING KEY (node) AS (SELECT i, i FROM n UNION SELECT c.node, min(c.label) FROM (SELECT l.b AS node, r.comp AS label FROM r JOIN l ON l.a = r.node) c LEFT JOIN recurring.r o ON o.node = c.node WHERE c.label < o.comp GROUP BY c.node)
SELECT string_agg(DISTINCT g, '|' ORDER BY g) AS key, min_by(n.name, i) AS name, round(avg(s.x), 3) AS x, round(avg(s.y), 3) AS y, CAST(count(*) AS INTEGER) AS members FROM r JOIN n ON n.i = r.node JOIN station s ON CAST(s.id % 60 AS VARCHAR) = n.g GROUP BY comp""")
def merge_station_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier groups of one name that chain within 600 m."""
    k = F.col("id")
    rows = stations(spark, sf_dir).select(k.alias("station_row"), (k % 60).cast("string").alias("group"), F.concat(F.lit("S"), (k % 6).cast("string")).alias("name"), F.concat((k % 3).cast("string"), F.lit("号線L")).alias("line"), F.lit("op").alias("operator"), "x", "y")
    return graph.merge_groups(rows, 600).select("key", "name", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.size("members").alias("members"))


_WINDOW = 40


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT s_suppkey AS region_id, s_suppkey * 7 % (c - {_WINDOW}) AS f FROM supplier, n), we AS (SELECT region_id, f, u, v, w FROM s JOIN e ON least(e.u, e.v) BETWEEN f AND f + {_WINDOW - 1}),
r(region_id, node, dist) USING KEY (region_id, node) AS (SELECT region_id, f, CAST(2.5 AS DOUBLE) FROM s UNION ALL SELECT region_id, f + 1, CAST(1.5 + 1 + f % 13 AS DOUBLE) FROM s
    UNION SELECT c.region_id, c.node, min(c.dist) FROM (SELECT we.region_id, we.v AS node, r.dist + we.w AS dist FROM r JOIN we ON we.u = r.node AND we.region_id = r.region_id) c LEFT JOIN recurring.r o ON o.node = c.node AND o.region_id = c.region_id WHERE c.dist < coalesce(o.dist, 1e18) GROUP BY ALL)
SELECT region_id, node, round(dist, 6) AS dist FROM r""")
def station_network_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths over each station's own window of the road."""
    edges = road(spark, sf_dir).select("u", "v", "length_m", (F.col("u") * 10 + (F.col("v") - F.col("u"))).alias("edge_id"))
    nodes = table(spark, sf_dir, "part").agg(F.count("*").alias("c"))
    starts = stations(spark, sf_dir).join(F.broadcast(nodes)).select(F.col("id").alias("region_id"), (F.col("id") * 7 % (F.col("c") - _WINDOW)).alias("start"))  # one row
    window = starts.withColumn("u", F.explode(F.sequence("start", F.col("start") + _WINDOW - 1))).join(edges, "u").select("region_id", "edge_id", "u", "v", "length_m")
    snapped = starts.select("region_id", (F.col("start") * 10 + 1).alias("edge_id"), F.lit(2.0).alias("offset_m"), F.lit(0.5).alias("position_m"))
    return rounded(graph.station_distances(snapped, window))


# --- territories


def _raster_sql(name: str, across: int, cell: int) -> str:
    return f"""{name}_g AS (SELECT CAST(r AS BIGINT) AS "row", CAST(q AS BIGINT) AS col, -2000 + (q + 0.5) * {cell} AS cx, -2000 + (r + 0.5) * {cell} AS cy FROM range(0, {across}) a(r), range(0, {across}) b(q)),
{name}_d AS (SELECT g.*, s.id AS owner, CAST(s.id % 50 AS DOUBLE) AS dist, sqrt(pow(cx-s.x, 2)+pow(cy-s.y, 2)) AS off FROM {name}_g g JOIN station s ON abs(cx-s.x) <= 300 AND abs(cy-s.y) <= 300),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY off, owner) AS n FROM {name}_d WHERE off <= 300), {name}_b AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY dist + off, n) AS best FROM {name}_k WHERE n <= 8),
{name} AS (SELECT g."row", g.col, b.dist + off AS dist, b.owner FROM {name}_g g LEFT JOIN {name}_b b ON b."row" = g."row" AND b.col = g.col AND best = 1)"""


_CELLS = f"{SQL}, {_raster_sql('c', 40, 100)}"


def owned(spark: SparkSession, sf_dir: str, across: int = 40, cell: float = 100.0) -> DataFrame:
    """The raster of the stations' territories."""
    points = stations(spark, sf_dir).select("x", "y", (F.col("id") % 50).cast("double").alias("dist"), F.col("id").alias("owner"))
    return territory.raster(points, -2000.0, -2000.0, across, across, cell, 300.0)


@query(f"WITH {_CELLS} SELECT owner, count(*) AS cells, CAST(count(*) * 10000 AS DOUBLE) AS area_m2, round(avg(dist), 6) AS mean, round(quantile_cont(dist, 0.5), 6) AS median, round(quantile_cont(dist, 0.9), 6) AS p90, max(dist) AS maximum, round(count(*) FILTER (dist > 200) / count(dist), 6) AS far_share FROM c GROUP BY owner")
def territory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(territory.owner_stats(owned(spark, sf_dir), 10000, 200))


@query(f"""WITH {_CELLS}, z AS (SELECT id AS zone_id, x AS west, y AS south, x + 250 AS east, y + 180 AS north, CAST(id % 90 AS DOUBLE) AS population FROM station),
p AS (SELECT z.*, g.r, g.q, greatest(least(east, -2000 + (g.q + 1) * 100) - greatest(west, -2000 + g.q * 100), 0) * greatest(least(north, -2000 + (g.r + 1) * 100) - greatest(south, -2000 + g.r * 100), 0) AS area FROM z, (SELECT r, q FROM range(-5, 50) a(r), range(-5, 50) b(q)) g)
SELECT zone_id, owner, round(sum(area), 4) AS area_m2, round(sum(population * area / 45000.0), 6) AS population, round(sum(population * area / 45000.0 * dist), 4) AS population_distance FROM p LEFT JOIN c ON c."row" = r AND c.col = q WHERE area > 0 GROUP BY zone_id, owner""")
def area_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = stations(spark, sf_dir).select(F.col("id").alias("zone_id"), F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + 250).alias("east"), (F.col("y") + 180).alias("north"), (F.col("id") % 90).cast("double").alias("population"))
    found = territory.allocate(zones, owned(spark, sf_dir), -2000.0, -2000.0, 100.0, ["population"])
    return found.select("zone_id", "owner", F.round("area_m2", 4).alias("area_m2"), F.round("population", 6).alias("population"), F.round("population_distance", 4).alias("population_distance"))


@query(f"WITH {_CELLS} SELECT owner, count(*) AS total, {', '.join(f'count(*) FILTER (category_group = {chr(39)}{g}{chr(39)}) AS {chr(34)}{g}{chr(34)}' for g in GROUPS)} FROM poi LEFT JOIN c ON c.col = floor((x + 2000) / 100) AND c.\"row\" = floor((y + 2000) / 100) GROUP BY owner")
def poi_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return territory.by_category(pois(spark, sf_dir), owned(spark, sf_dir), -2000.0, -2000.0, 100.0, GROUPS)


@query(f"""WITH {SQL}, m AS (SELECT *, CAST(id % 50 AS DOUBLE) AS dist FROM station), e AS (SELECT a.id AS edge_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, a.dist AS da, b.dist AS db, a.id AS ao, b.id AS bo, 10.0 + a.id % 90 AS l FROM m a JOIN m b ON b.id = a.id + 1),
i AS (SELECT *, ceil(l / 20) - 1 AS n FROM e), p AS (SELECT i.*, j FROM i, range(1, 6) t(j) WHERE j <= n) SELECT edge_id, j, round(ax * (1 - j / (n + 1)) + bx * j / (n + 1), 5) AS x, round(least(da + j * l / (n + 1), db + l - j * l / (n + 1)), 5) AS dist, CASE WHEN da + j * l / (n + 1) <= db + l - j * l / (n + 1) THEN ao ELSE bo END AS owner FROM p""")
def densified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = stations(spark, sf_dir).select(F.col("id").alias("node_id"), "x", "y", (F.col("id") % 50).cast("double").alias("dist"), F.col("id").alias("owner"))
    edges = nodes.select(F.col("node_id").alias("edge_id"), F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"), (10.0 + F.col("node_id") % 90).alias("length_m"))
    return rounded(territory.densify(edges, nodes, 20.0).where("edge_id IS NOT NULL").select("edge_id", "j", "x", "dist", "owner"), 5)


@query(f'WITH {SQL}, {_raster_sql("c", 16, 250)} SELECT "row", col, round(dist, 6) AS dist, owner FROM c')
def raster_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(owned(spark, sf_dir, 16, 250.0))


# --- weights, neighbours, clusters


_COUNTS = "n AS (SELECT l_suppkey AS region_id, p_type AS term, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return vectors.term_counts(rows, "l_suppkey", "p_type")


@query(f"WITH {_COUNTS}, d AS (SELECT term, count(*) AS df FROM n GROUP BY term), m AS (SELECT count(DISTINCT region_id) AS c FROM n), w AS (SELECT region_id, n.term, n * (ln((1 + c) / (1.0 + df)) + 1) AS w FROM n JOIN d USING (term), m) SELECT region_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY region_id)), 6) AS weight FROM w")
def tfidf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.tfidf(counts(spark, sf_dir)))


@query(f"WITH {_COUNTS} SELECT term, count(DISTINCT region_id) AS df, count(DISTINCT region_id) >= 5 AS kept FROM n GROUP BY term")
def df_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.frequent_terms(counts(spark, sf_dir))


@query(f"WITH {_COUNTS}, d AS (SELECT term, count(*) AS df FROM n GROUP BY term), m AS (SELECT count(DISTINCT region_id) AS c FROM n), w AS (SELECT region_id, n.term, n * (ln((1 + c) / (1.0 + df)) + 1) AS w FROM n JOIN d USING (term), m), u AS (SELECT region_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY region_id)) AS w FROM w) SELECT a.term, round(a.w * b.w, 6) AS part FROM u a JOIN u b USING (term) WHERE a.region_id = 1 AND b.region_id = 2")
def cosine_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.cosine_parts(vectors.tfidf(counts(spark, sf_dir)), 1, 2))


@query("WITH o AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS i FROM lineitem), s AS (SELECT r, count(*) AS n FROM o GROUP BY r) SELECT x.r AS a, y.r AS b, count(*) AS shared, round(count(*) / CAST(any_value(p.n) + any_value(q.n) - count(*) AS DOUBLE), 6) AS jaccard FROM o x JOIN o y ON x.i = y.i AND x.r < y.r JOIN s p ON p.r = x.r JOIN s q ON q.r = y.r GROUP BY x.r, y.r")
def shared_item_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.shared_items(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey"))


_TOP = """q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS query, b.vec_id AS id, 1 - list_cosine_similarity(a.v, b.v) AS dc, list_distance(a.v, b.v) AS de FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dc, 12), id) AS rc, row_number() OVER (PARTITION BY query ORDER BY round(de, 12), id) AS re FROM d)"""


def _asked(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.top_neighbours(rows, 10, rows.where("vec_id % 50 = 0"), metric=metric)


@query(f"WITH {_TOP} SELECT query, id, round(dc, 6) AS distance, CAST(rc AS INTEGER) AS rank FROM r WHERE rc <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_asked(spark, sf_dir, "cosine"))


@query(f"WITH {_TOP} SELECT query, count(*) FILTER (rc <= 10 AND re <= 10) / 10.0::DOUBLE AS retention FROM r GROUP BY query")
def topk_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.retention(_asked(spark, sf_dir, "cosine"), _asked(spark, sf_dir, "euclidean"))


@query("""WITH t AS (SELECT label AS a, vec_id % 3 AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM t), ra AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT round((s.x - ra.x * rb.x / (s.n * (s.n - 1) / 2)) / ((ra.x + rb.x) / 2 - ra.x * rb.x / (s.n * (s.n - 1) / 2)), 9) AS adjusted_rand FROM s, ra, rb""")
def cluster_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loxodrome.operators.stats import adjusted_rand

    return rounded(adjusted_rand(table(spark, sf_dir, "embeddings").withColumn("third", F.col("vec_id") % 3), "label", "third"), 9)


@query("SELECT label, count(*) FILTER (vec_id % 3 = 0) AS \"0\", count(*) FILTER (vec_id % 3 = 1) AS \"1\", count(*) FILTER (vec_id % 3 = 2) AS \"2\" FROM embeddings GROUP BY label")
def cluster_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("third", F.col("vec_id") % 3).groupBy("label").pivot("third", [0, 1, 2]).count().na.fill(0)


@query("WITH g AS (SELECT label, median(embedding[1]::DOUBLE) AS m, min(vec_id) AS k FROM embeddings GROUP BY label), o AS (SELECT label, CAST(row_number() OVER (ORDER BY m, k) AS INTEGER) AS cluster FROM g) SELECT vec_id, cluster FROM embeddings JOIN o USING (label)")
def ordered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("first", F.col("embedding")[0].cast("double"))
    return vectors.ordered_labels(rows, "label", "first", "vec_id").select("vec_id", "cluster")


@query("""WITH e AS (SELECT vec_id, vec_id % 4 AS third, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.third AS c, b.third AS o, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY a.vec_id, a.third, b.third),
x AS (SELECT vec_id, c, max(CASE WHEN c = o THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM d GROUP BY vec_id, c) SELECT vec_id, CAST(c AS BIGINT) AS third, round((b - a) / greatest(a, b), 6) AS silhouette FROM x""")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.silhouettes(table(spark, sf_dir, "embeddings").withColumn("third", F.col("vec_id") % 4), "third"))


#: Dimensions of the vectors in the test tables.
_DIMENSIONS = 64


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows = table(spark, sf_dir, "embeddings")
    names = [f"d{i}" for i in range(_DIMENSIONS)]
    return rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("""WITH e AS (SELECT vec_id, vec_id % 3 AS k, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT k, i, avg(v) AS m, count(*) AS n FROM e GROUP BY k, i), g AS (SELECT i, avg(v) AS m, count(*) AS n FROM e GROUP BY i),
d AS (SELECT vec_id, k, sum(pow(v - m, 2)) AS d2 FROM e JOIN c USING (k, i) GROUP BY vec_id, k), s AS (SELECT k, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM d GROUP BY k),
p AS (SELECT x.k, y.k AS o, sqrt(sum(pow(x.m - y.m, 2))) AS far FROM c x JOIN c y ON x.i = y.i AND x.k <> y.k GROUP BY x.k, y.k), r AS (SELECT p.k, max((a.s + b.s) / far) AS r FROM p JOIN s a ON a.k = p.k JOIN s b ON b.k = p.o GROUP BY p.k),
b AS (SELECT sum(c.n * pow(c.m - g.m, 2)) AS b FROM c JOIN g USING (i))
SELECT round((SELECT b FROM b) / ((SELECT count(*) FROM s) - 1) / ((SELECT sum(w) FROM s) / ((SELECT sum(n) FROM s) - (SELECT count(*) FROM s))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin""")
def cluster_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _dense(spark, sf_dir)
    return rounded(vectors.separation(rows.withColumn("third", F.col("vec_id") % 3), "third", names))


_SPREAD = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query()
def svd_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _dense(spark, sf_dir)
    return vectors.project(rows, names, vectors.singular_vectors(rows, names, 4)[0], ["vec_id"])


@query(f"WITH {_SPREAD}, g AS (SELECT a.i, sum(a.v * a.v) AS own, max(a.v) AS high FROM e a GROUP BY a.i) SELECT count(*) AS dimensions, round(sum(own), 4) AS energy, true AS orthonormal, true AS residual_small FROM g")
def svd_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That all singular values carry the table's energy, and that its Gram matrix turns each vector into itself, times the value squared."""
    rows, names = _dense(spark, sf_dir)
    vectors_, values = vectors.singular_vectors(rows, names, _DIMENSIONS - 1)
    gram, _ = vectors.gram_matrix(rows, names)
    rest = float(np.trace(gram)) - float((values**2).sum())
    last = max(0.0, float(np.linalg.eigvalsh(gram)[0]))
    energy = float((values**2).sum()) + (rest if abs(rest - last) < 1e-6 * np.trace(gram) else float("nan"))
    straight = bool(np.allclose(vectors_.T @ vectors_, np.eye(_DIMENSIONS - 1), atol=1e-9))
    small = bool(np.abs(gram @ vectors_ - vectors_ * values**2).max() < 1e-7 * values[0] ** 2)
    return spark.createDataFrame([(len(names), round(energy, 4), straight, small)], "dimensions long, energy double, orthonormal boolean, residual_small boolean")


@query()
def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _dense(spark, sf_dir)
    loadings, share = vectors.principal_components(rows, names, 2)
    return spark.createDataFrame([(n, float(a), float(b), float(share[0]), float(share[1])) for n, (a, b) in zip(names, loadings, strict=True)], "feature string, first double, second double, first_share double, second_share double")


@query(f"WITH {_SPREAD} SELECT 'd' || (i - 1) AS feature, round(var_pop(v), 8) AS variance FROM e GROUP BY i")
def pca_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's variance, put together again from all components: the squares of its loadings, times their variances."""
    rows, names = _dense(spark, sf_dir)
    loadings, share = vectors.principal_components(rows, names, _DIMENSIONS)
    total = float(rows.agg(sum(F.var_pop(c) for c in names)).first()[0])
    found = (loadings**2 * (share * total)).sum(axis=1)
    return spark.createDataFrame([(n, round(float(v), 8)) for n, v in zip(names, found, strict=True)], "feature string, variance double")


@query()
def kmeans_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows, names = _dense(spark, sf_dir)
    labelled, _ = vectors.kmeans(VectorAssembler(inputCols=names, outputCol="features").transform(rows), 3, range(30))
    return labelled.select("vec_id", "cluster")


@query()
def ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in all dimensions, as one tree cut at three clusters."""
    rows, names = _dense(spark, sf_dir)
    return vectors.ward_labels(rows, names, [3], "vec_id").select("vec_id", F.col("ward_3").alias("cluster"))


@query(f"""WITH RECURSIVE {SQL}, o AS (SELECT id, x, y, row_number() OVER (ORDER BY id) AS i FROM station), r(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[])
UNION ALL SELECT o.i, CASE WHEN len(list_filter(kept, lambda k: abs(k.x - o.x) < 1000 AND abs(k.y - o.y) < 1000)) = 0 THEN list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y}}) ELSE kept END FROM r JOIN o ON o.i = r.i + 1)
SELECT k.id AS region_id FROM (SELECT unnest(kept) AS k FROM r WHERE i = (SELECT max(i) FROM o))""")
def independent_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.independent_subset(stations(spark, sf_dir).withColumnRenamed("id", "region_id"))
