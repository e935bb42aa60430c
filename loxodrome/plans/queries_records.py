"""Queries over records: filters, categories, matching, codes, projections, quality."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.functions import cells, crs, text
from loxodrome.functions import categories as tags
from loxodrome.operators import categories, matching, quality, stats
from loxodrome.plans.inputs import SQL, lonlat, pois, stations, table
from loxodrome.plans.registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

LONLAT = "ll AS (SELECT *, 139.58e0 + x * 1.1e-5 AS lon, 35.70e0 + y * 9.0e-6 AS lat FROM poi)"


# --- filters and profiles


@query(f"WITH {SQL}, {LONLAT} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll WHERE lon BETWEEN 139.57 AND 139.59 AND lat BETWEEN 35.69 AND 35.71 AND NOT (lon BETWEEN 139.575 AND 139.58 AND lat BETWEEN 35.695 AND 35.70) AND category IN ('BUILDING', 'FURNITURE')")
def bbox_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap box overlap first, the exact point after it, without a region already covered, of listed categories."""
    points = lonlat(pois(spark, sf_dir)).withColumn("bbox", F.struct((F.col("lon") - 1e-4).alias("xmin"), (F.col("lon") + 1e-4).alias("xmax"), (F.col("lat") - 1e-4).alias("ymin"), (F.col("lat") + 1e-4).alias("ymax")))
    near = points.where("bbox.xmin <= 139.59 AND bbox.xmax >= 139.57 AND bbox.ymin <= 35.71 AND bbox.ymax >= 35.69")
    exact = near.where(F.col("lon").between(139.57, 139.59) & F.col("lat").between(35.69, 35.71))
    done = F.col("lon").between(139.575, 139.58) & F.col("lat").between(35.695, 35.70)
    return rounded(exact.where(~done & F.col("category").isin("BUILDING", "FURNITURE")).select("id", "lon", "lat"))


@query(f"WITH {SQL} SELECT count(*) AS rows, count(DISTINCT id) AS ids, CAST(0 AS BIGINT) AS null_ids, count(*) FILTER (NOT coalesce(abs(x) <= 1990, false)) AS outside, count(*) FILTER (category IS NULL) AS no_category FROM poi")
def full_extract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counters(pois(spark, sf_dir), "id", {"outside": F.abs(F.col("x")) <= 1990, "no_category": F.col("category").isNotNull()})


_DICTIONARY = "dict AS (SELECT p_partkey AS category_id, p_brand AS category_name, p_partkey // 10 * 10 AS level1, p_partkey // 100 * 100 AS level2 FROM part)"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("category_id"), F.col("p_brand").alias("category_name"), (key - key % 10).alias("level1"), (key - key % 100).alias("level2"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the array of their parts."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("category_ids"))


@query(f"""WITH {_DICTIONARY}, roots AS (SELECT category_id FROM dict WHERE lower(category_name) IN ('brand#11', 'brand#12')), c AS (SELECT DISTINCT d.category_id FROM dict d WHERE EXISTS (SELECT 1 FROM roots r WHERE r.category_id IN (d.category_id, d.level1, d.level2)))
SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT category_id FROM c)""")
def category_hierarchy_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = categories.descendants(dictionary(spark, sf_dir), ["Brand#11", " BRAND#12"], ["level1", "level2"])
    return categories.having_any(tagged(spark, sf_dir), "category_ids", found, "id").select("id")


@query("SELECT DISTINCT l_partkey AS category_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def unmatched_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("category_id"))
    return categories.unknown_ids(tagged(spark, sf_dir), "category_ids", listed)


@query("SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (lang IS DISTINCT FROM 'en') AS not_english, count(*) FILTER (NOT list_contains(['src0', 'src1'], source)) AS other_source, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS wrong_length FROM documents")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.null_profile(table(spark, sf_dir, "documents"), {
        "null_text": F.col("text").isNull(), "not_english": ~F.col("lang").eqNullSafe("en"),
        "other_source": ~F.array_contains(F.array(F.lit("src0"), F.lit("src1")), F.col("source")), "wrong_length": ~F.col("n_chars").eqNullSafe(F.char_length("text").cast("long")),
    })


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source")


@query("SELECT round(min(c_acctbal), 6) AS low, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(median(c_acctbal), 6) AS mid, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, round(max(c_acctbal), 6) AS high, count(*) - count(c_acctbal) AS missing FROM customer")
def confidence_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rounded(table(spark, sf_dir, "customer").agg(F.min("c_acctbal").alias("low"), q[0].alias("q25"), q[1].alias("mid"), q[2].alias("q75"), F.max("c_acctbal").alias("high"), (F.count("*") - F.count("c_acctbal")).alias("missing")))


@query("SELECT w AS word, p_brand, p_size, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_brand, p_size FROM part) GROUP BY ALL")
def unnest_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_brand", "p_size").groupBy("word", "p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_list_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.col("t.role"), ">").alias("roles"))


@query("SELECT l_orderkey AS id, count(*) AS versions FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY l_orderkey HAVING count(*) > 1")
def distinct_conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag"), "id")


@query("SELECT o_orderkey AS id, (SELECT count(*) > 500 FROM orders WHERE o_orderstatus = 'F') AS truncated FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def truncation_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows by id, and whether one more would have followed."""
    rows, more = quality.truncated(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), "id", 500)
    return rows.withColumn("truncated", F.lit(more))


@query("SELECT s_suppkey, s_name, count(*) OVER (PARTITION BY s_nationkey) > 1 AS shared_nation FROM supplier")
def duplicated_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.count("*").over(Window.partitionBy("s_nationkey")) > 1).alias("shared_nation"))


@query("SELECT n_regionkey, mode(s_name ORDER BY s_name) AS first_name, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS nations, count(DISTINCT s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey")
def group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey").agg(F.mode("s_name", True).alias("first_name"), F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("nations"), F.count_distinct("s_suppkey").alias("suppliers"))


@query("SELECT band, count(*) AS n, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS priced, round(avg(o_totalprice), 2) AS mean FROM (SELECT *, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 199000 THEN 'mid' ELSE 'high' END AS band FROM orders) GROUP BY band")
def banded_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("o_totalprice") <= 50000, "low").when(F.col("o_totalprice") <= 199000, "mid").otherwise("high")
    return rounded(table(spark, sf_dir, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_totalprice") > 1000, 1)).alias("priced"), F.avg("o_totalprice").alias("mean")), 2)


@query("SELECT o_orderkey AS id FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || 'seed'), o_orderkey LIMIT 20")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that is the same in any engine and on any rerun."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("seed"))), "id").limit(20)


@query("SELECT half, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS half FROM orders) GROUP BY half")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.pmod(F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(2))
    return table(spark, sf_dir, "orders").groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_nationkey = 3 THEN 'nation' WHEN s_name LIKE '%7' THEN 'name' END AS reason FROM supplier")
def reason_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return quality.first_reason(rows, {"negative": F.col("s_acctbal") < 0, "nation": F.col("s_nationkey") == 3, "name": F.col("s_name").endswith("7")}).select(F.col("s_suppkey").alias("id"), "reason")


# --- tags


_TAGS = """t AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ['motorway', 'residential', 'footway', 'construction'][event_id % 4 + 1] END AS highway, CASE WHEN event_id % 7 = 0 THEN 'no' WHEN event_id % 5 = 0 THEN 'yes' END AS foot,
CASE WHEN event_id % 3 = 0 THEN 'private' END AS access, CASE WHEN event_id % 13 = 0 THEN 'yes' END AS area, CASE WHEN event_id % 6 = 0 THEN 'yes' END AS motorroad, ['cafe', 'bench', 'school', 'clinic', 'bank', 'no'][event_id % 6 + 1] AS amenity,
CASE WHEN event_id % 8 = 0 THEN 'disused' WHEN event_id % 8 = 1 THEN 'books' END AS shop, CASE WHEN event_id % 17 = 0 THEN 'station' END AS railway, CASE WHEN event_id % 9 = 0 THEN 'water' WHEN event_id % 9 = 1 THEN 'wood' END AS nature, CASE WHEN event_id % 4 = 0 THEN 'pond' END AS water FROM events)"""


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids with a map of tags made from them; a tag that isn't given has no entry."""
    k = F.col("event_id")

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    given = {
        "highway": F.when(k % 11 != 0, pick(["motorway", "residential", "footway", "construction"])), "foot": F.when(k % 7 == 0, "no").when(k % 5 == 0, "yes"), "access": F.when(k % 3 == 0, "private"),
        "area": F.when(k % 13 == 0, "yes"), "motorroad": F.when(k % 6 == 0, "yes"), "amenity": pick(["cafe", "bench", "school", "clinic", "bank", "no"]), "shop": F.when(k % 8 == 0, "disused").when(k % 8 == 1, "books"),
        "railway": F.when(k % 17 == 0, "station"), "natural": F.when(k % 9 == 0, "water").when(k % 9 == 1, "wood"), "water": F.when(k % 4 == 0, "pond"),
    }
    whole = F.create_map(*[x for name, v in given.items() for x in (F.lit(name), v)])
    return table(spark, sf_dir, "events").select(k.alias("id"), F.map_filter(whole, lambda _, v: v.isNotNull()).alias("tags"))


@query(f"""WITH {_TAGS} SELECT id FROM t WHERE highway IS NOT NULL AND highway NOT IN ('motorway', 'construction') AND coalesce(area, '') <> 'yes' AND coalesce(foot, '') <> 'no'
AND NOT (coalesce(motorroad, '') = 'yes' AND coalesce(foot, '') <> 'yes') AND NOT (coalesce(access, '') = 'private' AND coalesce(foot, '') <> 'yes')""")
def walk_tags_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_rows(spark, sf_dir).where(tags.walkable(F.col("tags"))).select("id")


@query(f"WITH {_TAGS} SELECT id FROM t WHERE nature = 'water' OR (water IS NOT NULL AND coalesce(nature, 'water') = 'water')")
def water_tags_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_rows(spark, sf_dir).where(tags.water(F.col("tags"))).select("id")


@query(f"""WITH {_TAGS} SELECT id, CASE WHEN railway = 'station' THEN NULL WHEN amenity = 'clinic' THEN 'healthcare' WHEN amenity = 'cafe' THEN 'food' WHEN amenity = 'school' THEN 'education' WHEN shop = 'books' THEN 'shop' WHEN amenity = 'bank' THEN 'other_amenity' END AS facility FROM t""")
def poi_priority_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_rows(spark, sf_dir).select("id", tags.facility(F.col("tags")).alias("facility"))


@query("SELECT s_suppkey AS id, lpad(CAST(s_suppkey * 7 % 50000 AS VARCHAR), 5, '0') AS code FROM supplier WHERE substr(lpad(CAST(s_suppkey * 7 % 50000 AS VARCHAR), 5, '0'), 1, 2) IN ('00', '01') AND lpad(CAST(s_suppkey * 7 % 50000 AS VARCHAR), 5, '0') NOT IN ('00014') AND lpad(CAST(s_suppkey * 7 % 50000 AS VARCHAR), 5, '0') NOT LIKE '%000'")
def code_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("s_suppkey") * 7 % 50000).cast("string"), 5, "0")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), code.alias("code")).where(tags.code_prefix(F.col("code"), ["00", "01"], ["00014"]))


# --- matching


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    out = []
    for source, rows in (("left", pois(spark, sf_dir)), ("right", stations(spark, sf_dir))):
        k = F.col("id")
        name = F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("  Shop  N"), (k % 12).cast("string")))
        phone = F.when(k % 4 == 0, F.array()).otherwise(F.array(F.concat(F.lit("+81 3-1234-567"), (k % 3).cast("string"))))
        site = F.when(k % 2 == 0, F.array(F.concat(F.lit("https://www.D"), (k % 5).cast("string"), F.lit(".example.com/x")))).otherwise(F.array())
        out.append(matching.comparison_view(source, rows, source_id=k, name=name, x=F.col("x"), y=F.col("y"), phones=phone, websites=site, categories=F.array(F.lit("c")) if source == "left" else None, ascii_only=True))
    return out[0], out[1]


_VIEW = f"""WITH {SQL}, v AS (SELECT 'left' AS source, id, x, y FROM poi UNION ALL SELECT 'right', id, x, y FROM station),
n AS (SELECT source, CAST(id AS VARCHAR) AS source_id, x, y, CASE WHEN id % 9 = 0 THEN '' ELSE '  Shop  N' || (id % 12) END AS name, CASE WHEN id % 9 = 0 THEN '' ELSE 'shop n' || (id % 12) END AS nn, CASE WHEN id % 4 <> 0 THEN id % 3 END AS phone, CASE WHEN id % 2 = 0 THEN id % 5 END AS site FROM v),
c AS (SELECT a.source_id AS left_id, b.source_id AS right_id, a.nn AS ln, b.nn AS rn, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance_m, a.nn <> '' AND a.nn = b.nn AS exact,
  CASE WHEN a.phone IS NULL OR b.phone IS NULL THEN 'unavailable' WHEN a.phone = b.phone THEN 'supporting' ELSE 'conflicting' END AS phone_evidence, CASE WHEN a.site IS NULL OR b.site IS NULL THEN 'unavailable' WHEN a.site = b.site THEN 'supporting' ELSE 'conflicting' END AS website_evidence
  FROM n a JOIN n b ON a.source = 'left' AND b.source = 'right' AND abs(a.x-b.x) <= 100 AND abs(a.y-b.y) <= 100 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 100),
w AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY left_id) AS le, count(*) FILTER (exact) OVER (PARTITION BY right_id) AS re FROM c),
s AS (SELECT *, concat_ws(';', CASE WHEN ln = '' OR rn = '' THEN 'missing_name' END, CASE WHEN NOT exact AND ln <> '' AND rn <> '' THEN 'no_name_evidence' END, CASE WHEN distance_m > 30 THEN 'distance_over_auto_threshold' END, CASE WHEN le > 1 OR re > 1 THEN 'multiple_exact_name_candidates' END,
  CASE WHEN le > 1 OR re > 1 THEN 'competing_candidate' END, CASE WHEN phone_evidence = 'conflicting' THEN 'conflicting_phone' END, CASE WHEN website_evidence = 'conflicting' THEN 'conflicting_website' END) AS reasons FROM w),
m AS (SELECT *, CASE WHEN exact AND reasons = '' THEN 'high_confidence' WHEN exact OR phone_evidence = 'supporting' OR website_evidence = 'supporting' THEN 'ambiguous' ELSE 'unmatched' END AS status FROM s)"""


def classified(spark: SparkSession, sf_dir: str, *, similarity: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of kinds of records, and the members of both sides' kinds."""
    return matching.classified_kinds(*views(spark, sf_dir), 100, similarity=similarity)


@query(f"{_VIEW} SELECT left_id, right_id, round(distance_m, 6) AS distance_m, phone_evidence, website_evidence, status, reasons FROM m")
def match_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, left, right = classified(spark, sf_dir)
    found = rounded(pairs.select("left_id", "right_id", "distance_m", "phone_evidence", "website_evidence", "status", "reasons"))
    return matching.spread(found, left, right)


@query()
def match_classify_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With name similarity in both directions, which SQL cannot express."""
    pairs, left, right = classified(spark, sf_dir, similarity=True)
    return matching.spread(rounded(pairs.select("left_id", "right_id", "name_similarity", "status", "reasons")), left, right)


@query(f"""{_VIEW}, l AS (SELECT 'left' AS source, left_id AS source_id, status FROM m UNION ALL SELECT 'right', right_id, status FROM m), g AS (SELECT source, source_id, bool_or(status = 'high_confidence') AS high, bool_or(status = 'ambiguous') AS amb FROM l GROUP BY ALL)
SELECT n.source, n.source_id, CASE WHEN g.high IS NULL THEN 'no_spatial_candidate' WHEN amb THEN 'ambiguous_candidate_exists' WHEN nn = '' THEN 'insufficient_evidence' ELSE 'spatial_candidate_but_no_name_evidence' END AS reason, g.high IS NOT NULL AS nearby FROM n LEFT JOIN g USING (source, source_id) WHERE NOT coalesce(g.high, false)""")
def match_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = views(spark, sf_dir)
    return matching.unmatched_of_kinds(left, right, *classified(spark, sf_dir)).select("source", "source_id", "reason", "nearby")


@query(f"{_VIEW} SELECT a.source_id AS left_id, b.source_id AS right_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS distance_m FROM n a JOIN n b ON a.source = 'left' AND b.source = 'right' AND a.nn <> '' AND a.nn = b.nn")
def exact_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_name_distances(*views(spark, sf_dir), places=6).select("left_id", "right_id", "distance_m")


@query("""WITH ab AS (SELECT s_suppkey AS a, s_suppkey * 3 % 101 AS b FROM supplier), ac AS (SELECT s_suppkey AS a, s_suppkey * 5 % 103 AS c FROM supplier), bc AS (SELECT s_suppkey * 3 % 101 AS b, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 5 % 103 ELSE 7 END AS c FROM supplier)
SELECT ab.a, ab.b, ac.c FROM ab JOIN ac USING (a) WHERE EXISTS (SELECT 1 FROM bc WHERE bc.b = ab.b AND bc.c = ac.c)""")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    a, b, c = k, k * 3 % 101, k * 5 % 103
    pairs = [rows.select(x.alias("left_id"), y.alias("right_id")) for x, y in ((a, b), (a, c), (b, F.when(k % 2 == 0, c).otherwise(7)))]
    return matching.three_way(*pairs)


@query(f"""{_VIEW} SELECT source, attribute, count(*) AS denominator, CAST(sum(flag) AS BIGINT) AS n, round(100.0 * sum(flag) / count(*), 6) AS percent FROM (SELECT source, 'has_name' AS attribute, CAST(nn <> '' AS INT) AS flag FROM n UNION ALL SELECT source, 'has_phone', CAST(phone IS NOT NULL AS INT) FROM n
UNION ALL SELECT source, 'has_website', CAST(site IS NOT NULL AS INT) FROM n UNION ALL SELECT source, 'has_category', CASE WHEN source = 'left' THEN 1 END FROM n) GROUP BY source, attribute""")
def attribute_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = views(spark, sf_dir)
    return rounded(stats.presence(left.unionByName(right), "source", ["has_name", "has_phone", "has_website", "has_category"]))


@query("""SELECT page_id, CASE WHEN contains(host, '.') THEN rtrim(regexp_replace(host, '^www\\.', ''), '.') ELSE '' END AS domain FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\\s]+)', 1)) AS host FROM pages)""")
def phone_domain_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.domain_keys(F.array("url")), ",").alias("domain"))


@query(f"{_VIEW}, r AS (SELECT unnest([30.0, 50.0, 100.0]::DOUBLE[]) AS radius) SELECT radius, count(*) AS candidates FROM r JOIN c ON c.distance_m <= radius GROUP BY radius")
def match_by_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.candidate_pairs(*views(spark, sf_dir), 100, similarity=False)
    return matching.by_radius(pairs, (30, 50, 100)).select("radius", "candidates")


# --- codes and projections


def _mesh_sql(lat: str, lon: str, factor: int) -> str:
    return f"CAST(floor(round({lat} * {120 * factor}, 9)) AS BIGINT) AS iy, CAST(floor(round(({lon} - 100) * {80 * factor}, 9)) AS BIGINT) AS ix"


_MESH9 = f"""m AS (SELECT id, {_mesh_sql('lat', 'lon', 2)} FROM ll), mesh AS (SELECT id, lpad(CAST(iy // 160 AS VARCHAR), 2, '0') || lpad(CAST(ix // 160 AS VARCHAR), 2, '0') || (iy // 2 % 80 // 10) || (ix // 2 % 80 // 10) || (iy // 2 % 10) || (ix // 2 % 10) || (1 + 2 * (iy % 2) + ix % 2) AS code FROM m)"""


@query(f"WITH {SQL}, {LONLAT}, {_MESH9} SELECT id, code, substr(code, 1, 8) AS parent, round(100 + CAST(substr(code, 3, 2) AS INT) + CAST(code[6] AS INT) / 8 + CAST(code[8] AS INT) / 80 + CASE WHEN code[9] IN ('2', '4') THEN 1 / 160 ELSE 0 END, 9) AS west FROM mesh")
def mesh_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = cells.mesh_code(F.col("lat"), F.col("lon"), 9)
    rows = lonlat(pois(spark, sf_dir)).select("id", code.alias("code"))
    return rows.select("id", "code", cells.mesh_parent(F.col("code")).alias("parent"), F.round(cells.mesh_bounds(F.col("code"))["west"], 9).alias("west"))


@query(f"""WITH {SQL}, {LONLAT}, {_MESH9}, child AS (SELECT code, CAST(sum(id) AS BIGINT) AS population FROM mesh WHERE id % 10 <> 0 GROUP BY code), parent AS (SELECT DISTINCT substr(code, 1, 8) AS code FROM mesh),
four AS (SELECT p.code, p.code || q AS k FROM parent p, (SELECT unnest(['1', '2', '3', '4']) AS q)) SELECT four.code AS mesh_code, count(population) AS children_present, CASE WHEN count(population) = 4 THEN CAST(sum(population) AS BIGINT) END AS population FROM four LEFT JOIN child ON child.code = k GROUP BY four.code""")
def mesh_parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population of a mesh from its four children; null, not a partial sum, if one is missing."""
    rows = lonlat(pois(spark, sf_dir)).select("id", cells.mesh_code(F.col("lat"), F.col("lon"), 9).alias("code"))
    child = rows.where("id % 10 <> 0").groupBy("code").agg(F.sum("id").alias("population"))
    parents = rows.select(cells.mesh_parent(F.col("code")).alias("mesh_code")).distinct()
    four = parents.withColumn("code", F.explode(cells.mesh_children(F.col("mesh_code"))))
    sums = four.join(child, "code", "left").groupBy("mesh_code").agg(F.count("population").alias("children_present"), F.sum("population").alias("s"))
    return sums.select("mesh_code", "children_present", F.when(F.col("children_present") == 4, F.col("s")).alias("population"))


@query(f"""WITH {SQL}, {LONLAT}, b AS (SELECT id, CAST(floor((lon + 180) / 360 * 32768) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 32768) AS BIGINT) AS y FROM ll)
SELECT id, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(CASE WHEN i % 2 = 0 THEN ((x >> (14 - 5 * i // 2)) & 1) * 16 + ((y >> (14 - 5 * i // 2)) & 1) * 8 + ((x >> (13 - 5 * i // 2)) & 1) * 4 + ((y >> (13 - 5 * i // 2)) & 1) * 2 + ((x >> (12 - 5 * i // 2)) & 1)
ELSE ((y >> (14 - (5 * i - 1) // 2)) & 1) * 16 + ((x >> (13 - (5 * i - 1) // 2)) & 1) * 8 + ((y >> (13 - (5 * i - 1) // 2)) & 1) * 4 + ((x >> (12 - (5 * i - 1) // 2)) & 1) * 2 + ((y >> (12 - (5 * i - 1) // 2)) & 1) END + 1 AS INT), 1), '' ORDER BY i) AS hash FROM b, range(6) t(i) GROUP BY id""")
def geohash6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lonlat(pois(spark, sf_dir)).select("id", cells.geohash(F.col("lat"), F.col("lon"), 6).alias("hash"))


@query(f"""WITH {SQL}, {LONLAT}, t AS (SELECT id, CAST(floor((lon + 180) / 360 * 65536) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) AS ty FROM ll)
SELECT id, tx, ty, (SELECT string_agg(CAST(((tx >> (15 - i)) & 1) + 2 * ((ty >> (15 - i)) & 1) AS VARCHAR), '' ORDER BY i) FROM range(16) r(i)) AS quadkey FROM t""")
def xyz_quadkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = cells.web_tile(F.col("lat"), F.col("lon"), 16)
    rows = lonlat(pois(spark, sf_dir)).select("id", x.alias("tx"), y.alias("ty"))
    return rows.withColumn("quadkey", cells.quadkey(16, F.col("tx"), F.col("ty")))


@query(f"""WITH {SQL}, c AS (SELECT id, x, y, CAST(floor(2 * x / 900) AS BIGINT) + da AS a, CAST(floor((-x / 3 + sqrt(3) * y / 3) / 300) AS BIGINT) + db AS b FROM poi, range(-2, 3) s(da), range(-2, 3) u(db)),
d AS (SELECT *, pow(450.0 * a - x, 2) + pow(300 * sqrt(3) * (b + a / 2.0) - y, 2) AS d2 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, a, b) AS n FROM d) SELECT id, a, b FROM r WHERE n = 1""")
def hex_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois(spark, sf_dir).select("id", cells.hexagon(F.col("x"), F.col("y")).alias("h")).select("id", "h.a", "h.b")


def _tm_sql(p: crs.TransverseMercator) -> str:
    series = lambda f, g: " + ".join(f"{a!r} * {f}({2.0 * (j + 1)} * xi) * {g}({2.0 * (j + 1)} * eta)" for j, a in enumerate(p.alpha))
    return f"""a AS (SELECT id, radians(lon - {p.lon0!r}) AS lam, sinh(atanh(sin(radians(lat))) - {p.e!r} * atanh({p.e!r} * sin(radians(lat)))) AS t FROM ll), b AS (SELECT id, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM a)
    SELECT id, round({p.k0 * p.radius!r} * (eta + {series('cos', 'sinh')}) + {p.east!r}, 4) AS east, round({p.k0 * p.radius!r} * (xi + {series('sin', 'cosh')} - {p.origin!r}) + {p.north!r}, 4) AS north FROM b"""


@query(f"WITH {SQL}, {LONLAT}, {_tm_sql(crs.JAPAN_9)}")
def tm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.JAPAN_9.forward(F.col("lon"), F.col("lat"))
    return rounded(lonlat(pois(spark, sf_dir)).select("id", x.alias("east"), y.alias("north")), 4)


@query(f"WITH {SQL}, {LONLAT}, {_tm_sql(crs.UTM_54N)}")
def utm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.UTM_54N.forward(F.col("lon"), F.col("lat"))
    return rounded(lonlat(pois(spark, sf_dir)).select("id", x.alias("east"), y.alias("north")), 4)


@query(f"WITH {SQL}, {LONLAT} SELECT id, round(6378137.0 * radians(lon), 4) AS mx, round(6378137.0 * asinh(tan(radians(lat))), 4) AS my, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - 35.7) / 2), 2) + cos(radians(35.7)) * cos(radians(lat)) * pow(sin(radians(lon - 139.58) / 2), 2))), 4) AS sphere_m FROM ll")
def mercator_and_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.web_mercator(F.col("lon"), F.col("lat"))
    d = crs.great_circle(F.lit(139.58), F.lit(35.7), F.col("lon"), F.col("lat"))
    return rounded(lonlat(pois(spark, sf_dir)).select("id", x.alias("mx"), y.alias("my"), d.alias("sphere_m")), 4)


@query()
def geodesic_and_equal_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipsoidal distances, Equal Earth, and the round trip of the plane projection."""
    lon, lat = F.col("lon"), F.col("lat")
    d = crs.geodesic_distance(F.lit(139.58), F.lit(35.7), lon, lat)
    ex, ey = crs.equal_earth(lon, lat)
    back = crs.JAPAN_9.inverse(*crs.JAPAN_9.forward(lon, lat))
    off = F.greatest(F.abs(back[0] - lon), F.abs(back[1] - lat))
    return rounded(lonlat(pois(spark, sf_dir)).select("id", d.alias("geodesic_m"), ex.alias("ex"), ey.alias("ey"), (off < 1e-9).alias("round_trip")), 4)


