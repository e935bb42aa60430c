"""Road graphs: edge tables, shortest paths with owners, snapping, reachable parts, station groups."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.operators.components import connected_components
from loxodrome.operators.spatial import within_distance
from loxodrome.plans.lineage import cut


def edges_of_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected edges u < v with length_m from ways' ordered node arrays (refs); the first of equal ones, pairs with an unknown node left out."""
    at = ways.select("way_id", F.posexplode("refs").alias("pos", "a"))
    pairs = at.withColumn("b", F.lead("a").over(Window.partitionBy("way_id").orderBy("pos"))).where("b IS NOT NULL AND a <> b")
    first = pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(F.struct("way_id", "pos")).alias("from"))
    ends = [nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "uv"]
    found = first.join(ends[0], "u").join(ends[1], "v")
    return found.select("u", "v", F.col("from.way_id").alias("way_id"), F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")).alias("length_m"))


def local_edges(nodes: DataFrame, edges: DataFrame, x: float, y: float, half: float) -> DataFrame:
    """Edges whose box meets the square, whole, u < v, without those of length zero."""
    ends = [nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i, k in ((1, "a"), (2, "b"))]
    joined = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().join(ends[0], "a").join(ends[1], "b")
    meets = [(F.greatest(f"{c}1", f"{c}2") >= F.lit(float(m - half))) & (F.least(f"{c}1", f"{c}2") <= F.lit(float(m + half))) for c, m in (("x", x), ("y", y))]
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return joined.where(meets[0] & meets[1]).withColumn("length_m", length).where("length_m > 0").withColumnsRenamed({"a": "u", "b": "v"})


def largest_component(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges of the component with most nodes (equal ones: the least node)."""
    found = cut(connected_components(edges, u, v))
    top = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return edges.join(found.join(top, "component", "left_semi").select(F.col("node").alias(u)), u, "left_semi")


def _relax(labels: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Within one block: settle all that its new labels reach; labels of own nodes and those offered to other blocks' nodes."""
    best = dict(zip(labels["node"], zip(labels["dist"], labels["owner"], strict=True), strict=True))
    out: dict[int, list] = defaultdict(list)
    block = dict(zip(links["v"], links["vb"], strict=True))
    for u, v, w in zip(links["u"], links["v"], links["w"], strict=True):
        out[u].append((v, w))
    own = set(labels["node"]) | set(links["u"])
    heap = [(d, o, n) for n, d, o, new in zip(labels["node"], labels["dist"], labels["owner"], labels["fresh"], strict=True) if new]
    heapq.heapify(heap)
    changed, offers = set(), {}
    while heap:
        d, o, n = heapq.heappop(heap)
        if best.get(n, (d, o)) < (d, o):
            continue
        for v, w in out[n]:
            new = (d + w, o)
            if v in own:
                if v not in best or new < best[v]:
                    best[v] = new
                    changed.add(v)
                    heapq.heappush(heap, (*new, v))
            elif v not in offers or new < offers[v]:
                offers[v] = new
    mine = labels["b"].iloc[0] if len(labels) else links["ub"].iloc[0]
    rows = [(n, mine, d, o, False) for n, (d, o) in best.items()] + [(v, block[v], d, o, True) for v, (d, o) in offers.items()]
    return pd.DataFrame(rows, columns=["node", "b", "dist", "owner", "fresh"])


def nearest_owners(edges: DataFrame, sources: DataFrame, block: Column | None = None, limit: float | None = None) -> DataFrame:
    """node, dist, owner: the least network distance from any source (node, dist, owner), and whose it is; equal distances take the smaller owner.

    Nodes lie in blocks (``block`` is an expression of the column node; near nodes
    should share one); without it they are dealt by hash, into blocks of about
    250,000 edges at most.  Each round settles every block's new labels with a heap
    and offers the rest to its neighbours, so rounds follow the number of block
    borders on the longest path, not its edges.  Nodes out of reach have no row.
    """
    if block is None:
        parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // 250_000))
        block = F.pmod(F.xxhash64("node"), F.lit(parts))
    both = edges.select("u", "v", F.col("length_m").cast("double").alias("w")).union(edges.select("v", "u", F.col("length_m").cast("double")))
    for k in "uv":
        both = both.withColumn("node", F.col(k)).withColumn(f"{k}b", block.cast("long")).drop("node")
    links = cut(both)
    schema = "node long, b long, dist double, owner long, fresh boolean"
    labels = sources.select("node", block.cast("long").alias("b"), F.col("dist").cast("double").alias("dist"), F.col("owner").cast("long").alias("owner"), F.lit(True).alias("fresh"))
    labels = cut(labels.groupBy("node", "b").agg(F.min(F.struct("dist", "owner")).alias("x")).select("node", "b", "x.dist", "x.owner", F.lit(True).alias("fresh")))
    while True:
        active = labels.where("fresh").select("b").distinct()
        mine = labels.join(active, "b", "left_semi").groupBy("b").cogroup(links.join(active, links["ub"] == active["b"], "left_semi").groupBy("ub"))
        after = mine.applyInPandas(_relax, schema).unionByName(labels.join(active, "b", "left_anti"))
        if limit is not None:
            after = after.where(F.col("dist") <= limit)
        settled = F.min(F.when(~F.col("fresh"), F.struct("dist", "owner")))
        merged = after.groupBy("node", "b").agg(F.min(F.struct("dist", "owner")).alias("x"), settled.alias("s"))
        labels = cut(merged.select("node", "b", "x.dist", "x.owner", (~F.col("x").eqNullSafe(F.col("s"))).alias("fresh")))
        if labels.where("fresh").isEmpty():
            return labels.select("node", "dist", "owner")


def _dijkstra(key, stations, edges):  # noqa: ANN001, ANN202
    """Distances to the nodes of one station's edges, from a virtual node tied to both ends of its snapped edge."""
    if not len(stations) or not len(edges):
        return pd.DataFrame({"region_id": [], "node": [], "dist": []}).astype({"region_id": "int64", "node": "int64", "dist": "float64"})
    s = stations.iloc[0]
    out = defaultdict(list)
    for u, v, w in zip(edges["u"], edges["v"], edges["length_m"], strict=True):
        out[u].append((v, w))
        out[v].append((u, w))
    first = edges[edges["edge_id"] == s["edge_id"]].iloc[0]
    heap = [(s["offset_m"] + s["position_m"], first["u"]), (s["offset_m"] + first["length_m"] - s["position_m"], first["v"])]
    heapq.heapify(heap)
    best: dict = {}
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for v, w in out[n]:
            if v not in best:
                heapq.heappush(heap, (d + w, v))
    return pd.DataFrame({"region_id": key[0], "node": list(best), "dist": list(best.values())})


def station_distances(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """region_id, node, dist from each station over its own edges.

    ``stations``: region_id, edge_id, offset_m, position_m (snapped); ``edges``:
    region_id, edge_id, u, v, length_m, the window around each station.
    """
    stations, edges = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (stations, edges))  # they may share a lineage
    return stations.groupBy("region_id").cogroup(edges.groupBy("region_id")).applyInPandas(_dijkstra, "region_id long, node long, dist double")


def network_distance(offset: Column, position: Column, length: Column, du: Column, dv: Column, same_edge: Column | None = None, station_offset: Column | None = None, station_position: Column | None = None, reach: float = 100.0) -> Column:
    """Struct (distance_m, status) of a snapped point: the better end of its edge, or straight along it from a station on the same edge."""
    far = F.lit(float("inf"))
    best = F.least(F.coalesce(du, far) + position, F.coalesce(dv, far) + length - position)
    if same_edge is not None:
        best = F.when(same_edge, F.least(best, station_offset + F.abs(position - station_position))).otherwise(best)
    status = F.when(offset > reach, "connector_over_limit").when(best == far, "disconnected").otherwise("connected")
    return F.struct(F.when(status == "connected", best + offset).alias("distance_m"), status.alias("status"))


def reachable_intervals(length: Column, du: Column, dv: Column, budget: Column, station_offset: Column | None = None, station_position: Column | None = None) -> Column:
    """Array of (low, high) of an edge that lies within the budget from either end, or from a station on it, merged where they touch."""
    far = F.lit(float("inf"))
    zero = F.lit(0.0)

    def span(low: Column, high: Column) -> Column:
        return F.struct(F.greatest(low, zero).alias("low"), F.least(high, length).alias("high"))

    parts = [span(zero, budget - F.coalesce(du, far)), span(length - budget + F.coalesce(dv, far), length)]
    kept = F.filter(F.array(*parts), lambda s: s["high"] > s["low"])
    if station_offset is not None:
        r = budget - station_offset
        own = F.filter(F.array(span(station_position - r, station_position + r)), lambda s: F.coalesce(r >= 0, F.lit(False)))
        kept = F.concat(kept, own)
    empty = F.array().cast("array<struct<low:double,high:double>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(s["low"] <= last["high"], F.lit(False))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], s["high"]).alias("high"))))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(kept), empty, add)


def merge_groups(rows: DataFrame, distance: float) -> DataFrame:
    """Stations joined from groups of one name that chain within ``distance``: key, name, x, y, lines, members.

    ``rows``: station_row, group, name, line, operator, x, y.  A group's name is
    its commonest (equal ones: the least), its place the mean of its rows.
    """
    from loxodrome.functions.text import display_line
    from loxodrome.operators.records import with_row_index

    base = with_row_index(rows.groupBy("group").agg(F.mode("name", True).alias("name"), F.avg("x").alias("x"), F.avg("y").alias("y")), "group", name="id").withColumn("id", F.col("id") + 1)
    near = within_distance(base.select("id", "name", "x", "y"), base.select("id", "name", "x", "y"), distance).where("left_name = right_name AND left_id < right_id")
    joined = connected_components(near, "left_id", "right_id")
    merged = base.join(joined, base["id"] == joined["node"], "left").select("group", F.coalesce("component", "id").alias("merged"), F.col("name").alias("group_name"), "id")
    line = F.struct(display_line(F.col("line")).alias("line"), "operator")
    out = rows.join(merged, "group").groupBy("merged").agg(
        F.min(F.struct("id", "group_name")).alias("first"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_join(F.array_sort(F.collect_set(F.col("group").cast("string"))), "|").alias("key"),
        F.array_sort(F.collect_set(F.when(F.coalesce(F.col("line"), F.lit("")) != "", line))).alias("lines"), F.array_sort(F.collect_list("station_row")).alias("members"),
    )
    return out.select("key", F.col("first.group_name").alias("name"), "x", "y", "lines", "members")
