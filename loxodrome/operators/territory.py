"""Territories: rasters of owners, and what areas, people and facilities fall to each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.functions.shapes import clip_to_box
from loxodrome.operators.spatial import least_total, ring_area, within_distance
from loxodrome.plans.lineage import cut


def place_roads(nodes: DataFrame, reach: float, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) and the edges of all pairs within ``reach``, by place: what a raster of the ``k`` nearest points needs.

    Places: node_id (the least there), x, y; edges: u, v, length_m, edge_id, both
    ways where nodes of both ends are the lesser ones of pairs.  ``copies`` is the
    number of nodes or of pairs u < v, at most k: more can't be among the k nearest.
    The pairs of the k least ids of u with the k greatest of v tell it.
    """
    ends = nodes.where("x IS NOT NULL AND y IS NOT NULL")
    place = Window.partitionBy("x", "y")
    ends = ends.withColumns({"_up": F.row_number().over(place.orderBy("node_id")), "_down": F.row_number().over(place.orderBy(F.desc("node_id")))}).where((F.col("_up") <= k) | (F.col("_down") <= k))
    lists = [F.collect_list(F.when(F.col(c) <= k, F.col("node_id"))).alias(n) for c, n in (("_up", "low"), ("_down", "high"))]
    places = cut(ends.groupBy("x", "y").agg(F.min("node_id").alias("node_id"), *lists))
    near = within_distance(places, places, reach).where("left_node_id <> right_node_id")
    pairs = F.aggregate("left_low", F.lit(0), lambda n, i: n + F.size(F.filter("right_high", lambda j: i < j)))
    edges = near.select(F.col("left_node_id").alias("u"), F.col("right_node_id").alias("v"), F.col("distance_m").alias("length_m"), F.xxhash64("left_node_id", "right_node_id").alias("edge_id"), F.least(pairs, F.lit(k)).alias("copies"))
    return places.select("node_id", "x", "y", F.size("low").alias("copies")), edges.where("copies > 0")


def densify(edges: DataFrame, nodes: DataFrame, step: float, copies: bool = False) -> DataFrame:
    """Nodes, and points at most ``step`` apart along each edge, with the better end's distance and owner (equal: that of u).

    ``nodes``: node_id, x, y, dist, owner; ``edges``: edge_id, u, v, length_m; with
    ``copies``, both say how often they stand there (copies).
    """
    if copies:
        nodes, edges = (df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) for df in (nodes, edges))
        points = densify(edges, nodes.where("_copy = 1"), step).where("edge_id IS NOT NULL")
        return nodes.select("x", "y", "dist", "owner", F.lit(None).cast("long").alias("edge_id"), F.col("node_id").alias("j")).unionByName(points)
    ends = [nodes.select(F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("x", "y", "dist", "owner")]) for k in "uv"]
    joined = edges.join(ends[0], "u").join(ends[1], "v")
    n = F.greatest(F.ceil(F.col("length_m") / step) - 1, F.lit(0))
    inner = joined.withColumn("n", n).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    s = F.col("j") * F.col("length_m") / (F.col("n") + 1)
    t = F.col("j") / (F.col("n") + 1)
    a, b = F.col("u_dist") + s, F.col("v_dist") + (F.col("length_m") - s)
    points = inner.select(*[(F.col(f"u_{c}") * (1 - t) + F.col(f"v_{c}") * t).alias(c) for c in "xy"], F.least(a, b).alias("dist"), F.when(a <= b, F.col("u_owner")).otherwise(F.col("v_owner")).alias("owner"), F.col("edge_id"), F.col("j"))
    whole = nodes.select("x", "y", "dist", "owner", F.lit(None).cast("long").alias("edge_id"), F.col("node_id").alias("j"))
    return whole.unionByName(points.withColumn("edge_id", F.col("edge_id").cast("long")).withColumn("j", F.col("j").cast("long")))


def raster(points: DataFrame, x0: float, y0: float, nx: int, ny: int, cell: float, reach: float, k: int = 8) -> DataFrame:
    """row, col, dist, owner of every cell: over the k nearest points in reach of its centre, the least of distance plus offset; null without any."""
    spark = points.sparkSession
    cells = spark.range(nx * ny).select("id", (F.floor(F.col("id") / nx)).alias("row"), (F.col("id") % nx).alias("col"))
    cells = cells.withColumns({"x": F.lit(x0) + (F.col("col") + 0.5) * cell, "y": F.lit(y0) + (F.col("row") + 0.5) * cell})
    named = points.select(F.struct("owner", "dist", "x", "y").alias("id"), "x", "y", "dist")
    found = least_total(cells, named, k, reach, "dist")
    return found.select("row", "col", F.col("total").alias("dist"), F.col("nearest_id.owner").alias("owner"))


def owner_stats(cells: DataFrame, cell_area: float, far: float = 1200.0) -> DataFrame:
    """Per owner: cells, area, mean, median, p90, greatest distance, share of cells beyond ``far``; cells without an owner stay as their own row."""
    q = F.percentile("dist", F.array(F.lit(0.5), F.lit(0.9)))
    return cells.groupBy("owner").agg(F.count("*").alias("cells"), (F.count("*") * F.lit(float(cell_area))).alias("area_m2"), F.avg("dist").alias("mean"), q[0].alias("median"), q[1].alias("p90"), F.max("dist").alias("maximum"), F.try_divide(F.count_if(F.col("dist") > far).cast("double"), F.count("dist")).alias("far_share"))


def allocate(zones: DataFrame, cells: DataFrame, x0: float, y0: float, cell: float, values: Sequence[str], key: str = "zone_id") -> DataFrame:
    """Rectangular zones over raster cells: zone, owner, area_m2 and each value's part by area.

    What lies outside the raster or on cells without an owner is kept under a
    null owner, so every value is conserved.
    """
    span = {c: F.sequence(F.floor((F.col(a) - o) / cell), F.ceil((F.col(b) - o) / cell) - 1) for c, a, b, o in (("col", "west", "east", F.lit(x0)), ("row", "south", "north", F.lit(y0)))}
    parts = zones.withColumn("row", F.explode(span["row"])).withColumn("col", F.explode(span["col"]))
    west, south = F.lit(x0) + F.col("col") * cell, F.lit(y0) + F.col("row") * cell
    area = F.greatest(F.least("east", west + cell) - F.greatest("west", west), F.lit(0.0)) * F.greatest(F.least("north", south + cell) - F.greatest("south", south), F.lit(0.0))
    met = parts.withColumn("area_m2", area).where("area_m2 > 0").join(cells.select("row", "col", "owner", "dist"), ["row", "col"], "left")
    share = F.col("area_m2") / ((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")))
    met = met.withColumns({f"_{v}": F.col(v) * share for v in values})
    moved = [F.sum(F.col(f"_{v}") * F.col("dist")).alias(f"{v}_distance") for v in values]
    return met.groupBy(key, "owner").agg(F.sum("area_m2").alias("area_m2"), *[F.sum(f"_{v}").alias(v) for v in values], *moved)


def weighted_means(parts: DataFrame, weight: str, value: str, by: str = "owner") -> DataFrame:
    """Per owner: sum of weights, and mean of the values by weight (null for none)."""
    return parts.groupBy(by).agg(F.sum(weight).alias("weight"), F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("mean"))


def by_category(points: DataFrame, cells: DataFrame, x0: float, y0: float, cell: float, categories: Sequence[str]) -> DataFrame:
    """Points by owner of their cell: total and one column a category; points off the raster under a null owner."""
    placed = points.withColumns({"col": F.floor((F.col("x") - x0) / cell), "row": F.floor((F.col("y") - y0) / cell)}).join(cells.select("row", "col", "owner"), ["row", "col"], "left")
    return placed.groupBy("owner").agg(F.count("*").alias("total"), *[F.count_if(F.col("category_group") == c).alias(c) for c in categories])


def clip_ring(ring: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> float:
    """Area of a polygon inside a box, one side of the box after another; for outlines that come out of Python already."""
    for axis in (0, 1):
        for bound, sign in ((low[axis], 1.0), (high[axis], -1.0)):
            if not len(ring):
                return 0.0
            d = sign * (ring[:, axis] - bound)
            nd, nring = np.roll(d, -1), np.roll(ring, -1, axis=0)
            out = []
            for p, q, a, b in zip(ring, nring, d, nd, strict=True):
                if a >= 0:
                    out.append(p)
                if (a > 0 > b) or (a < 0 < b):
                    out.append(p + (q - p) * (a / (a - b)))
            ring = np.array(out).reshape(-1, 2)
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2 if len(ring) else 0.0


def clipped_area(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area of a ring (closed or not) inside a box."""
    return F.abs(ring_area(clip_to_box(ring, west, south, east, north)))


def to_arrays(cells: DataFrame, ny: int, nx: int, most: int = 100_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A raster's distances (NaN where undefined) and owners (-1 for none) as arrays on the driver; more than ``most`` cells are refused."""
    if ny * nx > most:
        raise ValueError(f"a raster of more than {most} cells")
    table = cells.where(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1)).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("dist").cast("double"), F.coalesce(F.col("owner").cast("long"), F.lit(-1)).alias("owner")).toArrow()
    at = table["row"].to_numpy() * nx + table["col"].to_numpy()
    dist, owner = np.full(ny * nx, np.nan), np.full(ny * nx, -1, np.int64)
    dist[at], owner[at] = table["dist"].to_numpy(), table["owner"].to_numpy()
    return dist.reshape(ny, nx), owner.reshape(ny, nx)


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    """Arrays as one compressed NPZ file of the driver; an existing file is an error."""
    with open(path, "xb") as out:
        np.savez_compressed(out, **arrays)
