"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.plans.lineage import cut

#: Links of whole numbers that one task may take at once; more go through rounds.
FEW = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the links with the least one reachable."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    table = pa.concat_tables(tables)
    nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    x, y = ends[: table.num_rows], ends[table.num_rows :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])
            return
        label = new


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a link; component is the least node reachable.

    Each round hooks every node's larger neighbours to its least neighbour
    (large star), then its smaller ones (small star), and stops when the edges
    no longer change, after about log2 of the longest chain.  Minima are
    pre-aggregated; the joins back are plain equi-joins that AQE can split.  Up to
    FEW links of whole numbers are closed by one task, without rounds.
    Links with a null end and loops are ignored.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    whole = {t for _, t in now.dtypes} == {"bigint"}
    if whole and now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_stars, "node long, component long")
    seen = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == seen or not sign["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = (sign["n"], sign["s"])
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", "m")).distinct())
