"""Sparse counts, weights, embeddings, neighbours and clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def term_counts(rows: DataFrame, region: str, term: str, weight: Column | None = None) -> DataFrame:
    """region, term, n: counts, or sums of weights (zero ones left out)."""
    n = F.count("*") if weight is None else F.sum(weight)
    out = rows.groupBy(F.col(region).alias("region_id"), F.col(term).alias("term")).agg(n.alias("n"))
    return out.where("n <> 0")


def frequent_terms(counts: DataFrame, least: int = 5) -> DataFrame:
    """term, df, kept: in how many regions each term is found, and whether in enough."""
    return counts.groupBy("term").agg(F.count_distinct("region_id").alias("df")).withColumn("kept", F.col("df") >= least)


def tfidf(counts: DataFrame, fit: Column | None = None) -> DataFrame:
    """region_id, term, weight: n * (ln((1 + regions) / (1 + df)) + 1), each region's vector of length one.

    ``fit`` picks the regions whose frequencies count; terms of others only get df 0.
    """
    base = counts if fit is None else counts.where(fit)
    df = base.groupBy("term").agg(F.count_distinct("region_id").alias("df"))
    total = F.broadcast(base.agg(F.count_distinct("region_id").alias("_n")))  # one row
    idf = F.log((1 + F.col("_n")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    raw = counts.join(df, "term", "left").join(total).withColumn("w", F.col("n") * idf)
    return raw.select("region_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("region_id")))).alias("weight"))


def cosine_parts(weights: DataFrame, a: object, b: object) -> DataFrame:
    """Each common term's part of the cosine of two regions."""
    x, y = (weights.where(F.col("region_id") == r).select("term", F.col("weight").alias(n)) for r, n in ((a, "wa"), (b, "wb")))
    return x.join(y, "term").select("term", (F.col("wa") * F.col("wb")).alias("part"))


def shared_items(rows: DataFrame, region: str, item: str, each: int = 1000) -> DataFrame:
    """Pairs of regions a < b with the number of items in both and their Jaccard.

    Each pair with a common item is in the result, so work is that of the result
    and more for pairs with many.  An item of more than ``each`` regions meets
    itself in as many tasks as it has thousands of them.
    """
    own = rows.select(F.col(region).alias("r"), F.col(item).alias("i")).where("r IS NOT NULL AND i IS NOT NULL").distinct()
    size = own.groupBy("r").agg(F.count("*").alias("n"))
    spread = own.groupBy("i").agg(F.ceil(F.count("*") / each).cast("int").alias("salts"))
    salted = own.join(spread, "i")
    left = salted.select(F.col("r").alias("a"), "i", F.pmod(F.xxhash64("r"), "salts").cast("int").alias("salt"))
    right = salted.select(F.col("r").alias("b"), "i", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = left.join(right, ["i", "salt"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return joined.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def _sums(batches, names: list[str], shift: np.ndarray):  # noqa: ANN001, ANN202
    width = len(names)
    total = np.zeros((width + 1, width))
    for pdf in batches:
        x = pdf[names].to_numpy(float) - shift
        total[:width] += x.T @ x
        total[width] += x.sum(axis=0)
    i, j = np.indices(total.shape)
    yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})


def gram_matrix(dense: DataFrame, columns: Sequence[str], shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Products of all pairs of columns (less ``shift``), and their sums; columns squared numbers a task are added up."""
    names, width = list(columns), len(columns)
    shift = np.zeros(width) if shift is None else shift
    found = dense.select(*names).mapInPandas(lambda it: _sums(it, names, shift), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros((width + 1, width))
    m[found.i, found.j] = found.v
    return (m[:width] + m[:width].T) / 2, m[width]


def _leading(m: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """First eigenvectors (as columns, their largest entry positive) and all eigenvalues, greatest first."""
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1]
    v = vectors[:, order[:dim]]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(dim)]), values[order]


def singular_vectors(dense: DataFrame, columns: Sequence[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and values of an uncentred matrix; only its columns' Gram matrix comes to the driver (columns squared).

    Signs: each vector's largest entry is positive.
    """
    if not 1 <= dim < len(columns):
        raise ValueError("dim must be at least 1 and below the number of columns")
    v, values = _leading(gram_matrix(dense, columns)[0], dim)
    return v, np.sqrt(np.maximum(values[:dim], 0))


def project(dense: DataFrame, columns: Sequence[str], vectors: np.ndarray, keep: Sequence[str], normalise: bool = True) -> DataFrame:
    """``keep`` and the array ``embedding``: the row times each vector, brought to length one."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    axes = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(a)) for a in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for axis in vectors.T]
    out = dense.select(*keep, F.array(*axes).alias("embedding"))
    if not normalise:
        return out
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    return out.withColumn("embedding", F.transform("embedding", lambda v: v / F.when(length > 0, length).otherwise(1.0)))


def principal_components(dense: DataFrame, columns: Sequence[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (as columns) and explained shares of the centred columns' covariance; columns squared numbers come to the driver."""
    row = dense.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if not row["n"]:
        raise ValueError("no rows")
    m, sums = gram_matrix(dense, columns, np.array([row[f"m{i}"] for i in range(len(columns))]))
    v, values = _leading((m - np.outer(sums, sums) / row["n"]) / row["n"], dim)
    return v, values[:dim] / values.sum()


def vector_distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    if metric == "cosine":
        dot, aa, bb = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y)), total(F.transform(a, lambda x: x.cast("double") * x)), total(F.transform(b, lambda x: x.cast("double") * x))
        return 1 - F.try_divide(dot, F.sqrt(aa) * F.sqrt(bb))
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    raise ValueError("metric must be cosine or euclidean")


#: Rows of a tile, and of the part of it whose distances are held at once.
_TILE, _PART = 8192, 256


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        n = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        return 1 - x @ y.T / np.where(n > 0, n, np.nan)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _tile_top(left: pd.DataFrame, right: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """Of one tile pair, the k nearest of each query."""
    out = [pd.DataFrame({"query": [], "id": [], "distance": []}).astype({"query": "int64", "id": "int64", "distance": "float64"})]
    if len(left) and len(right):
        right = right.sort_values("id")
        b, i = np.stack(right["v"].to_numpy()).astype(float), right["id"].to_numpy()
        for at in range(0, len(left), _PART):
            part = left.iloc[at : at + _PART]
            q = part["id"].to_numpy()
            d = _distances(np.stack(part["v"].to_numpy()).astype(float), b, metric)
            d[(q[:, None] == i[None]) | np.isnan(d)] = np.inf
            near = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]  # equal ones by id
            found = pd.DataFrame({"query": np.repeat(q, near.shape[1]), "id": i[near].ravel(), "distance": np.take_along_axis(d, near, axis=1).ravel()})
            out.append(found[np.isfinite(found.distance)])
    return pd.concat(out)


def _tiled(left: DataFrame, right: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into tiles of about ``size`` rows, each tile of one copied to all of the other: columns ta, tb name the pair."""
    counts = [max(1, -(-side.count() // size)) for side in (left, right)]
    own = [F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in counts]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in counts]
    return left.withColumn("ta", own[0]).withColumn("tb", every[1]), right.withColumn("tb", own[1]).withColumn("ta", every[0])


def top_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", tile: int = _TILE) -> DataFrame:
    """query, id, distance, rank: the k nearest other vectors, exactly; equal distances by id.

    A stated query set meets all rows tile by tile, each of at most about
    ``tile`` rows whatever the table's size, and a tile pair returns k rows a
    query.  Null vectors are neither asked for nor found.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    rows, asked = (df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for df in (vectors, queries if queries is not None else vectors))
    left, right = _tiled(asked, rows, tile)
    found = left.groupBy("ta", "tb").cogroup(right.groupBy("ta", "tb")).applyInPandas(lambda key, a, b: _tile_top(a, b, k, metric), "query long, id long, distance double")
    order = Window.partitionBy("query").orderBy(F.round("distance", 12), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retention(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """query, retention: the share of a query's first k neighbours that both rankings have."""
    both = first.where(F.col("rank") <= k).select("query", "id").join(second.where(F.col("rank") <= k).select("query", "id", F.lit(1).alias("_hit")), ["query", "id"], "left")
    return both.groupBy("query").agg((F.count("_hit") / F.lit(float(k))).alias("retention"))


def ordered_labels(frame: DataFrame, label: str, value: str, key: str) -> DataFrame:
    """``frame`` with cluster: labels renumbered from 1 by median value, then least key."""
    groups = frame.groupBy(label).agg(F.median(value).alias("_m"), F.min(key).alias("_k"))
    named = groups.withColumn("cluster", F.row_number().over(Window.orderBy("_m", "_k"))).select(label, "cluster")  # one row a cluster
    return frame.join(named, label)


def silhouettes(points: DataFrame, label: str, vector: str = "embedding", key: str = "vec_id", tile: int = _TILE) -> DataFrame:
    """key, label, silhouette by Euclidean distance, exactly; null for a cluster of one.

    All pairs are needed by definition; sums per point and cluster are taken tile
    pair by tile pair, each of at most about ``tile`` rows a side whatever the
    table's size.
    """
    return silhouettes_of(points, [label], vector, key, tile).select(key, F.col("label").alias(label), "silhouette")


def silhouettes_of(points: DataFrame, labels: Sequence[str], vector: str = "embedding", key: str = "vec_id", tile: int = _TILE) -> DataFrame:
    """key, labelling (a name of ``labels``), label, silhouette: as silhouettes, with each distance taken once for all labellings."""
    rows = points.select(F.col(key).cast("long").alias("id"), F.array(*[F.col(c).cast("long") for c in labels]).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    names = list(labels)

    def sums(_, a, b):  # noqa: ANN001, ANN202
        out = [pd.DataFrame({"id": [], "w": [], "c": [], "other": [], "s": [], "n": []}).astype({"id": "int64", "w": "int64", "c": "int64", "other": "int64", "s": "float64", "n": "int64"})]
        if len(a) and len(b):
            y, of_b = np.stack(b["v"].to_numpy()), np.stack(b["c"].to_numpy())
            kinds = [np.unique(of_b[:, w], return_inverse=True) for w in range(len(names))]
            members = [np.eye(len(clusters))[of] for clusters, of in kinds]
            for at in range(0, len(a), _PART):
                part = a.iloc[at : at + _PART]
                ids, of_a = part["id"].to_numpy(), np.stack(part["c"].to_numpy())
                far = _distances(np.stack(part["v"].to_numpy()), y, "euclidean")
                for w, ((clusters, of), member) in enumerate(zip(kinds, members, strict=True)):
                    n = len(clusters)
                    out.append(pd.DataFrame({"id": np.repeat(ids, n), "w": w, "c": np.repeat(of_a[:, w], n), "other": np.tile(clusters, len(part)), "s": (far @ member).ravel(), "n": np.tile(np.bincount(of), len(part))}))
        return pd.concat(out)

    left, right = _tiled(rows, rows, tile)
    met = left.groupBy("ta", "tb").cogroup(right.groupBy("ta", "tb")).applyInPandas(sums, "id long, w long, c long, other long, s double, n long")
    each = met.groupBy("id", "w", "c", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own, near = F.max(F.when(F.col("c") == F.col("other"), F.try_divide("s", F.col("n") - 1))), F.min(F.when(F.col("c") != F.col("other"), F.col("s") / F.col("n")))
    one = each.groupBy("id", "w", "c").agg(own.alias("a"), near.alias("b"))
    named = F.array(*[F.lit(n) for n in names])[F.col("w").cast("int")]
    return one.select(F.col("id").alias(key), named.alias("labelling"), F.col("c").alias("label"), F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")).alias("silhouette"))


def separation(points: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin of a labelling."""
    means = points.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    center = points.agg(*[F.avg(c).alias(f"_g{i}") for i, c in enumerate(columns)])  # one row
    inner = points.join(means, label).withColumn("_d2", sum(((F.col(c) - F.col(f"_m{i}")) ** 2 for i, c in enumerate(columns)), F.lit(0.0)))
    spread = inner.groupBy(label).agg(F.avg(F.sqrt("_d2")).alias("_s"), F.sum("_d2").alias("_w"))
    both = means.join(spread, label).join(F.broadcast(center))
    between = F.col("n") * sum(((F.col(f"_m{i}") - F.col(f"_g{i}")) ** 2 for i in range(len(columns))), F.lit(0.0))
    k, n = F.count("*"), F.sum("n")
    ch = both.agg((F.try_divide(F.sum(between), k - 1) / F.try_divide(F.sum("_w"), n - k)).alias("calinski_harabasz"))
    a, b = both.select(*[F.col(c).alias(f"a_{c}") for c in both.columns]), both.select(*[F.col(c).alias(f"b_{c}") for c in both.columns])
    ratio = (F.col("a__s") + F.col("b__s")) / F.sqrt(sum(((F.col(f"a__m{i}") - F.col(f"b__m{i}")) ** 2 for i in range(len(columns))), F.lit(0.0)))
    worst = a.join(b, F.col(f"a_{label}") != F.col(f"b_{label}")).groupBy(f"a_{label}").agg(F.max(ratio).alias("_r"))  # one row a cluster
    return ch.join(worst.agg(F.avg("_r").alias("davies_bouldin")))


def kmeans(points: DataFrame, k: int, seeds: Sequence[int], vector: str = "features", max_iter: int = 500, tol: float = 1e-4) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Labels of the seed with the least cost (column cluster), and each seed's cost."""
    models = kmeans_models(points, [k], seeds, vector, max_iter, tol)
    costs = [(seed, models[k, seed].summary.trainingCost) for seed in seeds]
    return models[k, min(costs, key=lambda c: c[1])[0]].transform(points), costs


def kmeans_models(points: DataFrame, ks: Sequence[int], seeds: Sequence[int], vector: str = "features", max_iter: int = 500, tol: float = 1e-4) -> dict:
    """A model for each number of clusters and seed; fits run side by side, so their small jobs fill the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans

    cached = points.persist()
    try:
        cached.count()

        def fit(kind: tuple[int, int]):  # noqa: ANN202
            return KMeans(k=kind[0], seed=kind[1], featuresCol=vector, predictionCol="cluster", maxIter=max_iter, tol=tol).fit(cached)

        kinds = [(k, seed) for k in ks for seed in seeds]
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(kinds, pool.map(fit, kinds), strict=True))
    finally:
        cached.unpersist()


def _near_means(x: np.ndarray, square: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the first nearest center, and its distance to that and to the next."""
    d = (centers * centers).sum(axis=1)[:, None] - 2 * centers @ x.T
    label, first, second = np.zeros(len(x), np.int64), d[0].copy(), np.full(len(x), np.inf)
    for j in range(1, len(d)):
        nearer = d[j] < first
        second = np.where(nearer, first, np.minimum(second, d[j]))
        first = np.where(nearer, d[j], first)
        label[nearer] = j
    return label, np.sqrt(np.maximum(first + square, 0)), np.sqrt(np.maximum(second + square, 0))


def _starts(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Greedy k-means++: each further center is the best of some rows drawn by their squared distance to the ones before."""
    r = np.random.default_rng(seed)
    tries, most, at = 2 + int(np.log(k)), weight.cumsum(), []
    square, left = (x * x).sum(axis=1), None
    while len(at) < min(k, len(x)):
        drawn = np.searchsorted(most, r.random(tries if at else 1) * most[-1], side="right").clip(0, len(x) - 1)
        away = np.maximum(square[drawn, None] + square - 2 * x[drawn] @ x.T, 0)
        away[np.arange(len(drawn)), drawn] = 0
        away = away if left is None else np.minimum(left, away)
        best = int((away @ weight).argmin())
        at.append(int(drawn[best]))
        left = away[best]
        left[at] = 0
        most = (weight * left).cumsum()
        if most[-1] <= 0:
            break
    return x[at]


def lloyd(x: np.ndarray, weight: np.ndarray, centers: np.ndarray, max_iter: int = 500, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Labels and cost of Lloyd's iterations from ``centers``, until none moves by more than ``tol``.

    Rows whose bounds show that their nearest center cannot have changed are not
    measured again; labels are those of plain iterations.  A center without rows stays.
    """
    square = (x * x).sum(axis=1)
    label, upper, lower = _near_means(x, square, centers)
    k, sums = len(centers), None
    for turn in range(max_iter):
        if sums is None or turn % 16 == 0:  # anew, so that rounding errors don't add up
            share = (label == np.arange(k)[:, None]) * weight
            sums, sizes = share @ x, share.sum(axis=1)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], centers)
        way = np.sqrt(((moved - centers) ** 2).sum(axis=1))
        centers = moved
        if (way <= tol).all():
            break
        upper += way[label]
        first, second = np.sort(np.append(way, 0))[[-1, -2]]
        lower -= np.where(way == first, second if k > 1 else 0, first)[label]  # the others move as far at most
        open_ = np.flatnonzero(upper >= lower - 1e-9)
        if len(open_):
            part = x[open_]
            found, upper[open_], lower[open_] = _near_means(part, square[open_], centers)
            change = np.flatnonzero(found != label[open_])
            if len(change) > len(x) // 8:
                sums = None
            elif len(change):
                w, old, new = weight[open_[change]], label[open_[change]], found[change]
                turned = ((new == np.arange(k)[:, None]) * 1.0 - (old == np.arange(k)[:, None])) * w
                sums, sizes = sums + turned @ part[change], np.maximum(sizes + turned.sum(axis=1), 0)
            label[open_] = found
    label, away, _ = _near_means(x, square, centers)
    return label, float(weight @ (away * away))


def _nearest_clusters(mean: np.ndarray, size: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked cluster the other whose union with it raises the sum of squares least, and that rise."""
    square = (mean * mean).sum(axis=1)
    to, least = np.zeros(len(asked), np.int64), np.full(len(asked), np.inf)
    order = np.argsort(size[asked], kind="stable")
    for at in range(0, len(mean), _TILE // 2):
        tile = slice(at, at + _TILE // 2)
        other = np.column_stack([-2 * mean[tile], np.ones(len(square[tile])), square[tile]]).T
        for i in range(0, len(order), _PART):
            part = order[i : i + _PART]
            q = asked[part]
            rise = np.column_stack([mean[q], square[q], np.ones(len(q))]) @ other
            own = size[q]
            if own[0] == own[-1]:
                rise *= size[tile] / (own[0] + size[tile])
            else:
                rise /= 1 + np.divide.outer(own, size[tile])
            here = np.flatnonzero((q >= at) & (q < at + rise.shape[1]))
            rise[here, q[here] - at] = np.inf
            j = rise.argmin(axis=1)
            d = rise[np.arange(len(q)), j]
            less = d < least[part]
            to[part[less]], least[part[less]] = j[less] + at, d[less]
    away = mean[asked] - mean[to]  # the same both ways, unlike products of tiles
    return to, (away * away).sum(axis=1) * size[asked] * size[to] / (size[asked] + size[to])


def _by_tasks(spark, few: int = 50_000_000):  # noqa: ANN001, ANN202
    """_nearest_clusters in tasks, where more than ``few`` pairs are to be measured."""
    context = spark.sparkContext

    def near(mean: np.ndarray, size: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(asked) * len(mean) <= few:
            return _nearest_clusters(mean, size, asked)
        order = np.argsort(size[asked], kind="stable")
        most = (4 if len(asked) * len(mean) > 8 * few else 1) * context.defaultParallelism  # a task has the tiles of all clusters to make
        parts = np.array_split(asked[order], min(len(asked), most))
        shared = context.broadcast((mean, size))
        found = context.parallelize(parts, len(parts)).map(lambda part: _nearest_clusters(*shared.value, part)).collect()
        shared.destroy()
        to, rise = np.empty(len(asked), np.int64), np.empty(len(asked))
        to[order], rise[order] = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return to, rise

    return near


def ward(x: np.ndarray, ks: Sequence[int], weight: np.ndarray | None = None, near=_nearest_clusters) -> dict[int, np.ndarray]:  # noqa: ANN001
    """Labels 0 to k-1 of Ward's agglomeration for each k, numbered by first row; ``weight``: how many rows each stands for.

    In rounds: all pairs of clusters that are each other's nearest are merged at
    once, and only clusters whose nearest is gone look again.  It holds the means
    and no matrix of their distances; merges are then put in order of height.
    """
    n = len(x)
    mean, size, row = x - x.mean(axis=0) if n else x, np.ones(n) if weight is None else weight.astype(float), np.arange(n)
    to, rise, merges = np.full(n, -1), np.full(n, np.inf), []
    while len(row) > 1:
        asked = np.flatnonzero(to < 0)
        to[asked], rise[asked] = near(mean, size, asked)
        i = np.flatnonzero((to[to] == np.arange(len(to))) & (np.arange(len(to)) < to))
        if not len(i):  # ties went round in a circle
            i = rise.argmin(keepdims=True)
        i, j = np.minimum(i, to[i]), np.maximum(i, to[i])
        merges.append((rise[i], row[i], row[j]))
        both = size[i] + size[j]
        mean[i] = (mean[i] * size[i, None] + mean[j] * size[j, None]) / both[:, None]
        size[i] = both
        touched, left = np.zeros(len(to), bool), np.ones(len(to), bool)
        touched[i] = touched[j] = True
        left[j] = False
        to = np.where(touched | touched[to], -1, (left.cumsum() - 1)[to])
        mean, size, row, to, rise = mean[left], size[left], row[left], to[left], rise[left]
    heights, a, b = (np.concatenate([m[i] for m in merges]) if merges else np.zeros(0, int) for i in range(3))
    order = np.argsort(heights, kind="stable")
    return _cut_tree(n, a[order], b[order], ks)


def _cut_tree(n: int, a: np.ndarray, b: np.ndarray, ks: Sequence[int]) -> dict[int, np.ndarray]:
    """Labels for each k after the first n - k merges of the clusters of rows a and b."""
    parent, done, out = list(range(n)), 0, {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in sorted(ks, reverse=True):
        upto = max(done, n - k, 0)
        for i, j in zip(a[done:upto].tolist(), b[done:upto].tolist(), strict=True):
            i, j = sorted((root(i), root(j)))
            parent[j] = i
        done = upto
        top = np.array(parent, dtype=np.int64)
        while (top != top[top]).any():
            top = top[top]
        out[k] = np.unique(top, return_inverse=True)[1]
    return {k: out[k] for k in ks}


def _rand(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Adjusted Rand index of two labellings of kinds of ``weight`` rows, as stats.adjusted_rand."""

    def pairs(n: np.ndarray) -> float:
        return (n * (n - 1) / 2).sum()

    table = np.bincount(a * (int(b.max()) + 1) + b, weight, (int(a.max()) + 1) * (int(b.max()) + 1)).reshape(int(a.max()) + 1, -1)
    both, rows, cols, every = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), pairs(weight.sum())
    expected = rows * cols / every if every else 0.0
    most = (rows + cols) / 2
    return float((both - expected) / (most - expected)) if every and most != expected else 1.0


def _separated(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float | None, float | None, int, int]:
    """Calinski-Harabasz and Davies-Bouldin of a labelling, as in separation, and the sizes of its smallest and largest cluster."""
    _, label = np.unique(label, return_inverse=True)
    share = (label == np.arange(label.max() + 1)[:, None]) * weight
    size = share.sum(axis=1)
    mean, k, n = share @ x / size[:, None], len(size), size.sum()
    away = sum((x[:, i] - mean[label, i]) ** 2 for i in range(x.shape[1]))
    inner, spread = float(weight @ away), share @ np.sqrt(away) / size
    between = float(size @ ((mean - weight @ x / n) ** 2).sum(axis=1))
    apart = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.nan)
    ch = float(between / (k - 1) / (inner / (n - k))) if k > 1 and n > k and inner > 0 else None
    db = float(np.nanmax((spread[:, None] + spread[None]) / np.where(apart > 0, apart, np.nan), axis=1).mean()) if k > 1 and (apart[~np.eye(k, dtype=bool)] > 0).all() else None
    return ch, db, int(size.min()), int(size.max())


def _silhouette_sums(x: np.ndarray, weight: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the silhouettes of the rows, and of how many they are, in each of the labellings (rows of ``labels``); equal to those of silhouettes."""
    starts = np.concatenate([[0], np.cumsum(labels.max(axis=1) + 1)])
    sizes = np.concatenate([np.bincount(label, weight, b - a) for label, a, b in zip(labels, starts, starts[1:], strict=False)])
    square, out = (x * x).sum(axis=1), np.zeros((len(labels), 2))
    for i in range(0, len(rows), _PART):
        q = rows[i : i + _PART]
        sums = np.zeros((len(q), starts[-1]))
        for at in range(0, len(x), _TILE // 2):
            tile = np.arange(at, min(at + _TILE // 2, len(x)))
            member = np.zeros((len(tile), starts[-1]))
            for label, a in zip(labels, starts, strict=False):
                member[np.arange(len(tile)), a + label[tile]] = weight[tile]
            far = x[q] @ (-2 * x[tile].T)
            far += square[q, None]
            far += square[tile]
            np.sqrt(np.maximum(far, 0, out=far), out=far)
            here = np.flatnonzero((q >= at) & (q <= tile[-1]))
            far[here, q[here] - at] = 0
            sums += far @ member
        for w, (label, a, b) in enumerate(zip(labels, starts, starts[1:], strict=False)):
            own, each = (np.arange(len(q)), label[q]), np.arange(b - a)
            n = sizes[a:b]
            with np.errstate(divide="ignore", invalid="ignore"):
                inner = sums[:, a:b][own] / (n[label[q]] - 1)
                outer = np.where((each == label[q][:, None]) | (n == 0), np.inf, sums[:, a:b] / n).min(axis=1)
                s = (outer - inner) / np.maximum(inner, outer)
            known = (n[label[q]] > 1) & np.isfinite(outer) & np.isfinite(s)
            out[w] += (weight[q] * np.where(known, s, 0)).sum(), weight[q][known].sum()
    return out


def compare_k(points: DataFrame, ks: Sequence[int], seeds: Sequence[int], columns: Sequence[str], key: str, max_iter: int = 500, tol: float = 1e-4) -> DataFrame:
    """Per number of clusters: cost, mean silhouette, Calinski-Harabasz, Davies-Bouldin, least and greatest size, least and mean adjusted Rand index of the seeds to the first, and that of Ward's labels to the best.

    Equal rows are one kind and stay together; every kind counts as often as it
    has rows.  The kinds, in order of their first keys, go to every task: a task
    fits one number of clusters from one seed (k-means++ starts), so fits need no
    job a step; Ward's nearest clusters and the silhouettes are dealt by rows.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark, ks, seeds = points.sparkSession, list(ks), list(seeds)
    context = spark.sparkContext
    kinds = points.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    kinds = kinds.groupBy(*[f"_{i}" for i in range(len(columns))]).agg(F.min("_key").alias("_key"), F.count("*").cast("double").alias("_n")).toArrow().sort_by("_key")
    x, n = np.column_stack([kinds[f"_{i}"].to_numpy() for i in range(len(columns))]), kinds["_n"].to_numpy()
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("compare_k needs rows, and numbers in all their columns")
    shared = context.broadcast((x, n))

    def fit(kind: tuple[int, int]) -> tuple[tuple[int, int], np.ndarray, float]:
        rows, weight = shared.value
        label, cost = lloyd(rows, weight, _starts(rows, weight, *kind), max_iter, tol)
        return kind, label.astype(np.int32), cost

    wanted = sorted(((k, s) for k in ks for s in seeds), reverse=True)
    with ThreadPoolExecutor(1) as pool:  # agglomeration waits for the driver now and then, fits don't
        agglomerated = pool.submit(ward, x, ks, n, _by_tasks(spark))
        fits = {kind: (label.astype(np.int64), cost) for kind, label, cost in context.parallelize(wanted, len(wanted)).map(fit).collect()}
        best = {k: min(seeds, key=lambda s, k=k: fits[k, s][1]) for k in ks}
        labels = np.stack([fits[k, best[k]][0] for k in ks])
        parts = np.array_split(np.arange(len(x)), min(len(x), 4 * context.defaultParallelism))
        chosen = context.broadcast(labels)
        apart = sum(context.parallelize(parts, len(parts)).map(lambda rows: _silhouette_sums(*shared.value, chosen.value, rows)).collect())
        agglomerated = agglomerated.result()
    shared.destroy()
    chosen.destroy()
    out = []
    for w, k in enumerate(ks):
        label, cost = fits[k, best[k]]
        agree = [_rand(fits[k, seeds[0]][0], fits[k, s][0], n) for s in seeds[1:]] or [1.0]
        ch, db, least, most = _separated(x, label, n)
        out.append((k, cost, ch, db, float(apart[w, 0] / apart[w, 1]) if apart[w, 1] else None, least, most, _rand(label, agglomerated[k], n), min(agree), sum(agree) / len(agree)))
    names = ["calinski_harabasz", "davies_bouldin", "silhouette", "smallest", "largest", "ward_rand", "rand_min", "rand_mean"]
    return spark.createDataFrame(out, "k int, cost double, " + ", ".join(f"{c} {'long' if c in ('smallest', 'largest') else 'double'}" for c in names))


def ward_labels(points: DataFrame, columns: Sequence[str], ks: Sequence[int], key: str, most: int = 50_000) -> DataFrame:
    """key and ward_k for each k, of all rows in order of key.

    Agglomeration needs all rows together, so they go to one task; more than
    ``most`` are refused, not sampled.
    """
    if points.count() > most:
        raise ValueError(f"Ward's agglomeration takes at most {most} rows")
    names = list(columns)

    def labels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        found = ward(pdf[names].to_numpy(float), [min(k, len(pdf)) for k in ks])
        return pd.DataFrame({key: pdf[key], **{f"ward_{k}": found[min(k, len(pdf))] for k in ks}})

    return points.select(key, *names, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(labels, f"{key} {dict(points.dtypes)[key]}, " + ", ".join(f"ward_{k} long" for k in ks))


def best_alignment(frame: DataFrame, base: str, current: str, k: int = 3) -> dict[int, int]:
    """Which label of ``current`` stands for which of ``base`` so that most rows agree; k factorial ways of a k x k table."""
    from itertools import permutations

    table = {(r[0], r[1]): r[2] for r in frame.groupBy(base, current).agg(F.count("*")).collect()}  # k squared rows
    a, b = sorted({x for x, _ in table}), sorted({y for _, y in table})
    size = max(len(a), len(b))
    if size > max(k, 8):
        raise ValueError("too many labels to try all ways")
    b += [None] * (size - len(b))
    best = max(permutations(b, len(a)), key=lambda p: sum(table.get((x, y), 0) for x, y in zip(a, p, strict=True)))
    return {y: x for x, y in zip(a, best, strict=True) if y is not None}


def independent_subset(regions: DataFrame, width: float = 1000.0, key: str = "region_id") -> DataFrame:
    """Greedy choice in order of id of squares that don't overlap.

    Rounds: a square is kept once all overlapping ones before it are gone, and
    then removes its neighbours; as many rounds as the longest chain of such
    dependences.  Squares of one place overlap each other and the same others, so
    only the first of them can be kept.
    """
    from loxodrome.operators.spatial import overlapping_squares
    from loxodrome.plans.lineage import cut

    nowhere = F.when(F.col("x").isNull() | F.col("y").isNull(), F.col(key)).alias("_own")
    regions = cut(regions.groupBy("x", "y", nowhere).agg(F.min(key).alias(key)))
    edges = cut(overlapping_squares(regions.select(F.col(key).alias("id"), "x", "y"), width).select("region_a", "region_b"))
    left, kept = cut(regions.select(key)), None
    while True:
        live = edges.join(left.select(F.col(key).alias("region_a")), "region_a", "left_semi").join(left.select(F.col(key).alias("region_b")), "region_b", "left_semi")
        first = left.join(live.select(F.col("region_b").alias(key)), key, "left_anti")
        gone = live.join(first.select(F.col(key).alias("region_a")), "region_a", "left_semi").select(F.col("region_b").alias(key))
        first = cut(first)
        kept = first if kept is None else kept.union(first)
        left = cut(left.join(first, key, "left_anti").join(gone, key, "left_anti"))
        if left.isEmpty():
            return kept
