"""The sweep over numbers of clusters: whole tables, few jobs, the same figures as the plain operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loxodrome.operators import stats, vectors


def blobs(each=15, seed=4):
    return np.concatenate([np.random.default_rng(seed).normal(c, 0.5, (each, 3)) for c in (0, 5, 9)])


def test_sweep_takes_large_tables_in_few_jobs(spark):
    x, times = blobs(), 1200
    kinds = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(i=range(len(x))))
    rows = kinds.join(spark.range(times).withColumnRenamed("id", "t")).select((F.col("t") * len(x) + F.col("i")).alias("id"), "a", "b", "c")
    assert rows.count() > 50_000  # refused before
    spark.sparkContext.setJobGroup("sweep", "sweep")
    got = {r.k: r for r in vectors.compare_k(rows, range(2, 5), range(10), list("abc"), "id").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sweep")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 20  # hundreds before, one or two a step of every fit
    label = np.repeat([0, 1, 2], 15)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    mean = np.stack([x[label == c].mean(axis=0) for c in range(3)])
    inner = ((x - mean[label]) ** 2).sum()
    between = 15 * ((mean - x.mean(axis=0)) ** 2).sum()
    own = (d * (label[:, None] == label)).sum(axis=1) * times / (15 * times - 1)
    other = np.stack([d[:, label == c].mean(axis=1) for c in range(3)], axis=1)
    other[np.arange(45), label] = np.inf
    n, best = 45 * times, got[3]
    assert (best.smallest, best.largest, best.ward_rand) == (15 * times, 15 * times, 1.0)
    assert best.cost == pytest.approx(inner * times) and best.calinski_harabasz == pytest.approx(between * times / 2 / (inner * times / (n - 3)))
    assert best.silhouette == pytest.approx(((other.min(axis=1) - own) / np.maximum(other.min(axis=1), own)).mean())
    assert got.keys() == {2, 3, 4} and got[2].cost > got[3].cost > got[4].cost


def test_bounded_iterations_are_plain_ones():
    r = np.random.default_rng(2)
    x, w = r.normal(size=(400, 5)), r.integers(1, 5, 400).astype(float)
    for k in (1, 2, 6):
        start = vectors._starts(x, w, k, k)
        assert len(np.unique(start, axis=0)) == k
        centers = start.copy()
        for _ in range(500):
            label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.stack([np.average(x[label == c], axis=0, weights=w[label == c]) for c in range(k)])
            done = (np.sqrt(((moved - centers) ** 2).sum(axis=1)) <= 1e-4).all()
            centers = moved
            if done:
                break
        d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        got, cost = vectors.lloyd(x, w, start)
        assert (got == d.argmin(axis=1)).all() and cost == pytest.approx(w @ d.min(axis=1))
    assert len(vectors._starts(x[:3], w[:3], 8, 0)) == 3


def test_ward_of_kinds_and_by_tasks_is_that_of_rows(spark):
    x, times = blobs(20, 7), np.random.default_rng(3).integers(1, 6, 60)
    rows = vectors.ward(np.repeat(x, times, axis=0), [2, 5, 11])
    for near in (vectors._nearest_clusters, vectors._by_tasks(spark, 0)):
        kinds = vectors.ward(x, [2, 5, 11], times, near)
        assert all((np.repeat(kinds[k], times) == rows[k]).all() for k in rows)
    line = vectors.ward(np.arange(16.0)[:, None], [1, 4, 16])  # all nearest ones tie
    assert [len(set(line[k])) for k in (1, 4, 16)] == [1, 4, 16]


def test_figures_of_kinds_are_those_of_rows(spark):
    r = np.random.default_rng(5)
    x, times = r.normal(size=(50, 3)), r.integers(1, 4, 50)
    label, other = r.integers(0, 4, 50), r.integers(0, 3, 50)
    label[0], times[0] = 4, 1  # a cluster of one row
    pdf = pd.DataFrame(np.repeat(np.column_stack([x, label, other]), times, axis=0), columns=[*"abc", "label", "other"]).astype({"label": int, "other": int})
    df = spark.createDataFrame(pdf.assign(vec_id=range(len(pdf)))).withColumn("embedding", F.array("a", "b", "c"))
    n = times.astype(float)
    sums = sum(vectors._silhouette_sums(x, n, np.stack([label, other]), rows) for rows in np.array_split(np.arange(50), 3))
    for got, name in zip(sums, ("label", "other"), strict=True):
        want = vectors.silhouettes(df, name).agg(F.avg("silhouette")).first()[0]
        assert got[0] / got[1] == pytest.approx(want, abs=1e-7)
    row = vectors.separation(df, "label", list("abc")).first()
    ch, db, least, most = vectors._separated(x, label, n)
    assert (ch, db) == pytest.approx((row.calinski_harabasz, row.davies_bouldin)) and (least, most) == (1, max(np.bincount(label, n)))
    assert vectors._rand(label, other, n) == pytest.approx(stats.adjusted_rand(df, "label", "other").first()[0])
    assert vectors._rand(label * 0, label * 0, n) == 1.0 == stats.adjusted_rand(df.withColumn("z", F.lit(0)), "z", "z").first()[0]


def test_sweep_refuses_rows_without_numbers(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "id long, a double, b double")
    for rows in (df, df.where("id > 9")):
        with pytest.raises(ValueError):
            vectors.compare_k(rows, [2], [0], ["a", "b"], "id")
    one = vectors.compare_k(df.where("id = 1"), [2], [0], ["a", "b"], "id").first()
    assert (one.cost, one.smallest, one.largest, one.silhouette, one.ward_rand) == (0.0, 1, 1, None, 1.0)
