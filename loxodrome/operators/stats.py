"""Comparisons of alternative area definitions: distributions, ranks, overlaps, compositions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distributions(frame: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Per group and metric: n, valid_n, undefined_n, mean, median, p90 (linear), maximum."""
    long = frame.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([by], list(metrics), "metric", "value")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9)))
    return long.groupBy(by, "metric").agg(F.count("*").alias("n"), F.count("value").alias("valid_n"), F.count_if(F.col("value").isNull()).alias("undefined_n"), F.avg("value").alias("mean"), q[0].alias("median"), q[1].alias("p90"), F.max("value").alias("maximum"))


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties sharing their mean, as Spearman's coefficient needs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.orderBy(value).rangeBetween(0, 0)) - 1) / 2


def spearman_pairs(frame: DataFrame, by: str, columns: Sequence[str], baseline: str | None = None) -> DataFrame:
    """Rank correlation of each pair of columns per group; null for a constant column; the difference from a baseline group."""
    ranked = frame.select(by, *[F.col(c).cast("double").alias(c) for c in columns])
    ranked = ranked.withColumns({f"_r_{c}": average_rank(c, by) for c in columns})
    pairs = list(combinations(columns, 2))
    sums = ranked.groupBy(by).agg(F.count("*").alias("n"), *[F.when((F.count_distinct(a) > 1) & (F.count_distinct(b) > 1), F.try_divide(F.covar_pop(f"_r_{a}", f"_r_{b}"), F.stddev_pop(f"_r_{a}") * F.stddev_pop(f"_r_{b}"))).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"_p{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])
    out = sums.select(by, "n", F.explode(rows).alias("x")).select(by, "n", "x.*")
    if baseline is None:
        return out
    base = F.max(F.when(F.col(by) == baseline, F.col("rho"))).over(Window.partitionBy("first", "second"))
    return out.withColumn("delta_from_baseline", F.col("rho") - base)


def competition_rank(frame: DataFrame, field: str, key: str, n: int = 10, eligible: Column | None = None) -> DataFrame:
    """Descending ranks 1, 2, 2, 4 of eligible rows with a value: the first n by (value, key), and all that tie with the n-th (in_head tells)."""
    rows = frame.where(F.col(field).isNotNull() & (eligible if eligible is not None else F.lit(True)))
    # Only rows that reach the n-th value are ranked: all greater ones are among them.
    last = F.broadcast(rows.orderBy(F.desc(field), F.asc(key)).limit(n).agg(F.min(field).alias("_last")))  # one row
    kept = rows.join(last, F.col(field) >= F.col("_last")).drop("_last")
    return kept.withColumns({"rank": F.rank().over(Window.orderBy(F.desc(field))).cast("long"), "in_head": F.row_number().over(Window.orderBy(F.desc(field), F.asc(key))) <= n})


def overlap(masks: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], groups: Sequence[str] = (), group: str = "category_group", low: int = 30, weight: str | None = None) -> DataFrame:
    """Per group of rows and pair of mask columns: sizes, shared, union, Jaccard, difference of counts and of compositions (total variation).

    A null mask counts as false.  Jaccard is null for an empty union,
    composition differences if a side is empty.  With ``weight``, a row stands for as
    many.
    """

    def n(mask: Column) -> Column:
        return F.count_if(F.coalesce(mask, F.lit(False))) if weight is None else F.sum(F.when(mask, F.col(weight)).otherwise(0)).cast("long")

    aggs = []
    for i, (a, b) in enumerate(pairs):
        ma, mb = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
        aggs += [n(ma).alias(f"_a{i}"), n(mb).alias(f"_b{i}"), n(ma & mb).alias(f"_s{i}"), n(ma | mb).alias(f"_u{i}")]
        aggs += [F.struct(n(ma & (F.col(group) == g)).alias("a"), n(mb & (F.col(group) == g)).alias("b")).alias(f"_g{i}_{j}") for j, g in enumerate(groups)]
    sums = masks.groupBy(*by).agg(*aggs)

    def row(i: int, a: str, b: str) -> Column:
        na, nb, u = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_u{i}")
        deltas = [F.try_divide(F.col(f"_g{i}_{j}.b").cast("double"), nb) - F.try_divide(F.col(f"_g{i}_{j}.a").cast("double"), na) for j in range(len(groups))]
        tvd = sum((F.abs(d) for d in deltas[1:]), F.abs(deltas[0])) / 2 if deltas else F.lit(None).cast("double")
        return F.struct(
            F.lit(a).alias("first"), F.lit(b).alias("second"), na.alias("n_first"), nb.alias("n_second"), F.col(f"_s{i}").alias("shared"), u.alias("union_n"), F.try_divide(F.col(f"_s{i}").cast("double"), u).alias("jaccard"),
            (nb - na).alias("count_difference"), (u < low).alias("low_poi"), *[(100 * d).alias(f"{g}_difference_pp") for g, d in zip(groups, deltas, strict=True)], tvd.alias("composition_tvd"),
        )

    return sums.select(*by, F.explode(F.array(*[row(i, a, b) for i, (a, b) in enumerate(pairs)])).alias("_row")).select(*by, "_row.*")


def cohorts(comparisons: DataFrame, target: Column, metrics: Sequence[str] = ("jaccard", "count_difference", "composition_tvd")) -> DataFrame:
    """Per pair and cohort (all, union of 30 or more, fewer): quantiles of the metrics, shares above .9 and below .7, mid-rank percentile of the target's Jaccard."""
    each = comparisons.withColumn("cohort", F.explode(F.array(F.lit("all"), F.when(F.col("low_poi"), "union_lt30").otherwise("union_ge30"))))
    each = each.withColumn("_t", F.max(F.when(target, F.col("jaccard"))).over(Window.partitionBy("first", "second", "cohort")))
    stats = []
    for m in metrics:
        q = F.percentile(F.col(m).cast("double"), F.array(*[F.lit(p) for p in (0.0, 0.1, 0.5, 0.9, 1.0)]))
        stats += [q[i].alias(f"{m}_{name}") for i, name in enumerate(("min", "p10", "median", "p90", "max"))]
    below, ties = F.count_if(F.col("jaccard") < F.col("_t")), F.count_if(F.col("jaccard") == F.col("_t"))
    place = F.when(F.max("_t").isNotNull(), F.try_divide(100 * (below + 0.5 * ties), F.count("jaccard")))
    return each.groupBy("first", "second", "cohort").agg(F.count("*").alias("valid_regions"), F.count("jaccard").alias("jaccard_defined"), F.count_if(F.col("jaccard") >= 0.9).alias("ge_09"), F.count_if(F.col("jaccard") < 0.7).alias("lt_07"), *stats, place.alias("target_percentile"))


def distance_histogram(distances: DataFrame, column: str = "distance_m", bins: Sequence[int] = (5, 10, 20, 30, 50, 100)) -> DataFrame:
    """Counts by upper-inclusive bin, empty bins included."""
    label = F.when(F.col(column) <= bins[0], str(bins[0]))
    for b in bins[1:]:
        label = label.when(F.col(column) <= b, str(b))
    names = [*map(str, bins), f">{bins[-1]}"]
    counts = distances.groupBy(label.otherwise(names[-1]).alias("bin")).agg(F.count("*").alias("n"))
    every = distances.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "bin string, position int")
    return every.join(counts, "bin", "left").select("bin", "position", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def adjusted_rand(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings (one row), from the contingency table."""

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    table = frame.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = table.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    rows, cols = (table.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name)) for c, name in ((a, "rows"), (b, "cols")))
    one = both.join(rows).join(cols)  # three rows of one line each
    expected = F.try_divide(F.col("rows") * F.col("cols"), pairs(F.col("n")))
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("adjusted_rand"))


def presence(frame: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    """Per source and attribute: denominator, count and percent present; null where the attribute is never given."""
    long = frame.select(by, *[F.col(c).cast("int").alias(c) for c in flags]).unpivot([by], list(flags), "attribute", "flag")
    return long.groupBy(by, "attribute").agg(F.count("*").alias("denominator"), F.sum("flag").alias("n"), (100.0 * F.sum("flag") / F.count("*")).alias("percent"))


def null_profile(frame: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition."""
    return frame.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
