"""Similarity of regions to a target, by blocks of scaled profile features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.operators.records import with_row_index
from loxodrome.plans.lineage import cut

DENSITY, CONCENTRATION = "poi_density_per_km2", "peak_to_mean_density_250m"
MODES = ("main", "standard", "density_only", "no_density", "no_concentration")


def _values(profiles: DataFrame, shares: Sequence[str]) -> DataFrame:
    """Features of regions that have points; density and concentration as log(1 + x)."""
    logged = [F.log1p(F.col(c).cast("double")).alias(c) for c in (DENSITY, CONCENTRATION)]
    return profiles.where("poi_count > 0").select("region_id", logged[0], *[F.col(c).cast("double").alias(c) for c in shares], logged[1])


def _scaled(values: DataFrame, features: Sequence[str], standard: bool) -> DataFrame:
    """Features less their centre, over their scale: median and interquartile range, or mean and population deviation; a scale of zero is an error."""
    if standard:
        aggs = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features]
    else:
        quarters = {c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in features}
        aggs = [F.struct(q[1].alias("m"), (q[2] - q[0]).alias("s")).alias(c) for c, q in quarters.items()]
    scale = F.broadcast(values.agg(F.struct(*aggs).alias("_p")))  # one row

    def one(c: str) -> Column:
        s = F.when(F.col(f"_p.{c}.s") == 0, F.raise_error(F.lit(f"the scale of {c} is zero")).cast("double")).otherwise(F.col(f"_p.{c}.s"))
        return ((F.col(c) - F.col(f"_p.{c}.m")) / s).alias(c)

    return values.join(scale).select("region_id", *[one(c) for c in features])


def robust_transform(profiles: DataFrame, shares: Sequence[str]) -> DataFrame:
    """Scaled features; the shares together weigh as much as one feature."""
    features = [DENSITY, *shares, CONCENTRATION]
    z = _scaled(_values(profiles, shares), features, False)
    return z.select("region_id", *[(F.col(c) / F.sqrt(F.lit(float(len(shares))))).alias(c) if c in shares else F.col(c) for c in features])


def overlap_audit(regions: DataFrame, target: object, width: float = 1000.0) -> DataFrame:
    """Of each region's square with the target's: distance of centres, common area, and whether it is kept out of the main ranking."""
    t = F.broadcast(regions.where(F.col("region_id") == target).select(F.col("x").alias("_tx"), F.col("y").alias("_ty")).limit(1))  # one row
    dx, dy = F.abs(F.col("x") - F.col("_tx")), F.abs(F.col("y") - F.col("_ty"))
    area = F.greatest(F.lit(width) - dx, F.lit(0.0)) * F.greatest(F.lit(width) - dy, F.lit(0.0))
    return regions.join(t).select("region_id", F.hypot(dx, dy).alias("center_distance_m"), area.alias("overlap_m2"), (area > 0).alias("excluded_from_main"))


def rank_regions(profiles: DataFrame, regions: DataFrame, target: object, shares: Sequence[str], mode: str = "main", width: float = 1000.0) -> DataFrame:
    """All other regions with points by their distance to the target: blocks, contributions, audit_rank over all, rank over those that don't overlap it."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    features = [DENSITY, *shares, CONCENTRATION]
    z = _scaled(_values(profiles, shares), features, mode == "standard")
    t = F.broadcast(z.where(F.col("region_id") == target).select(F.struct(*features).alias("_t")).limit(1))  # one row
    square = {c: F.pow(F.col(c) - F.col(f"_t.{c}"), 2) for c in features}
    blocks = {"density": square[DENSITY], "composition": sum((square[c] for c in shares[1:]), square[shares[0]]) / len(shares), "concentration": square[CONCENTRATION]}
    off = {"density_only": ("composition", "concentration"), "no_density": ("density",), "no_concentration": ("concentration",)}.get(mode, ())
    blocks = {k: F.lit(0.0) if k in off else v for k, v in blocks.items()}
    found = z.join(t).where(F.col("region_id") != target).select("region_id", *[v.alias(f"{k}_squared") for k, v in blocks.items()])
    total = F.col("density_squared") + F.col("composition_squared") + F.col("concentration_squared")
    found = found.select("region_id", F.sqrt(total).alias("distance"), *[f"{k}_squared" for k in blocks], *[F.try_divide(F.col(f"{k}_squared"), total).alias(f"{k}_contribution") for k in blocks])
    placed = with_row_index(found.join(overlap_audit(regions, target, width), "region_id"), "distance", "region_id", name="audit_rank", counted={"rank": ~F.col("excluded_from_main")})
    return placed.withColumns({"audit_rank": F.col("audit_rank") + 1, "rank": F.when(~F.col("excluded_from_main"), F.col("rank"))})


def stability(profiles: DataFrame, regions: DataFrame, target: object, shares: Sequence[str], top: int = 10) -> DataFrame:
    """Per mode: how many of the first ``top`` it shares with the main mode, their Jaccard, candidates."""
    profiles, regions = cut(profiles), cut(regions)
    ranked = {m: rank_regions(profiles, regions, target, shares, m).where("rank IS NOT NULL").select("region_id", "rank") for m in MODES}
    main = ranked["main"].where(F.col("rank") <= top).select("region_id", F.lit(True).alias("_main"))
    out = None
    for mode, r in ranked.items():
        both = r.join(main, "region_id", "full").agg(F.count_if((F.col("rank") <= top) & F.col("_main").isNotNull()).alias("top_overlap"), F.count_if((F.col("rank") <= top) | F.col("_main").isNotNull()).alias("_u"), F.count("rank").alias("candidate_count"))
        one = both.select(F.lit(mode).alias("mode"), "top_overlap", F.try_divide(F.col("top_overlap").cast("double"), F.col("_u")).alias("top_jaccard"), "candidate_count")
        out = one if out is None else out.union(one)
    return out


def rank_changes(ranked: DataFrame, main: DataFrame) -> DataFrame:
    """``ranked`` with the main rank and the change from it."""
    return ranked.join(main.select("region_id", F.col("rank").alias("main_rank")), "region_id", "left").withColumn("rank_change", F.col("rank") - F.col("main_rank"))
