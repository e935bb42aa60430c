"""Category dictionaries and foreign keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def descendants(dictionary: DataFrame, names: Sequence[str], levels: Sequence[str], key: str = "category_id", name: str = "category_name") -> DataFrame:
    """Ids of the categories with these names (any case) and of all below them; ``levels`` are the columns of ancestors."""
    wanted = {n.strip().lower() for n in names}
    if wanted & {"cafe", "café"}:
        wanted |= {"cafe", "café"}
    roots = dictionary.where(F.lower(name).isin(*sorted(wanted))).select(F.col(key).alias("_root"))
    lines = dictionary.select(key, F.explode(F.array(key, *levels)).alias("_root"))
    return lines.join(roots, "_root", "left_semi").select(key).distinct()


def having_any(places: DataFrame, array: str, wanted: DataFrame, key: str) -> DataFrame:
    """Places with one of the wanted ids in an array; never more than once each."""
    exploded = places.select(F.col(key).alias("_k"), F.explode(array).alias("_c")).join(wanted.select(F.col(wanted.columns[0]).alias("_c")), "_c", "left_semi")
    return places.join(exploded.select("_k").distinct(), F.col(key) == F.col("_k"), "left_semi")


def unknown_ids(places: DataFrame, array: str, dictionary: DataFrame, key: str = "category_id") -> DataFrame:
    """Distinct ids in the arrays that the dictionary lacks."""
    return places.select(F.explode(array).alias(key)).where(F.col(key).isNotNull()).join(dictionary.select(key), key, "left_anti").distinct()


def lost_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one stage that the next no longer has."""
    return before.select(*keys).distinct().join(after.select(*keys), list(keys), "left_anti")


def check_references(rows: DataFrame, key: str, targets: str, separator: str = ";") -> DataFrame:
    """References in both directions: (direction, from_key, to_key) of listed targets that don't exist or don't list the row back."""
    links = rows.select(F.col(key).alias("a"), F.explode(F.split(targets, separator)).alias("b")).where("b <> ''")
    missing = links.join(rows.select(F.col(key).alias("b")), "b", "left_anti").select(F.lit("missing").alias("direction"), "a", "b")
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return missing.union(links.join(back, ["a", "b"], "left_anti").select(F.lit("one_way"), "a", "b")).toDF("direction", "from_key", "to_key")
