"""Geometry derived from the integer keys of the test tables; the same formulas as in ``SQL``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions.categories import display_group

GROUPS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")

#: Common table expressions of the same inputs.
SQL = """
poi AS (SELECT c_custkey AS id, CAST((CAST(c_custkey AS BIGINT) * 7919) % 4000 - 2000 AS DOUBLE) AS x, CAST((CAST(c_custkey AS BIGINT) * 104729) % 4000 - 2000 AS DOUBLE) AS y,
    c_acctbal AS balance, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_mktsegment END AS category,
    CASE WHEN c_custkey % 20 = 0 THEN '__MISSING__' WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN c_mktsegment ELSE '__OTHER__' END AS category_group FROM customer),
station AS (SELECT s_suppkey AS id, s_name AS name, CAST((CAST(s_suppkey AS BIGINT) * 7919) % 4000 - 2000 AS DOUBLE) AS x, CAST((CAST(s_suppkey AS BIGINT) * 104729) % 4000 - 2000 AS DOUBLE) AS y FROM supplier)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinate(key: Column, factor: int) -> Column:
    return ((key.cast("long") * factor) % 4000 - 2000).cast("double")


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, balance, category (null for every twentieth), category_group."""
    key = F.col("c_custkey")
    category = F.when(key % 20 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), coordinate(key, 7919).alias("x"), coordinate(key, 104729).alias("y"), F.col("c_acctbal").alias("balance"), category.alias("category"), display_group(category, {g: [g] for g in GROUPS}).alias("category_group"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, x, y."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_name").alias("name"), coordinate(key, 7919).alias("x"), coordinate(key, 104729).alias("y"))


def lonlat(points: DataFrame) -> DataFrame:
    """``points`` with lon and lat near Tokyo."""
    return points.withColumns({"lon": F.lit(139.58) + F.col("x") * 1.1e-5, "lat": F.lit(35.70) + F.col("y") * 9.0e-6})
