"""Writers: ordered Parquet, CSV, strict JSON, GeoJSON, and manifests with hashes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet in order of the keys, range-partitioned; an existing path is an error."""
    df.orderBy(*keys).write.mode("errorifexists").parquet(path)


def write_by(df: DataFrame, path: str, key: str) -> None:
    """One folder a key; rows of a key are brought together first, so each is few files."""
    df.repartition(key).write.mode("errorifexists").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str, *keys: str, bom: bool = False) -> None:
    """One CSV part with a header and LF, in order of the keys; for report tables.  With ``bom`` the first column's name carries a byte-order mark."""
    out = df.orderBy(*keys).coalesce(1)
    if bom:
        out = out.withColumnRenamed(out.columns[0], f"﻿{out.columns[0]}")
    out.write.mode("errorifexists").option("header", True).option("lineSep", "\n").option("quoteAll", False).csv(path)


def strict_json(value: object) -> str:
    """JSON without NaN or infinities: they become null."""

    def clean(x: object) -> object:
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, Mapping):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return x

    return json.dumps(clean(value), ensure_ascii=False, indent=2, allow_nan=False)


def geojson(df: DataFrame, lon: Column, lat: Column, properties: Sequence[str]) -> DataFrame:
    """Point features as one JSON text a row (column value); undefined properties are left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def table_digest(df: DataFrame, *keys: str) -> Column:
    """Hash of the rows' ids, independent of order and partitions, as one aggregate that holds a few numbers.

    Each row's SHA-256 counts as eight numbers of 32 bits; their exact
    sums, and the number of rows, are hashed again.
    """
    own = F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    parts = [F.sum(F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    return F.sha2(F.concat_ws(" ", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256)


def manifest(inputs: Mapping[str, bytes], parameters: Mapping[str, object], checks: Mapping[str, object], allowed: Sequence[str]) -> str:
    """Strict JSON of hashes, parameters and checks; a key that isn't allowed is an error, so no secret slips in."""
    for k in (*parameters, *checks):
        if k not in allowed:
            raise ValueError(f"{k} is not an allowed key")
    return strict_json({"inputs": {k: hashlib.sha256(v).hexdigest() for k, v in sorted(inputs.items())}, "parameters": dict(parameters), "checks": dict(checks)})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one part, through Spark's writers."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
