"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    Only where none is set and the master is local, as in tests, a temporary one
    is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named:
            context.setCheckpointDir(named)
        elif context.master.startswith("local[") or context.master == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept as a Parquet table in the shared folder, of which later steps read the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is computed inside go as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)
