"""Counts of points by cell and time over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.functions.grid import cell_index


def cell_counts(events: DataFrame, size: float, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """start, ix, iy, n per tumbling window and cell; events later than ``late`` are left out.  The same on a batch."""
    keyed = events.withWatermark(time, late) if events.isStreaming else events
    return keyed.groupBy(F.window(time, window).alias("w"), cell_index(F.col("x"), size).alias("ix"), cell_index(F.col("y"), size).alias("iy")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "ix", "iy", "n")
