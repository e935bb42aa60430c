"""Cell indexes of planar grids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_index(value: Column, size: Column | float, origin: Column | float = 0.0) -> Column:
    """Half-open cell [lower, upper) of a coordinate; noise of at most 1e-8 m beside an edge counts as on it."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    origin = origin if isinstance(origin, Column) else F.lit(float(origin))
    q = (value - origin) / size
    near = F.rint(q)
    return F.when(F.abs(q - near) * size <= 1e-8, near).otherwise(F.floor(q)).cast("long")


def clamp(index: Column, cells: Column | int) -> Column:
    """Points on the outer east or north edge belong to the last cell."""
    cells = cells if isinstance(cells, Column) else F.lit(cells)
    return F.least(F.greatest(index, F.lit(0).cast("long")), cells.cast("long") - 1)


def share(part: Column, whole: Column) -> Column:
    """part / whole, undefined (null) for an empty whole."""
    return F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0).cast("long")))


def overlap_length(a: Column, b: Column, width: Column | float) -> Column:
    """Common length of two intervals of one width with these centres."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    return F.greatest(width - F.abs(a - b), F.lit(0.0))


def clipped(lower: Column, upper: Column, low: Column, high: Column) -> Column:
    """Length of [lower, upper] inside [low, high]."""
    return F.greatest(F.least(upper, high) - F.greatest(lower, low), F.lit(0.0))
