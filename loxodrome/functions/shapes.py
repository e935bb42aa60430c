"""Lines and rings as arrays of (x, y) structs: lengths, midpoints, areas, mesh outlines, neighbours of cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions.crs import WGS84, TransverseMercator, let


def segments(line: Column) -> Column:
    """Array of (a, b) of consecutive points."""
    n = F.size(line) - 1
    return F.arrays_zip(F.slice(line, F.lit(1), F.greatest(n, F.lit(0))).alias("a"), F.slice(line, F.lit(2), F.greatest(n, F.lit(0))).alias("b"))


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def point_along(line: Column, distance: Column) -> Column:
    """Point at a distance along a line, its ends beyond it; null for an empty line."""
    start = F.struct(F.lit(0.0).alias("gone"), line[0].alias("p"))

    def walk(state: Column, e: Column) -> Column:
        step = F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        t = F.least(F.greatest(F.coalesce(F.try_divide(distance - state["gone"], step), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        at = F.struct((e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).alias("y"))
        return F.struct((state["gone"] + step).alias("gone"), F.when(distance >= state["gone"], at).otherwise(state["p"]).alias("p"))

    return F.when(F.size(line) > 0, F.aggregate(segments(line), start, walk)["p"])


def midpoint(line: Column) -> Column:
    return let(line, lambda x: point_along(x, line_length(x) / 2))


def representative(lines: Column) -> Column:
    """Midpoint of the longest of an array of lines; of equal ones the first in order of its points."""
    best = F.array_min(F.transform(lines, lambda x: F.struct((-line_length(x)).alias("length"), x.alias("line"))))["line"]
    return F.when(F.size(lines) > 0, midpoint(best))


def densify_ring(ring: Column, pieces: int) -> Column:
    """Each side in ``pieces`` equal parts."""
    step = F.sequence(F.lit(0), F.lit(pieces - 1))

    def parts(e: Column) -> Column:
        return F.transform(step, lambda i: F.struct((e["a"]["x"] + i / pieces * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + i / pieces * (e["b"]["y"] - e["a"]["y"])).alias("y")))

    return F.concat(F.flatten(F.transform(segments(ring), parts)), F.slice(ring, F.lit(-1), F.lit(1)))


def box_ring(bounds: Column) -> Column:
    """Closed ring, counter-clockwise, of a struct (west, south, east, north)."""
    corners = (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))
    return F.array(*[F.struct(bounds[x].alias("x"), bounds[y].alias("y")) for x, y in corners])


def projected(ring: Column, projection: TransverseMercator) -> Column:
    """A ring of lon, lat in a plane."""

    def one(p: Column) -> Column:
        x, y = projection.forward(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, one)


def ellipsoid_area(ring: Column) -> Column:
    """Area in square metres of a lon, lat ring on WGS84; sides are straight in the equal-area cylinder, so divide long ones first."""
    a, inverse = WGS84
    e2 = 1 / inverse * (2 - 1 / inverse)
    e = math.sqrt(e2)

    def q(p: Column) -> Column:
        s = F.sin(F.radians(p["y"]))
        return F.lit(1 - e2) * (s / (1 - F.lit(e2) * s * s) + F.atanh(F.lit(e) * s) / F.lit(e))

    total = F.aggregate(segments(ring), F.lit(0.0), lambda t, x: t + F.radians(x["b"]["x"] - x["a"]["x"]) * (q(x["a"]) + q(x["b"])) / 2)
    return F.abs(total) * F.lit(a * a / 2)


def square_neighbours(ix: Column, iy: Column) -> Column:
    """The four squares that share a side."""
    return F.array(*[F.struct((ix + dx).alias("ix"), (iy + dy).alias("iy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])


def hexagon_neighbours(a: Column, b: Column) -> Column:
    """The six hexagons around an axial one."""
    return F.array(*[F.struct((a + da).alias("a"), (b + db).alias("b")) for da, db in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))])


#: Letters of the military grid's latitude bands, columns and rows.
_BANDS, _ROWS = "CDEFGHJKLMNPQRSTUVWX", "ABCDEFGHJKLMNPQRSTUV"
_COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")


def mgrs(lon: Column, lat: Column, zone: int, precision: int = 2) -> Column:
    """Military grid reference of a northern point of one UTM zone (no exceptions of Norway and Svalbard); null elsewhere."""
    from loxodrome.functions.crs import utm_north

    x, y = utm_north(zone).forward(lon, lat)
    band = F.substring(F.lit(_BANDS), (F.floor((lat + 80) / 8) + 1).cast("int"), F.lit(1))
    column = F.substring(F.lit(_COLUMNS[(zone - 1) % 3]), F.floor(x / 100_000).cast("int"), F.lit(1))
    row = F.substring(F.lit(_ROWS), ((F.floor(y / 100_000) + (5 if zone % 2 == 0 else 0)) % 20 + 1).cast("int"), F.lit(1))
    size = 10 ** (5 - precision)
    digits = [F.lpad(F.floor(v % 100_000 / size).cast("string"), precision, "0") for v in (x, y)] if precision else []
    fits = (F.floor((lon + 180) / 6) + 1 == zone) & (lat >= 0) & (lat < 72)
    return F.when(fits, F.concat(F.lit(f"{zone:02d}"), band, column, row, *digits))


def closed(ring: Column) -> Column:
    """The ring with its first point at its end, once."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return F.when((F.size(ring) == 0) | ((first["x"] == last["x"]) & (first["y"] == last["y"])), ring).otherwise(F.concat(ring, F.array(first)))


def _cut_side(ring: Column, axis: str, bound: Column, sign: int) -> Column:
    """The part of a closed ring on one side of a line along an axis."""
    other = "y" if axis == "x" else "x"

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        da, db = (a[axis] - bound) * sign, (b[axis] - bound) * sign
        t = F.try_divide(da, da - db)
        at = F.struct(*[(bound if c == axis else a[other] + t * (b[other] - a[other])).cast("double").alias(c) for c in "xy"])
        start = F.struct(a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y"))
        both = F.array(F.when(da >= 0, start), F.when(((da > 0) & (db < 0)) | ((da < 0) & (db > 0)), at))
        return F.filter(both, lambda p: p.isNotNull())

    return let(F.flatten(F.transform(segments(ring), kept)), closed)


def clip_to_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed ring cut to a box, one side after another; its area is that of the common part, whatever the ring's shape."""

    def cut(axis: str, bound: Column, sign: int) -> Callable[[Column], Column]:
        return lambda r: _cut_side(r, axis, bound, sign)

    out = closed(ring)
    for axis, bound, sign in (("x", west, 1), ("x", east, -1), ("y", south, 1), ("y", north, -1)):
        out = let(out, cut(axis, bound, sign))
    return out


def boundary_gap(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to the nearest side of a closed ring."""

    def gap(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(segments(ring), gap))


def assemble_rings(lines: Column) -> Column:
    """Closed rings from an array of lines that meet at their ends, in either direction; null if any line is left over or a ring stays open.

    Lines are taken in order: a ring begins with the first one left, and grows by
    the first one left that begins or ends where it ends.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["x"] == b["x"]) & (a["y"] == b["y"])

    def first(line: Column) -> Column:
        return F.try_element_at(line, F.lit(1))

    def last(line: Column) -> Column:
        return F.try_element_at(line, F.lit(-1))

    point = "array<struct<x:double,y:double>>"
    plain = F.transform(lines, lambda line: F.transform(line, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    start = F.struct(F.array().cast(f"array<{point}>").alias("done"), F.array().cast(point).alias("now"), plain.alias("left"), F.lit(True).alias("good"))

    def step(state: Column, _: Column) -> Column:
        now, left = state["now"], state["left"]
        whole = (F.size(now) >= 4) & F.coalesce(same(first(now), last(now)), F.lit(False))
        fresh = whole | (F.size(now) == 0)
        place = F.array_position(F.transform(left, lambda line: F.coalesce(same(first(line), last(now)) | same(last(line), last(now)), F.lit(False))), F.lit(True)).cast("int")
        taken = F.try_element_at(left, F.when(fresh, F.lit(1)).otherwise(F.greatest(place, F.lit(1))))
        turned = F.when(F.coalesce(same(first(taken), last(now)), F.lit(False)), taken).otherwise(F.reverse(taken))
        longer = F.concat(now, F.slice(turned, F.lit(2), F.greatest(F.size(turned) - 1, F.lit(0))))
        none = F.array().cast(point)
        lost = ~fresh & (place == 0)
        return F.struct(
            F.when(whole, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"),
            F.when(lost, none).when(fresh, F.coalesce(taken, none)).otherwise(longer).alias("now"),
            F.when(lost, left).otherwise(F.filter(left, lambda _, i: i != F.when(fresh, 0).otherwise(place - 1))).alias("left"),
            (state["good"] & ~lost).alias("good"),
        )

    ended = F.aggregate(F.sequence(F.lit(0), 2 * F.size(lines)), start, step)
    return let(ended, lambda e: F.when(e["good"] & (F.size(e["left"]) == 0) & (F.size(e["now"]) == 0), e["done"]))


def in_rings(x: Column, y: Column, outer: Column, inner: Column) -> Column:
    """Inside an outer ring and outside all inner ones."""
    from loxodrome.operators.spatial import in_ring

    return F.exists(outer, lambda r: in_ring(x, y, r)) & ~F.exists(inner, lambda r: in_ring(x, y, r))


def rings_area(outer: Column, inner: Column) -> Column:
    from loxodrome.operators.spatial import ring_area

    def total(rings: Column) -> Column:
        return F.aggregate(rings, F.lit(0.0), lambda s, r: s + F.abs(ring_area(r)))

    return total(outer) - total(inner)
