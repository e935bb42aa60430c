"""Cell codes: regional meshes, geohash, web tiles, squares and hexagons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
MESH_LENGTHS = (4, 6, 8, 9, 10, 11)


def mesh_code(lat: Column, lon: Column, length: int = 9) -> Column:
    """Japanese regional mesh; south and west edges belong to a cell, noise below 1e-9 of a unit is dropped; null outside the domain."""
    if length not in MESH_LENGTHS:
        raise ValueError("length must be 4, 6, 8, 9, 10 or 11")
    halves = max(length, 8) - 8
    factor = 1 << halves
    iy = F.floor(F.round(lat * F.lit(120.0 * factor), 9))
    ix = F.floor(F.round((lon - 100) * F.lit(80.0 * factor), 9))
    y, x = F.floor(iy / factor).cast("long"), F.floor(ix / factor).cast("long")
    parts = [F.lpad(F.floor(y / 80).cast("string"), 2, "0"), F.lpad(F.floor(x / 80).cast("string"), 2, "0")]
    if length >= 6:
        parts += [F.floor(y % 80 / 10).cast("string"), F.floor(x % 80 / 10).cast("string")]
    if length >= 8:
        parts += [(y % 10).cast("string"), (x % 10).cast("string")]
    for shift in reversed(range(halves)):
        parts.append((1 + 2 * F.shiftright(iy, shift).bitwiseAND(F.lit(1)) + F.shiftright(ix, shift).bitwiseAND(F.lit(1))).cast("string"))
    return F.when((lat >= 0) & (lat < 66) & (lon >= 100) & (lon < 180), F.concat(*parts))


def mesh_bounds(code: Column) -> Column:
    """west, south, east, north of a mesh of any length, from integers in 1/1920 and 1/1280 of a degree."""

    def digit(i: int) -> Column:
        return F.coalesce(F.nullif(F.substring(code, i, 1), F.lit("")).cast("int"), F.lit(0))

    n = F.length(code)
    south = F.substring(code, 1, 2).cast("int") * 1280 + digit(5) * 160 + digit(6 + 1) * 16
    west = F.substring(code, 3, 2).cast("int") * 1280 + digit(6) * 160 + digit(8) * 16
    unit = 8
    for i in (9, 10, 11):
        q = digit(i)
        south = south + F.when(q >= 3, unit).otherwise(0)
        west = west + F.when(q.isin(2, 4), unit).otherwise(0)
        unit //= 2
    size = F.when(n == 4, 1280).when(n == 6, 160).when(n == 8, 16).when(n == 9, 8).when(n == 10, 4).when(n == 11, 2)
    fits = n.isin(*MESH_LENGTHS) & code.rlike("^[0-9]{4}([0-7]{2}([0-9]{2}[1-4]{0,3})?)?$")
    bounds = F.struct((100 + west / 1280).alias("west"), (south / 1920).alias("south"), (100 + (west + size) / 1280).alias("east"), ((south + size) / 1920).alias("north"))
    return F.when(fits, bounds)


def mesh_parent(code: Column) -> Column:
    """The next shorter code; null for the shortest."""
    n = F.length(code)
    return F.substring(code, F.lit(1), F.when(n == 6, 4).when(n == 8, 6).when(n > 8, n - 1))


def mesh_children(code: Column) -> Column:
    """All codes one level down; none for the longest."""
    n = F.length(code)

    def square(size: int) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: F.concat(code, y.cast("string"), x.cast("string")))))

    quarters = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: F.concat(code, q.cast("string")))
    return F.when(n == 4, square(8)).when(n == 6, square(10)).when(n.isin(8, 9, 10), quarters).otherwise(F.array().cast("array<string>"))


def geohash(lat: Column, lon: Column, length: int = 6) -> Column:
    """Bits of both coordinates taken in turn, longitude first; null outside the domain."""
    bits = 5 * length
    even, odd = (bits + 1) // 2, bits // 2
    x = F.floor((lon + 180) / 360 * F.lit(float(1 << even))).cast("long")
    y = F.floor((lat + 90) / 180 * F.lit(float(1 << odd))).cast("long")
    out = []
    for i in range(length):
        value = F.lit(0)
        for j in range(5):
            k = 5 * i + j
            source, shift = (x, even - 1 - k // 2) if k % 2 == 0 else (y, odd - 1 - k // 2)
            value = value + F.shiftright(source, shift).bitwiseAND(F.lit(1)).cast("int") * (16 >> j)
        out.append(F.substring(F.lit(BASE32), value + 1, F.lit(1)))
    return F.when((lat >= -90) & (lat < 90) & (lon >= -180) & (lon < 180), F.concat(*out))


def geohash_bounds(code: Column) -> Column:
    """west, south, east, north."""
    state = F.struct(F.lit(-180.0).alias("w"), F.lit(180.0).alias("e"), F.lit(-90.0).alias("s"), F.lit(90.0).alias("n"), F.lit(0).alias("axis"))

    def bit(x: Column, one: Column) -> Column:
        lon, lat = (x["w"] + x["e"]) / 2, (x["s"] + x["n"]) / 2
        on_lon, on_lat = x["axis"] == 0, x["axis"] == 1
        return F.struct(
            F.when(on_lon & one, lon).otherwise(x["w"]).alias("w"), F.when(on_lon & ~one, lon).otherwise(x["e"]).alias("e"),
            F.when(on_lat & one, lat).otherwise(x["s"]).alias("s"), F.when(on_lat & ~one, lat).otherwise(x["n"]).alias("n"), (1 - x["axis"]).alias("axis"),
        )

    values = F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: F.call_function('locate', c, F.lit(BASE32)) - 1)
    ones = F.flatten(F.transform(values, lambda v: F.transform(F.array(*[F.lit(16 >> j) for j in range(5)]), lambda m: v.bitwiseAND(m) > 0)))
    x = F.aggregate(ones, state, bit)
    return F.when(code.rlike(f"^[{BASE32}]+$"), F.struct(x["w"].alias("west"), x["s"].alias("south"), x["e"].alias("east"), x["n"].alias("north")))


def web_tile(lat: Column, lon: Column, zoom: int = 16) -> tuple[Column, Column]:
    """x and y of the web tile."""
    n = float(1 << zoom)
    fits = (F.abs(lat) < 85.05112878) & (lon >= -180) & (lon < 180)
    x = F.floor((lon + 180) / 360 * F.lit(n))
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi)) / 2 * F.lit(n))
    return F.when(fits, x).cast("long"), F.when(fits, y).cast("long")


def tile_bounds(zoom: int, x: Column, y: Column) -> Column:
    n = float(1 << zoom)

    def lat(j: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * j / F.lit(n)))))

    return F.struct((x / F.lit(n) * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / F.lit(n) * 360 - 180).alias("east"), lat(y).alias("north"))


def quadkey(zoom: int, x: Column, y: Column) -> Column:
    return F.concat(*[(F.shiftright(x, s).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, s).bitwiseAND(F.lit(1))).cast("string") for s in reversed(range(zoom))])


def quadkey_tile(code: Column) -> Column:
    """zoom, x, y of a quadkey."""
    digits = F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: c.cast("long"))

    def joined(bit: Column) -> Column:
        return F.aggregate(bit, F.lit(0).cast("long"), lambda a, d: a * 2 + d)

    x = joined(F.transform(digits, lambda d: d.bitwiseAND(F.lit(1))))
    y = joined(F.transform(digits, lambda d: F.shiftright(d, 1)))
    return F.when(code.rlike("^[0-3]+$"), F.struct(F.length(code).alias("zoom"), x.alias("x"), y.alias("y")))


def square_id(x: Column, y: Column, size: int, crs: str = "6677") -> Column:
    return F.concat_ws(":", F.lit(crs), F.lit(str(size)), F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def hexagon(x: Column, y: Column, radius: float = 300.0) -> Column:
    """Axial (a, b) of the flat-top hexagon with the nearest centre; equal distances take the smaller pair."""
    q = 2 * x / F.lit(3 * radius)
    r = (-x / 3 + F.lit(math.sqrt(3)) * y / 3) / F.lit(radius)

    def candidate(da: int, db: int) -> Column:
        a, b = F.floor(q) + da, F.floor(r) + db
        cx, cy = F.lit(radius * 1.5) * a, F.lit(radius * math.sqrt(3)) * (b + a / 2)
        return F.struct(((cx - x) * (cx - x) + (cy - y) * (cy - y)).alias("d2"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    best = F.array_min(F.array(*[candidate(i, j) for i in range(-2, 3) for j in range(-2, 3)]))
    return F.struct(best["a"].alias("a"), best["b"].alias("b"))
