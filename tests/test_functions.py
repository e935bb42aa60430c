"""Column functions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from loxodrome.functions import categories, cells, crs, text
from loxodrome.functions.grid import cell_index


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_cell_index(spark):
    values = [-0.1, -250.0, -250.1, 0.0, 249.999, 250.0, 250 - 1e-9, 500.0]
    assert list(one(spark, *[cell_index(F.lit(v), 250) for v in values])) == [-1, -1, -2, 0, 0, 1, 1, 2]


def test_plane_projection_and_back(spark):
    lon, lat = 139.5796, 35.7034
    x, y = crs.JAPAN_9.forward(F.lit(lon), F.lit(lat))
    back = crs.JAPAN_9.inverse(x, y)
    east, north, lon2, lat2 = one(spark, x, y, *back)
    assert abs(lon2 - lon) < 1e-11 and abs(lat2 - lat) < 1e-11
    assert -23200 < east < -22800 and -33000 < north < -32800


def test_projection_known_values(spark):
    e, n = one(spark, *crs.UTM_54N.forward(F.lit(141.0), F.lit(0.0)))
    assert abs(e - 500000) < 1e-6 and abs(n) < 1e-6
    meridian = one(spark, crs.utm_north(54).forward(F.lit(141.0), F.lit(45.0))[1])[0]
    assert abs(meridian / 0.9996 - 4984944.378) < 0.01  # length of the meridian to 45 degrees
    mx, my = one(spark, *crs.web_mercator(F.lit(180.0), F.lit(85.0511287798)))
    assert abs(mx - 20037508.342789) < 1e-3 and abs(my - mx) < 1


def test_distances(spark):
    degree, quarter, near = one(spark, crs.geodesic_distance(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), crs.geodesic_distance(F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(90.0)), crs.geodesic_distance(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)))
    assert abs(degree - 111319.490793) < 1e-4 and abs(quarter - 10001965.729) < 1e-2 and near == 0
    assert abs(one(spark, crs.great_circle(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)))[0] - math.pi * 6371008.8) < 1e-3


def test_equal_earth_keeps_area(spark):
    ex, ey, px = one(spark, *crs.equal_earth(F.lit(180.0), F.lit(0.0)), crs.equal_earth(F.lit(0.0), F.lit(90.0))[1])
    assert abs(ex - 17243959.06) < 1 and ey == 0 and abs(px - 8392927.6) < 1


def test_mesh_codes(spark):
    got = one(spark, cells.mesh_code(F.lit(35.67), F.lit(139.752), 8), cells.mesh_code(F.lit(35.0), F.lit(135.0), 4), cells.mesh_code(F.lit(70.0), F.lit(135.0)), cells.mesh_parent(F.lit("533944461")), F.size(cells.mesh_children(F.lit("5339"))), cells.mesh_children(F.lit("53394446")))
    assert got[0] == "53394600" and got[1] == "5235" and got[2] is None and got[3] == "53394446" and got[4] == 64 and got[5] == ["533944461", "533944462", "533944463", "533944464"]


def test_mesh_bounds_round_trip(spark):
    codes = ["5339", "533944", "53394446", "533944461", "5339444613", "53394446132"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").withColumn("b", cells.mesh_bounds(F.col("code")))
    for r in rows.collect():
        w, s, e, n = r.b
        middle, corner, far = one(spark, *[cells.mesh_code(F.lit(y), F.lit(x), len(r.code)) for x, y in (((w + e) / 2, (s + n) / 2), (w, s), (e, n))])
        assert middle == r.code and corner == r.code and far != r.code
    bad = spark.createDataFrame([("533984",), ("5339444",), ("533944465",), ("abcd",)], "code string").select(cells.mesh_bounds(F.col("code")).alias("b")).collect()
    assert all(r.b is None for r in bad)


def test_geohash_and_tiles(spark):
    assert one(spark, cells.geohash(F.lit(57.64911), F.lit(10.40744), 11))[0] == "u4pruydqqvj"
    w, s, e, n = one(spark, cells.geohash_bounds(F.lit("u4pruydqqvj")))[0]
    assert w <= 10.40744 < e and s <= 57.64911 < n and e - w < 2e-6
    assert one(spark, cells.geohash_bounds(F.lit("a")))[0] is None
    assert one(spark, cells.quadkey(3, F.lit(3).cast("long"), F.lit(5).cast("long")))[0] == "213"
    assert tuple(one(spark, cells.quadkey_tile(F.lit("213")))[0]) == (3, 3, 5)
    x, y, key, gh = one(spark, *cells.web_tile(F.lit(35.7034), F.lit(139.5796), 16), cells.quadkey(16, *cells.web_tile(F.lit(35.7034), F.lit(139.5796), 16)), cells.geohash(F.lit(35.7034), F.lit(139.5796), 6))
    assert (x, y, key, gh) == (58177, 25801, "1330021123002003", "xn7705")
    b = one(spark, cells.tile_bounds(16, F.lit(x), F.lit(y)))[0]
    assert b.west <= 139.5796 < b.east and b.south < 35.7034 <= b.north


def test_squares_and_hexagons(spark):
    x, y = F.lit(-22941.7), F.lit(-32905.06)
    assert one(spark, cells.square_id(x, y, 500))[0] == "6677:500:-46:-66"
    assert tuple(one(spark, cells.hexagon(x, y))[0]) == (-51, -38)
    assert tuple(one(spark, cells.hexagon(F.lit(0.0), F.lit(0.0)))[0]) == (0, 0)


@pytest.mark.parametrize(("phones", "want"), [(["+81 3-1234-5678; (03) 1234 5678", "０３１２３４５６７８"], ["0312345678"]), (["12345"], []), (None, [])])
def test_phone_keys(spark, phones, want):
    assert spark.createDataFrame([(phones,)], "p array<string>").select(text.phone_keys(F.col("p"))).first()[0] == want


def test_domain_keys(spark):
    urls = ["https://www.Example.com/x?y", "shop.example.jp.", "localhost", "http://user@a.b:80/", "not a host"]
    assert spark.createDataFrame([(urls,)], "u array<string>").select(text.domain_keys(F.col("u"))).first()[0] == ["a.b", "example.com", "shop.example.jp"]


def test_evidence(spark):
    a, b, empty = F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3")), F.array().cast("array<string>")
    assert list(one(spark, text.evidence(a, a), text.evidence(a, b), text.evidence(a, empty))) == ["supporting", "conflicting", "unavailable"]

    def address(**kv):
        return F.array(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.lit(v))]))

    got = one(spark, text.address_evidence(address(postcode="180-0004"), address(postcode="1800005")), text.address_evidence(address(freeform="A  b"), address(address="a B")), text.address_evidence(address(freeform="a"), address(freeform="b")), text.address_evidence(address(freeform="a"), F.array().cast("array<map<string,string>>")))
    assert list(got) == ["conflicting", "supporting", "not_comparable", "unavailable"]


def test_names(spark):
    rows = spark.createDataFrame([("  Ｃａｆé　 A ",), (None,), ("",)], "n string").select(text.normalize_name(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["café a", "", ""]
    rows = spark.createDataFrame([("abcd", "abcd"), ("abcd", "bcde"), ("", "x")], "a string, b string").select(text.name_similarity("a", "b")).collect()
    assert [r[0] for r in rows] == [1.0, 0.75, None]
    assert one(spark, text.display_line(F.lit("4号線丸ノ内線")), text.display_line(F.lit("4号線")))[0:2] == ("丸ノ内線", "4号線")


def test_display_groups(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("z",)], "c string")
    assert [r[0] for r in rows.select(categories.display_group(F.col("c"), {"x": ["a"], "y": ["b"]})).collect()] == ["x", "y", "__MISSING__", "__MISSING__", "__OTHER__"]
    with pytest.raises(ValueError):
        categories.display_group(F.col("c"), {"x": ["a"], "y": ["a"]})


def test_tag_rules(spark):
    def tags(**kv):
        return F.create_map(*[F.lit(x) for kvs in kv.items() for x in kvs])

    walks = [tags(highway="footway"), tags(highway="motorway"), tags(highway="path", motorroad="yes"), tags(highway="path", motorroad="yes", foot="yes"), tags(highway="path", access="private", foot="no"), tags(area="yes"), tags(highway="path", area="yes")]
    assert list(one(spark, *[categories.walkable(t) for t in walks])) == [True, False, False, True, False, False, False]
    kinds = [tags(amenity="clinic", shop="x"), tags(amenity="cafe", tourism="y"), tags(shop="no"), tags(railway="station", shop="x"), tags(leisure="slipway"), tags(office="a"), tags(amenity="bench"), tags(amenity="bank")]
    assert list(one(spark, *[categories.facility(t) for t in kinds])) == ["healthcare", "food", None, None, None, "office", None, "other_amenity"]
    assert list(one(spark, *[categories.water(t) for t in (tags(natural="water"), tags(water="pond"), tags(water="pond", natural="wood"), tags(landuse="reservoir"))])) == [True, True, False, True]


def test_geodesic_points(spark):
    import math

    def at(lon, lat, azimuth, distance):
        return tuple(one(spark, *[c for p in [crs.geodesic_point(F.lit(lon), F.lit(lat), F.lit(azimuth), F.lit(distance))] for c in (p["lon"], p["lat"])]))

    lon, lat = at(0.0, 0.0, 90.0, 6378137.0 * math.pi / 180)
    assert abs(lon - 1) < 1e-9 and abs(lat) < 1e-9
    lon, lat = at(10.0, 20.0, 33.0, 0.0)
    assert abs(lon - 10) < 1e-12 and abs(lat - 20) < 1e-12
    for azimuth, distance in ((0.0, 1e6), (123.0, 5e6), (270.0, 2e5)):
        lon, lat = at(139.0, 35.0, azimuth, distance)
        assert abs(one(spark, crs.geodesic_distance(F.lit(139.0), F.lit(35.0), F.lit(lon), F.lit(lat)))[0] - distance) < 1e-3
