"""Map projections as Column expressions: no Python, no library on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of the ellipsoids.
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


class TransverseMercator:
    """Krueger's series to the fifth order of the third flattening; below a micrometre within a zone."""

    def __init__(self, lat0: float, lon0: float, k0: float, east: float = 0.0, north: float = 0.0, ellipsoid: tuple[float, float] = GRS80) -> None:
        self.lon0, self.k0, self.east, self.north = lon0, k0, east, north
        a, inverse = ellipsoid
        n = 1 / (2 * inverse - 1)
        self.e = math.sqrt(1 / inverse * (2 - 1 / inverse))
        self.radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630,
            61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880, 49561 * n**4 / 161280 - 179 * n**5 / 168, 34729 * n**5 / 80640,
        )
        self.beta = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105,
            17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480, 4397 * n**4 / 161280 - 11 * n**5 / 504, 4583 * n**5 / 161280,
        )
        phi = math.radians(lat0)
        chi = math.atan(math.sinh(math.atanh(math.sin(phi)) - self.e * math.atanh(self.e * math.sin(phi))))
        self.origin = chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(self.alpha))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres."""
        phi, lam = F.radians(lat), F.radians(lon - F.lit(self.lon0))
        t = F.sinh(F.atanh(F.sin(phi)) - F.lit(self.e) * F.atanh(F.lit(self.e) * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.hypot(t, F.cos(lam)))
        x, y = eta, xi
        for j, a in enumerate(self.alpha):
            m = F.lit(2.0 * (j + 1))
            x = x + F.lit(a) * F.cos(m * xi) * F.sinh(m * eta)
            y = y + F.lit(a) * F.sin(m * xi) * F.cosh(m * eta)
        scale = F.lit(self.k0 * self.radius)
        return scale * x + F.lit(self.east), scale * (y - F.lit(self.origin)) + F.lit(self.north)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees."""
        scale = F.lit(self.k0 * self.radius)
        xi, eta = (y - F.lit(self.north)) / scale + F.lit(self.origin), (x - F.lit(self.east)) / scale
        p, q = xi, eta
        for j, b in enumerate(self.beta):
            m = F.lit(2.0 * (j + 1))
            p = p - F.lit(b) * F.sin(m * xi) * F.cosh(m * eta)
            q = q - F.lit(b) * F.cos(m * xi) * F.sinh(m * eta)
        e2 = F.lit(self.e**2)

        def newton(start: Column) -> Column:
            def step(tau: Column, _: Column) -> Column:
                def better(sigma: Column) -> Column:
                    root = F.sqrt(1 + tau * tau)
                    return let(tau * F.sqrt(1 + sigma * sigma) - sigma * root, lambda back: tau + (start - back) / F.sqrt(1 + back * back) * (1 + (1 - e2) * tau * tau) / ((1 - e2) * root))

                return let(F.sinh(F.lit(self.e) * F.atanh(F.lit(self.e) * tau / F.sqrt(1 + tau * tau))), better)

            return F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, step)  # the second round is already at rounding level

        lat = F.degrees(F.atan(let(F.sin(p) / F.hypot(F.sinh(q), F.cos(p)), newton)))
        return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + F.lit(self.lon0), lat

    def scale_factor(self, x: Column) -> Column:
        """Local scale at an easting, to the second order."""
        d = (x - F.lit(self.east)) / F.lit(self.k0 * self.radius)
        return F.lit(self.k0) * (1 + d * d / 2)


#: Japan plane rectangular zone 9, and UTM zone 54 north.
JAPAN_9 = TransverseMercator(36.0, 139.0 + 50 / 60, 0.9999)
UTM_54N = TransverseMercator(0.0, 141.0, 0.9996, 500000.0, 0.0, WGS84)


def utm_north(zone: int) -> TransverseMercator:
    return TransverseMercator(0.0, 6.0 * zone - 183, 0.9996, 500000.0, 0.0, WGS84)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    a = F.lit(WGS84[0])
    return a * F.radians(lon), a * F.asinh(F.tan(F.radians(lat)))


def equal_earth(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal Earth (2018) on WGS84 with authalic latitude."""
    a, inverse = WGS84
    e2 = 1 / inverse * (2 - 1 / inverse)
    e = math.sqrt(e2)
    c = (1.340264, -0.081106, 0.000893, 0.003796)

    def q(s: Column) -> Column:
        return F.lit(1 - e2) * (s / (1 - F.lit(e2) * s * s) + F.atanh(F.lit(e) * s) / F.lit(e))

    pole = (1 - e2) * (1 / (1 - e2) + math.atanh(e) / e)
    beta = F.asin(F.least(F.greatest(q(F.sin(F.radians(lat))) / F.lit(pole), F.lit(-1.0)), F.lit(1.0)))
    t = F.asin(F.lit(math.sqrt(3) / 2) * F.sin(beta))
    t2 = t * t
    t6 = t2 * t2 * t2
    down = F.lit(3.0) * (F.lit(9 * c[3]) * t6 * t2 + F.lit(7 * c[2]) * t6 + F.lit(3 * c[1]) * t2 + F.lit(c[0]))
    r = F.lit(a * math.sqrt(pole / 2))
    return r * F.lit(2 * math.sqrt(3)) * F.radians(lon) * F.cos(t) / down, r * t * (F.lit(c[3]) * t6 * t2 + F.lit(c[2]) * t6 + F.lit(c[1]) * t2 + F.lit(c[0]))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def geodesic_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """Vincenty's inverse on WGS84, a fixed number of rounds; for points that aren't nearly antipodal."""
    a, inverse = WGS84
    f = 1 / inverse
    b = a * (1 - f)

    def reduced(lat: Column) -> Column:
        return F.atan(F.lit(1 - f) * F.tan(F.radians(lat)))

    def fields(**columns: Column) -> Column:
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    def distance(p: Column) -> Column:
        s1, c1, s2, c2, big = p["s1"], p["c1"], p["s2"], p["c2"], p["big"]

        def step(x: Column, _: Column) -> Column:
            lam = x["lam"]
            arc = fields(s=F.hypot(c2 * F.sin(lam), c1 * s2 - s1 * c2 * F.cos(lam)), c=s1 * s2 + c1 * c2 * F.cos(lam))
            return let(arc, lambda g: let(F.when(g["s"] == 0, 0.0).otherwise(c1 * c2 * F.sin(lam) / g["s"]), lambda sa: let(1 - sa * sa, lambda ca2: turned(g, sa, ca2))))

        def turned(g: Column, sa: Column, ca2: Column) -> Column:
            def after(cm: Column) -> Column:
                k = F.lit(f / 16) * ca2 * (4 + F.lit(f) * (4 - 3 * ca2))
                new = big + (1 - k) * F.lit(f) * sa * (F.atan2(g["s"], g["c"]) + k * g["s"] * (cm + k * g["c"] * (-1 + 2 * cm * cm)))
                return fields(lam=new, s=g["s"], c=g["c"], ca2=ca2, cm=cm)

            return let(F.when(ca2 == 0, 0.0).otherwise(g["c"] - 2 * s1 * s2 / ca2), after)

        def length(x: Column) -> Column:
            def measured(v: Column) -> Column:
                s, c, cm = x["s"], x["c"], x["cm"]
                change = v["b"] * s * (cm + v["b"] / 4 * (c * (-1 + 2 * cm * cm) - v["b"] / 6 * cm * (-3 + 4 * s * s) * (-3 + 4 * cm * cm)))
                return F.lit(b) * v["a"] * (F.atan2(s, c) - change)

            series = lambda v2: fields(a=1 + v2 / 16384 * (4096 + v2 * (-768 + v2 * (320 - 175 * v2))), b=v2 / 1024 * (256 + v2 * (-128 + v2 * (74 - 47 * v2))))
            return let(let(x["ca2"] * F.lit((a * a - b * b) / (b * b)), series), measured)

        start = fields(lam=big, s=F.lit(0.0), c=F.lit(1.0), ca2=F.lit(1.0), cm=F.lit(0.0))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step), length)

    u1, u2 = reduced(lat1), reduced(lat2)
    return let(fields(s1=F.sin(u1), c1=F.cos(u1), s2=F.sin(u2), c2=F.cos(u2), big=F.radians(lon2 - lon1)), distance)


def geodesic_point(lon: Column, lat: Column, azimuth: Column, distance: Column, rounds: int = 8) -> Column:
    """Struct (lon, lat) of the point at a distance along a geodesic that leaves by an azimuth (degrees from north): Vincenty's direct solution on WGS84, a fixed number of rounds."""
    a, inverse = WGS84
    f = 1 / inverse
    b = a * (1 - f)

    def fields(**columns: Column) -> Column:
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    def from_start(p: Column) -> Column:
        sin_u, cos_u, sin_az, cos_az = p["su"], p["cu"], p["sz"], p["cz"]

        def along(v: Column) -> Column:
            first = distance / (F.lit(b) * v["a"])

            def step(sigma: Column, _: Column) -> Column:
                def better(m: Column) -> Column:
                    s, c = F.sin(sigma), F.cos(sigma)
                    return first + v["b"] * s * (m + v["b"] / 4 * (c * (-1 + 2 * m * m) - v["b"] / 6 * m * (-3 + 4 * s * s) * (-3 + 4 * m * m)))

                return let(F.cos(2 * v["sigma1"] + sigma), better)

            def end(x: Column) -> Column:
                s, c, m = x["s"], x["c"], x["m"]
                across = sin_u * s - cos_u * c * cos_az
                lat2 = F.atan2(sin_u * c + cos_u * s * cos_az, F.lit(1 - f) * F.hypot(v["sa"], across))
                lam = F.atan2(s * sin_az, cos_u * c - sin_u * s * cos_az)
                k = F.lit(f / 16) * v["ca2"] * (4 + F.lit(f) * (4 - 3 * v["ca2"]))
                turned = let(k, lambda k: lam - (1 - k) * F.lit(f) * v["sa"] * (x["sigma"] + k * s * (m + k * c * (-1 + 2 * m * m))))
                return fields(lon=lon + F.degrees(turned), lat=F.degrees(lat2))

            settled = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)
            return let(settled, lambda sigma: let(fields(sigma=sigma, s=F.sin(sigma), c=F.cos(sigma), m=F.cos(2 * v["sigma1"] + sigma)), end))

        def series(w: Column) -> Column:
            u2 = w["ca2"] * F.lit((a * a - b * b) / (b * b))
            return let(u2, lambda u2: fields(a=1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), b=u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))), sigma1=F.atan2(sin_u, cos_u * cos_az), sa=w["sa"], ca2=w["ca2"]))

        return let(let(cos_u * sin_az, lambda sa: fields(sa=sa, ca2=1 - sa * sa)), lambda w: let(series(w), along))

    u, z = F.atan(F.lit(1 - f) * F.tan(F.radians(lat))), F.radians(azimuth)
    return let(fields(su=F.sin(u), cu=F.cos(u), sz=F.sin(z), cz=F.cos(z)), from_start)
