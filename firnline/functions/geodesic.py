"""Geodesics on the ellipsoid as Column expressions: a fixed number of rounds of Vincenty's series, and slope relocation.

What is used several times is bound once, as the argument of a lambda, so an expression stays small whatever the
optimizer moves where. Good to well below a millimetre; points nearly opposite each other on the globe, for which the
series does not converge, are not for the inverse. NULL in gives NULL out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
#: Rounds; each gains about three digits.
ROUNDS = 6


def bound(then: Callable[[Column], Column], **values: Column) -> Column:
    """`then` of a struct of `values`, each worked out once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def _series(cos2: Column) -> dict[str, Column]:
    """The factor of the series and that of its change, from the squared cosine of the azimuth at the equator."""
    u = cos2 * ((A * A - B * B) / (B * B))
    return {"scale": 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), "wave": u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))}


def _step(wave: Column, m: Column, sin: Column, cos: Column) -> Column:
    """The series' change of the arc; m is the cosine of twice the arc's middle."""
    return wave * sin * (m + wave / 4 * (cos * (-1 + 2 * m * m) - wave / 6 * m * (-3 + 4 * sin * sin) * (-3 + 4 * m * m)))


def _shift(cos2: Column, sin_a: Column, m: Column, sin: Column, cos: Column, arc: Column) -> Column:
    """How much less the longitudes differ on the ellipsoid than on the sphere."""
    k = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    return (1 - k) * FLAT * sin_a * (arc + k * sin * (m + k * cos * (-1 + 2 * m * m)))


def _half_turn(degrees: Column) -> Column:
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def forward(lon: Column, lat: Column, azimuth: Column, distance: Column, rounds: int = ROUNDS, turns: bool = False) -> Column:
    """Struct (lon, lat) of the place at `distance` metres from a place, in degrees, in the direction `azimuth`, degrees from north.

    Longitudes are -180 to 180; with `turns` they go on from that of the first place, on whatever turn it is.
    """

    def sphere(g: Column) -> Column:  # tangent of the reduced latitude
        cu = 1 / F.sqrt(1 + g["t"] * g["t"])
        return bound(ellipsoid, cu=cu, su=g["t"] * cu, s1=F.atan2(g["t"], g["ca"]), sin_a=cu * g["sa"], ca=g["ca"], sa=g["sa"], lon=g["lon"], d=g["d"])

    def ellipsoid(g: Column) -> Column:
        keep = {k: g[k] for k in ("cu", "su", "s1", "sin_a", "ca", "sa", "lon", "d")}
        return bound(lambda h: bound(arc, cos2=h["cos2"], **_series(h["cos2"]), **{k: h[k] for k in keep}), cos2=1 - g["sin_a"] * g["sin_a"], **keep)

    def arc(g: Column) -> Column:
        first = g["d"] / (B * g["scale"])

        def again(s: Column, _: Column) -> Column:
            return bound(lambda h: first + _step(g["wave"], h["m"], h["sin"], h["cos"]), m=F.cos(2 * g["s1"] + s), sin=F.sin(s), cos=F.cos(s))

        s = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, again)
        return bound(lambda h: end(g, h), s=s)

    def end(g: Column, h: Column) -> Column:
        return bound(lambda k: place(g, h, k), m=F.cos(2 * g["s1"] + h["s"]), sin=F.sin(h["s"]), cos=F.cos(h["s"]))

    def place(g: Column, h: Column, k: Column) -> Column:
        across = g["su"] * k["sin"] - g["cu"] * k["cos"] * g["ca"]
        phi = F.atan2(g["su"] * k["cos"] + g["cu"] * k["sin"] * g["ca"], (1 - FLAT) * F.sqrt(g["sin_a"] * g["sin_a"] + across * across))
        lam = F.atan2(k["sin"] * g["sa"], g["cu"] * k["cos"] - g["su"] * k["sin"] * g["ca"])
        out = g["lon"] + F.degrees(lam - _shift(g["cos2"], g["sin_a"], k["m"], k["sin"], k["cos"], h["s"]))
        return F.struct((out if turns else _half_turn(out)).alias("lon"), F.degrees(phi).alias("lat"))

    return bound(sphere, t=(1 - FLAT) * F.tan(F.radians(lat)), ca=F.cos(F.radians(azimuth)), sa=F.sin(F.radians(azimuth)), lon=lon, d=distance)


def inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = ROUNDS) -> Column:
    """Struct (azimuth, distance): the direction at the first place (degrees from north, 0 for equal places) and metres to the second."""

    def sphere(g: Column) -> Column:
        c1, c2 = (1 / F.sqrt(1 + g[t] * g[t]) for t in ("t1", "t2"))
        return bound(solve, c1=c1, c2=c2, n1=g["t1"] * c1, n2=g["t2"] * c2, diff=g["diff"])

    def around(g: Column, lam: Column, then: Callable[[Column], Column]) -> Column:
        """`then` of the arc at a difference of longitudes on the sphere."""
        sin, cos = F.sin(lam), F.cos(lam)

        def sides(h: Column) -> Column:
            root = F.sqrt(h["x"] * h["x"] + h["y"] * h["y"])
            return bound(angle, sin=root, cos=h["cos"], x=h["x"], y=h["y"])

        def angle(h: Column) -> Column:
            sin_a = F.coalesce(F.try_divide(g["c1"] * h["x"], h["sin"]), 0 * h["sin"])
            return bound(middle, s=F.atan2(h["sin"], h["cos"]), sin_a=sin_a, **{k: h[k] for k in ("sin", "cos", "x", "y")})

        def middle(h: Column) -> Column:
            cos2 = 1 - h["sin_a"] * h["sin_a"]
            m = F.coalesce(h["cos"] - F.try_divide(2 * g["n1"] * g["n2"], cos2), 0 * h["cos"])
            return bound(then, cos2=cos2, m=m, **{k: h[k] for k in ("s", "sin_a", "sin", "cos", "x", "y")})

        return bound(sides, x=g["c2"] * sin, y=g["c1"] * g["n2"] - g["n1"] * g["c2"] * cos, cos=g["n1"] * g["n2"] + g["c1"] * g["c2"] * cos)

    def solve(g: Column) -> Column:
        def again(lam: Column, _: Column) -> Column:
            return around(g, lam, lambda h: g["diff"] + _shift(h["cos2"], h["sin_a"], h["m"], h["sin"], h["cos"], h["s"]))

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), g["diff"], again)
        return bound(lambda q: around(g, q["lam"], end), lam=lam)

    def end(h: Column) -> Column:
        s = _series(h["cos2"])
        far = B * s["scale"] * (h["s"] - _step(s["wave"], h["m"], h["sin"], h["cos"]))
        azimuth = F.when(h["sin"] == 0, 0 * h["sin"]).otherwise(F.pmod(F.degrees(F.atan2(h["x"], h["y"])), F.lit(360.0)))
        return F.struct(azimuth.alias("azimuth"), far.alias("distance"))

    return bound(sphere, t1=(1 - FLAT) * F.tan(F.radians(lat1)), t2=(1 - FLAT) * F.tan(F.radians(lat2)), diff=F.radians(_half_turn(lon2 - lon1)))


def curvature_radius(lat: Column, azimuth: Column) -> Column:
    """Radius of the ellipsoid's normal section at a latitude in a direction, both in degrees."""
    s, cos, sin = F.sin(F.radians(lat)), F.cos(F.radians(azimuth)), F.sin(F.radians(azimuth))
    w = 1 - E2 * s * s
    m, n = A * (1 - E2) / F.pow(w, F.lit(1.5)), A / F.sqrt(w)
    return m * n / (n * cos * cos + m * sin * sin)


# PRJ-16
def relocated(df: DataFrame, lon: str, lat: str, h: str, rng: str, slope: str, aspect: str, turns: bool = False) -> DataFrame:
    """`df` with lon_echo, lat_echo, h_echo and dist_cor: the echo's point of origin up the slope, and the height there.

    `rng` is the range in metres, `slope` in radians, `aspect` the direction up the slope in degrees from north. The Earth's
    curvature in that direction is taken off the height. On flat ground the point stays. `turns`: see `forward`.
    """
    c = F.col
    d = c(rng) * F.sin(slope)
    height = c(h) + c(rng) - (c(rng) * F.cos(slope) + d * d / (2 * curvature_radius(c(lat), c(aspect))))
    q = df.withColumns({"\x01at": forward(c(lon), c(lat), c(aspect), d, turns=turns), "\x01h": height, "\x01d": d})
    out = {"lon_echo": c("\x01at")["lon"], "lat_echo": c("\x01at")["lat"], "h_echo": c("\x01h"), "dist_cor": c("\x01d")}
    return q.withColumns(out).drop("\x01at", "\x01h", "\x01d")
