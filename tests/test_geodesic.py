"""Geodesics against steps along the curve's own equations, and back; slope relocation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from firnline.functions import geodesic as G


def walked(lon, lat, az, d, n=2000):
    """The end of a geodesic by Runge-Kutta steps of its differential equations."""

    def rate(v):
        phi, _, a = v
        w = 1 - G.E2 * math.sin(phi) ** 2
        m, r = G.A * (1 - G.E2) / w**1.5, G.A / math.sqrt(w)
        return math.cos(a) / m, math.sin(a) / (r * math.cos(phi)), math.sin(a) * math.tan(phi) / r

    v, h = (math.radians(lat), math.radians(lon), math.radians(az)), d / n
    move = lambda v, k, s: tuple(x + s * y for x, y in zip(v, k))
    for _ in range(n):
        k1 = rate(v)
        k2 = rate(move(v, k1, h / 2))
        k3 = rate(move(v, k2, h / 2))
        k4 = rate(move(v, k3, h))
        v = tuple(x + h / 6 * (a + 2 * b + 2 * c + e) for x, a, b, c, e in zip(v, k1, k2, k3, k4))
    return math.degrees(v[1]), math.degrees(v[0])


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(6)
    rows = [(k, r.uniform(-180, 180), r.uniform(-84, 84), r.uniform(0, 360), r.choice([1.0, 500.0, 30e3, 400e3, 3000e3])) for k in range(60)]
    rows += [(100, 10.0, 45.0, 0.0, 0.0), (101, 179.99, 0.0, 90.0, 5000.0), (102, None, 1.0, 1.0, 1.0), (103, 0.0, 0.0, 90.0, 1e6), (104, 0.0, 89.0, 0.0, 50e3)]
    return spark.createDataFrame(rows, "k long, lon double, lat double, az double, d double")


def metres(lon1, lat1, lon2, lat2):
    east = math.radians((lon2 - lon1 + 180) % 360 - 180) * G.A * math.cos(math.radians(lat1))
    return math.hypot(east, math.radians(lat2 - lat1) * G.A)


def test_forward_is_a_walk_to_a_millimetre(lines):
    for r in lines.withColumn("at", G.forward(*map(F.col, ("lon", "lat", "az", "d")))).select("*", F.col("at.lon").alias("lon2"), F.col("at.lat").alias("lat2")).collect():
        if r.lon is None:
            assert r.lon2 is None
        elif abs(r.lat) < 80 and r.d <= 400e3:
            assert metres(r.lon2, r.lat2, *walked(r.lon, r.lat, r.az, r.d)) < 1e-3
        assert r.lon2 is None or -180 <= r.lon2 <= 180


def test_inverse_goes_back(lines):
    q = lines.withColumn("at", G.forward(*map(F.col, ("lon", "lat", "az", "d"))))
    q = q.withColumn("back", G.inverse(F.col("lon"), F.col("lat"), F.col("at.lon"), F.col("at.lat")))
    for r in q.where("lon is not null and back.distance >= 0").select("*", F.col("back.azimuth").alias("az2"), F.col("back.distance").alias("d2")).collect():
        assert r.d2 == pytest.approx(r.d, abs=1e-3)
        assert r.d < 1 or math.radians(abs((r.az2 - r.az + 180) % 360 - 180)) * r.d < 1e-3


def test_known_lines(spark):
    """A quadrant of the equator, and the meridian's quadrant (10,001,965.7293 m)."""
    df = spark.createDataFrame([(0.0, 0.0, 90.0, 0.0), (7.0, 0.0, 7.0, 90.0)], "a double, b double, c double, d double")
    east, north = df.select("a", G.inverse(*map(F.col, "abcd")).alias("q")).orderBy("a").select(F.col("q.azimuth").alias("az"), F.col("q.distance").alias("m")).collect()
    assert east.m == pytest.approx(math.pi / 2 * G.A, abs=1e-3) and east.az == pytest.approx(90)
    assert north.m == pytest.approx(10001965.7293, abs=1e-3) and north.az == pytest.approx(0)


def test_relocation_moves_up_the_slope(spark):
    df = spark.createDataFrame([(1, -40.0, 72.0, 2000.0, 8e5, 0.01, 30.0), (2, -40.0, 72.0, 2000.0, 8e5, 0.0, 0.0), (3, None, None, None, None, None, None)], "k long, lon double, lat double, h double, r double, slope double, aspect double")
    up, flat, none = G.relocated(df, "lon", "lat", "h", "r", "slope", "aspect").orderBy("k").collect()
    assert (up.lon_echo, up.lat_echo) == pytest.approx(walked(-40.0, 72.0, 30.0, 8e5 * math.sin(0.01)), abs=1e-9)
    assert up.h_echo - 2000 == pytest.approx(8e5 - 8e5 * math.cos(0.01) - (8e5 * math.sin(0.01)) ** 2 / (2 * 6.38e6), abs=0.05)
    assert (flat.lon_echo, flat.lat_echo, flat.h_echo) == pytest.approx((-40.0, 72.0, 2000.0), abs=1e-9)
    assert none.lon_echo is None and none.h_echo is None


def test_filters_on_results_plan_quickly(lines):
    q = lines.withColumn("at", G.forward(*map(F.col, ("lon", "lat", "az", "d")))).withColumn("again", G.forward(F.col("at.lon"), F.col("at.lat"), F.col("az"), F.col("d")))
    assert q.where(F.col("again.lon").isNotNull() & (F.col("again.lat") > -91)).count() == lines.count() - 1
