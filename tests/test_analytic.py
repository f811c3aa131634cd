"""Operators against cases with known answers and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import columns as C
from firnline.functions import tides
from firnline.operators import alongtrack, crossover, filters, fits, interpolation, layout, raster, robust, spatial
from firnline.sources import readers, writers
from firnline.streaming import ingest


@pytest.fixture(scope="module")
def plane(spark):
    r = random.Random(1)
    rows = []
    for k in range(800):
        x, y, t = r.uniform(0, 1000), r.uniform(0, 1000), r.uniform(2003, 2009)
        rows.append((k, x, y, t, 10 + 0.01 * x - 0.02 * y + 1.5 * (t - 2005) + 0.3 * math.cos(2 * math.pi * t) + 0.4 * math.sin(2 * math.pi * t) + (50.0 if k % 50 == 0 else 0.0)))
    return spark.createDataFrame(rows, "pid long, x double, y double, t double, h double").coalesce(2)


def test_polar_round_trip_and_known_points(spark):
    rows = [(0.0, -90.0), (0.0, -71.0), (90.0, -75.0), (-180.0, -80.0), (179.9, -65.0), (-45.5, -88.8)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for epsg, sign in ((3031, 1), (3413, -1)):
        q = df.withColumn("lat", F.col("lat") * sign)
        x, y = C.polar_xy(F.col("lon"), F.col("lat"), epsg)
        q = q.withColumns({"x": x, "y": y})
        lon, lat = C.polar_lonlat(F.col("x"), F.col("y"), epsg)
        for r in q.withColumns({"lon2": lon, "lat2": lat}).collect():
            assert r.lat2 == pytest.approx(r.lat, abs=1e-8)
            if abs(r.lat) < 90:
                assert (r.lon2 - r.lon + 180) % 360 - 180 == pytest.approx(0, abs=1e-8)
    x, y = C.polar_xy(F.lit(0.0), F.lit(-71.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(0, abs=1e-6) and r.y == pytest.approx(2082760.109, abs=1)


def test_elevation_change_recovers_trend_and_season(spark, plane):
    nodes = spark.createDataFrame([(1, 500.0, 500.0)], "node long, x double, y double")
    r = fits.elevation_change(nodes, plane, "node", "t", "h", 450.0, t_ref=2005.0).first()
    assert r.p1 == pytest.approx(1.5, abs=1e-6) and r.amplitude == pytest.approx(0.5, abs=1e-6) and r.rmse < 1e-6
    spikes = plane.where("pid % 50 = 0 and pow(x - 500, 2) + pow(y - 500, 2) <= 202500").count()
    inside = plane.where("pow(x - 500, 2) + pow(y - 500, 2) <= 202500").count()
    assert 0.6 * inside < r.nobs <= inside - spikes  # rejected rows stay out, as the spread shrinks


def test_topography_residuals_leave_the_trend(spark):
    r = random.Random(2)
    rows = [(k, (x := r.uniform(-90, 90)), (y := r.uniform(-90, 90)), (t := r.uniform(0, 5)), 100 + 0.1 * x - 0.2 * y + 1e-3 * x * y + 2 * t) for k in range(300)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, t double, h double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 20.0, 0.0)], "node long, x double, y double")
    got = fits.topography_residuals(nodes, df, "node", "pid", "t", "h", 200.0).join(df, "pid").collect()
    assert len(got) == 300
    assert max(abs(g.res - 2 * (g.t - g.t_ref)) for g in got) < 1e-6


def test_radius_and_nearest_joins_are_brute_force(spark):
    r = random.Random(3)
    pts = [(k, r.uniform(-5, 5), r.uniform(-5, 5)) for k in range(200)] + [(500, 40.0, 40.0), (501, None, 1.0)]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    live = [p for p in pts if p[1] is not None]
    got = {(q.l_pid, q.r_pid) for q in spatial.radius_join(df, df, 0.7).collect()}
    assert got == {(a[0], b[0]) for a in live for b in live if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.49}
    nodes = spark.createDataFrame([(k, r.uniform(-8, 8), r.uniform(-8, 8)) for k in range(30)], "node long, x double, y double")
    got = {}
    for q in spatial.knn_join(nodes, df, 4, 0.5, "node", "pid").collect():
        got.setdefault(q.l_node, []).append((q.place, q.r_pid))
    for n in nodes.collect():
        want = sorted(live, key=lambda p: ((p[1] - n.x) ** 2 + (p[2] - n.y) ** 2, p[0]))[:4]
        assert [p for _, p in sorted(got[n.node])] == [p[0] for p in want]
    assert spatial.knn_join(nodes, df.limit(0), 4, 0.5, "node", "pid").count() == 0


def test_two_straight_tracks_cross_where_they_should(spark):
    a = [(1, float(t), 10.0 * t, 10.0 * t, 100.0 + t) for t in range(101)]
    b = [(2, float(t), 10.0 * t, 1000.0 - 10.0 * t, 50.0) for t in range(101)]
    s = "orbit long, t double, x double, y double, h double"
    got = crossover.crossovers(spark.createDataFrame(a, s), spark.createDataFrame(b, s), "orbit", ["t"], "t", "h", 50.0).collect()
    assert len(got) == 1 and got[0].x == pytest.approx(500) and got[0].y == pytest.approx(500) and got[0].dh == pytest.approx(100.0) and got[0].dtime == pytest.approx(0)


def test_bilinear_raster_is_exact_inside_and_clamped_outside(spark):
    grid = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"), (2.0 + 3 * (F.col("id") % 10) - F.floor(F.col("id") / 10)).alias("z"))
    pts = spark.createDataFrame([(1, 3.25, 4.5), (2, -9.0, 2.0), (3, 9.0, 9.0)], "pid long, x double, y double")
    got = {r.pid: r.z for r in raster.sample(pts, grid, 0, 0, 1, 1, 10, 10, "z", "pid").collect()}
    assert got == {1: pytest.approx(2 + 3 * 3.25 - 4.5), 2: pytest.approx(0.0), 3: pytest.approx(2 + 27 - 9)}
    q = raster.savgol2d(grid, 5, 2, "z", "x").where("z is not null").collect()
    assert len(q) == 36 and all(r.z == pytest.approx(3) for r in q)
    assert raster.gaussian_fill(grid.withColumn("z", F.when(F.col("i") != 4, F.lit(7.0))), "z", 1.0).where("abs(z - 7) > 1e-9").count() == 0


def test_kriging_returns_the_data_and_fields_of_one_value(spark):
    pts = [(k, float(k % 4), float(k // 4), math.sin(k)) for k in range(16)]
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double").withColumn("s", F.lit(1e-9))
    nodes = df.select(F.col("pid").alias("node"), "x", "y")
    for r in interpolation.kriging(nodes, df, "node", "pid", "z", "s", 8, 2.0, 1.0).collect():
        assert r.z == pytest.approx(math.sin(r.node), abs=1e-4) and r.err < 1e-2
    flat = df.withColumn("z", F.lit(3.0))
    for f in (interpolation.median_knn(nodes, flat, "node", "pid", "z", 3, 2.0, 1.0), interpolation.gaussian_knn(nodes, flat, "node", "pid", "z", "s", 3, 2.0, 1.0, 1.0)):
        assert {round(r.z, 9) for r in f.collect()} == {3.0}


def test_savgol_reproduces_polynomials(spark):
    df = spark.range(20).select(F.lit(1).alias("c"), F.col("id").alias("k"), (1.0 + F.col("id") - 0.3 * F.col("id") * F.col("id")).alias("v"))
    rows = alongtrack.savgol(df, ["c"], "k", "v", "s", 5, 2).where("k between 2 and 17").collect()
    assert all(r.s == pytest.approx(r.v) for r in rows)
    rows = alongtrack.savgol(df, ["c"], "k", "v", "s", 5, 2, deriv=1).where("k between 2 and 17").collect()
    assert all(r.s == pytest.approx(1 - 0.6 * r.k) for r in rows)


def test_gaps_make_segments(spark):
    t = [0.0, 0.05, 0.1, 0.3, 0.32, 20.0, 20.01]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(t)], "orbit long, pid long, t double")
    for gap, n in ((0.1, 3), (10.0, 2), (100.0, 1)):
        assert alongtrack.sessions(df, ["orbit"], ["t", "pid"], "t", gap).select("seg").distinct().count() == n


def test_hampel_and_mad_ignore_shifts(spark):
    vals = [math.sin(k / 3) + (20 if k == 17 else 0) for k in range(40)]
    for shift in (0.0, 1000.0):
        df = spark.createDataFrame([(1, k, v + shift) for k, v in enumerate(vals)], "c long, k long, v double")
        bad = [r.k for r in robust.hampel(df, ["c"], ["k"], "v", 4, 5.0).where("v is null").collect()]
        assert bad == [17]
    assert robust.mad_std(df, ["c"], "v").first().mad == pytest.approx(1.4826 * float(np.median(np.abs(np.array(vals) - np.median(vals)))), rel=1e-9)


def test_tiles_share_edges_only_when_closed(spark):
    df = spark.createDataFrame([(1, 50.0, 25.0), (2, 50.0, 50.0), (3, 10.0, 10.0)], "pid long, x double, y double")
    n = {r.pid: r["count"] for r in layout.tile(df, (0, 100), (0, 100), 50.0).groupBy("pid").count().collect()}
    assert n == {1: 2, 2: 4, 3: 1}
    assert layout.tile(df, (0, 100), (0, 100), 50.0, closed=False).count() == 3
    assert [r.part for r in layout.split(df, 2, [F.col("pid")]).orderBy("pid").collect()] == [1, 1, 2]


def test_huber_and_least_squares_reject_outliers():
    r = np.random.default_rng(0)
    x = np.linspace(0, 10, 200)
    y = 3 + 0.7 * x
    y[::20] += 80
    a = np.column_stack([np.ones_like(x), x])
    assert fits.huber(a, y) == pytest.approx([3, 0.7], abs=0.05)
    c, _, good = fits.lstsq(a, y + r.normal(0, 1e-3, 200), 5, 5.0)
    assert c == pytest.approx([3, 0.7], abs=1e-3) and not good[::20].any() and good.sum() >= 120


def test_tide_of_one_constituent_has_its_period(spark):
    day = F.col("id") / 24.0
    q = spark.range(24 * 30).select("id", tides.predicted(day, ["m2"], {"m2": F.lit(1.0)}, {"m2": F.lit(0.0)}).alias("h"))
    h = np.array([r.h for r in q.orderBy("id").collect()])
    crossings = ((h[1:] >= 0) & (h[:-1] < 0)).sum()
    assert abs(crossings - 30 * 24 / 12.4206) <= 1 and 0.9 < h.max() < 1.1
    with pytest.raises(ValueError):
        tides.minor_terms(day, {"m2": F.lit(1.0)}, {"m2": F.lit(0.0)}, [])


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n1 2.5 3\n  4,5;6\n\n7 x 9\n")
    rows = readers.ascii_columns(spark, str(tmp_path / "a.txt"), ["a", "b"], [0, 1]).collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 2.5), (4.0, 5.0), (7.0, None)]
    assert [list(r.data) for r in readers.ascii_columns(spark, str(tmp_path / "a.txt")).collect()][0] == [1.0, 2.5, 3.0]
    (tmp_path / "g.gri").write_text("0 1 10 12 1 1\n1 2 3\n4 9999 6\n")
    cells = {(r.i, r.j): (r.x, r.y, r.z) for r in readers.read_ascii_grids(spark, str(tmp_path / "g.gri")).collect()}
    assert cells[0, 1] == (10.0, 1.0, 1.0) and cells[1, 0] == (11.0, 0.0, None) and len(cells) == 6
    nx, ny = 3, 2
    raw = b"\0" * 4 + np.array([nx, ny], ">i4").tobytes() + np.array([-80, -70, 0, 30, 12], ">f4").tobytes() + np.array([0], ">i4").tobytes() + b"\0" * 20
    raw += np.arange(6, dtype=">f4").tobytes() + b"\0" * 8 + np.ones(6, ">i4").tobytes()
    (tmp_path / "grid.bin").write_bytes(raw)
    got = readers.tide_grids(spark, str(tmp_path / "grid.bin")).collect()
    assert len(got) == 6 and got[4].depth == 4.0 and got[4].mask == 1 and (got[4].lon, got[4].lat) == (15.0, -72.5)
    df = spark.range(3).select("id", F.lit(1.5).alias("v"))
    assert writers.unless_done(df, str(tmp_path / "out")) and not writers.unless_done(df, str(tmp_path / "out"))
    writers.text(df, str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect())[0] == "0.000000 1.500000"
    writers.by_tile(df.withColumn("tile", F.col("id") % 2), str(tmp_path / "tiles"), ["tile"])
    assert spark.read.parquet(str(tmp_path / "tiles")).where("tile = 1").count() == 1
    assert readers.files(spark, str(tmp_path), "*.bin").count() == 1


def test_tide_model_files(spark, tmp_path):
    nx, ny, names = 3, 2, ["m2", "k1"]
    parts = np.arange(2 * nx * ny, dtype=">f4")
    raw = np.array([28 + 8, nx, ny, 2], ">i4").tobytes() + np.array([-80, -70, 0, 30], ">f4").tobytes() + "".join(n.ljust(4) for n in names).encode()
    raw += b"\0" * 8 + parts.tobytes() + b"\0" * 8 + (parts * 2).astype(">f4").tobytes()
    (tmp_path / "h.bin").write_bytes(raw)
    rows = {(r.constituent, r.i, r.j): (r.re, r.im) for r in readers.tide_elevations(spark, str(tmp_path / "h.bin")).collect()}
    assert len(rows) == 12 and rows["m2", 1, 0] == (2.0, 3.0) and rows["k1", 2, 1] == (20.0, 22.0) and rows["m2", 0, 0] == (0.0, 1.0)
    block = "title\nmore\n 2 3\n0 1\n0 2\n999. 999.\n(11f7.2)\n"
    (tmp_path / "m2.d").write_text(block + "1 2 3\n4 999 6\n" + block + "0 90 180\n270 0 45\n")
    got = {(r.i, r.j): (r.re, r.im) for r in readers.amplitude_phase_grids(spark, str(tmp_path / "m2.d")).collect()}
    assert got[0, 0] == pytest.approx((1, 0)) and got[1, 0] == pytest.approx((0, -2)) and got[0, 1] == pytest.approx((0, 4)) and got[1, 1] == (None, None)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, float("nan"), -9999.0), (2, 1.0, 2.0)], "pid long, a double, b double")
    q = C.nan_to_null(df, -9999.0)
    assert q.where("a is null and b is null").count() == 1
    assert filters.remove_invalid(df, ["a"]).count() == 1


def test_stream_of_granules(spark, tmp_path):
    schema = "orbit long, ts timestamp, h double"
    df = spark.createDataFrame([(1, 0, 1.0), (1, 60, 3.0), (2, 7200, 5.0)], "orbit long, s long, h double").select("orbit", F.timestamp_seconds("s").alias("ts"), "h")
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.granules(spark, str(tmp_path / "in"), df.schema)
    ingest.append_available(stream.withColumn("h", F.col("h") - 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 2.0, 4.0]
    q = ingest.binned_means(stream, "ts", "h", ["orbit"], "1 hour").writeStream.format("memory").queryName("binned").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.orbit, r.mean, r.n) for r in spark.table("binned").collect()) == [(1, 2.0, 2), (2, 5.0, 1)]
    assert schema


def test_crossings_late_on_a_track_are_found(spark):
    """First crossings at segments of several rounds, in any order, and none for the pair that has none."""
    line = [("a", float(k), k + 0.0, 0.0, float(k)) for k in range(400)]
    rows = list(line)
    for name, at in (("b", 5.5), ("c", 40.25), ("d", 300.5)):
        rows += [(name, 0.0, at, -1.0, 0.0), (name, 1.0, at, 1.0, 0.0), (name, 2.0, at + 60.0, -1.0, 0.0)]
    rows += [("e", 0.0, 0.0, 50.0, 0.0), ("e", 1.0, 399.0, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "orbit string, t double, x double, y double, h double")
    got = {(r.track_1, r.track_2): r.x for r in crossover.crossovers(df, df, "orbit", ["t"], "t", "h", 20.0, same_table=True).collect() if r.track_1 == "a"}
    assert got == pytest.approx({("a", "b"): 5.5, ("a", "c"): 40.25, ("a", "d"): 300.5})


def test_lag_pairs_of_one_mission_are_those_of_all(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, r.random(), r.random(), k % 3) for k in range(60)], "pid long, x double, y double, mission long")
    pairs = lambda q: {(p.l_pid, p.r_pid) for p in q.collect()}
    assert pairs(spatial.lag_pairs(df, "pid", 0.3, by=("mission",))) == pairs(spatial.lag_pairs(df, "pid", 0.3).where("l_mission = r_mission"))
