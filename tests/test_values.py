"""Values of fits, filters and interpolations without a SQL twin: fixtures with known answers, and plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import tides
from firnline.operators import filters, fits, interpolation, layout, raster, spatial


def series(spark, spikes=(), n=120, cells=(1, 2)):
    """A smooth series a cell, 50 m spikes at some places, one missing value."""
    rows = [(c, k, None if k == 7 else 0.02 * k + 0.3 * math.sin(k / 9) + 0.01 * ((k * 37) % 11) + (50.0 if k in spikes else 0.0)) for c in cells for k in range(n)]
    return spark.createDataFrame(rows, "cell long, k long, v double")


@pytest.mark.parametrize("by_bins", [False, True])
def test_sigma_filters_reject_what_was_injected(spark, by_bins):
    r = random.Random(4)
    bad = set(range(5, 400, 29))
    rows = [(c, 1000 * c + k, (t := k / 40), 3 + 0.5 * t + r.gauss(0, 0.02) + (50.0 if k in bad else 0.0)) for c in (1, 2) for k in range(400)]
    df = spark.createDataFrame(rows, "cell long, pid long, t double, h double")
    got = {x.pid: x.h for x in fits.sigma_filter(df, "cell", "pid", "t", "h", n_sigma=8.0, by_bins=by_bins).collect()}
    assert len(got) == 800 and {p for p, h in got.items() if h is None} == {1000 * c + k for c in (1, 2) for k in bad}
    assert all(got[p] == h for _, p, _, h in rows if got[p] is not None)


def test_block_fit_and_space_time_filters_reject_what_was_injected(spark):
    r = random.Random(5)
    bad = set(range(3, 500, 31))
    rows = []
    for k in range(500):
        x, y, t = r.uniform(-90, 90), r.uniform(-90, 90), r.uniform(0, 5)
        rows.append((1, k, x, y, t, 10 + 0.1 * x - 0.2 * y + 1e-3 * x * y + 2e-4 * x * x + r.gauss(0, 0.05) + (50.0 if k in bad else 0.0)))
    df = spark.createDataFrame(rows, "cell long, pid long, x double, y double, t double, h double")
    got = {p.pid: p.h for p in fits.block_fit_filter(df, "cell", "pid", "x", "y", "h", n_sigma=6.0).collect()}
    assert len(got) == 500 and {p for p, h in got.items() if h is None} == bad
    flat = df.withColumn("h", F.when(F.col("pid").isin(*bad), 50.0).otherwise(0.0) + F.col("t") * 0.1 + F.rand(3) * 0.1)
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 300.0, 0.0)], "node long, x double, y double")
    ok = {p.pid: p.ok for p in fits.space_time_filter(nodes, flat, "node", "pid", "t", "h", 200.0, 95.0, n_sigma=8.0).collect()}
    assert len(ok) == 500 and {p for p, x in ok.items() if not x} == bad


def test_series_filter_replaces_spikes_by_neighbours(spark):
    spikes = (20, 61, 100)
    got = {(x.cell, x.k): x.v for x in fits.series_filter(series(spark, spikes), "cell", "k", "v").collect()}
    clean = {(x.cell, x.k): x.v for x in series(spark).collect()}
    assert got.keys() == clean.keys() and got[1, 7] is None
    for c in (1, 2):
        for k in range(120):
            if k in spikes:
                assert got[c, k] == pytest.approx((clean[c, k - 1] + clean[c, k + 1]) / 2, abs=1e-9)
            elif k != 7:
                assert got[c, k] == pytest.approx(clean[c, k], abs=0.15)


def test_offsets_of_missions_and_fused_series(spark):
    def curve(t):
        return 5 + 0.4 * t + 0.05 * t * t + 0.3 * math.cos(2 * math.pi * t) - 0.2 * math.sin(2 * math.pi * t)

    spans = {"a": (0, 6, 0.0), "b": (3, 10, 1.0), "c": (7, 14, -2.0)}
    rows = [(c, k / 12, m, curve(k / 12) + off) for c in (1, 2) for m, (lo, hi, off) in spans.items() for k in range(12 * lo, 12 * hi)]
    df = spark.createDataFrame([*rows, (3, 0.0, "a", 1.0), (1, 20.0, "a", None)], "cell long, t double, m string, h double")
    got = {(r.cell, r.m): r.offset for r in fits.cross_calibrate(df, "cell", "t", "m", "h").collect()}
    assert got.keys() == {(c, m) for c in (1, 2) for m in spans}
    assert all(off == pytest.approx(spans[m][2], abs=1e-6) for (_, m), off in got.items())
    fused = fits.fused(df, "cell", "t", "m", "h").collect()
    assert len(fused) == len(rows) + 2
    for r in fused:
        assert r.fused is None if r.cell == 3 or r.h is None else r.fused == pytest.approx(curve(r.t), abs=1e-6)


def test_scattering_correction_recovers_what_a_parameter_adds(spark):
    r = random.Random(6)
    rows = []
    for c in (1, 2):
        for k in range(200):
            t, p, q = k / 40, r.gauss(0, 1), r.gauss(3, 2)
            rows.append((c, 1000 * c + k, t, 4 + 0.5 * t + 0.7 * p, p if k % 50 else None, q))
    few = [(3, 3000 + k, k / 10, 1.0, 0.1, 0.2) for k in range(10)]
    df = spark.createDataFrame(rows + few, "cell long, pid long, t double, h double, p double, q double")
    got = {x.pid: x for x in fits.scattering_correction(df, "cell", "pid", "t", "h", ["p", "q"]).collect()}
    assert len(got) == len(rows) + len(few)
    cell = [x for x in rows if x[0] == 1 and x[4] is not None]
    p = np.array([x[4] for x in cell])
    t = np.array([x[2] for x in cell])
    line = np.column_stack([np.ones(len(t)), t])
    want = 0.7 * (p - line @ np.linalg.lstsq(line, p, rcond=None)[0])  # what detrending leaves of it
    have = np.array([got[x[1]].h_bs for x in cell])
    assert np.abs((have - have.mean()) - (want - want.mean())).max() < 0.1 and got[cell[0][1]].r2 > 0.98 and got[cell[0][1]].d_std < 0
    assert all(got[x[1]].h_bs is None for x in rows if x[4] is None)
    assert all(got[x[1]].h_bs == 0 for x in few)


@pytest.mark.parametrize("kind", ["gauss", "markov", "generic", "exp"])
def test_covariance_models_are_recovered(kind):
    d = np.linspace(0, 3, 25)
    c0, a, miss = interpolation.fit_covariance(d.tolist(), interpolation._model(kind, d, 2.5, 0.7).tolist(), kind)
    assert (c0, a, miss) == (pytest.approx(2.5, rel=1e-3), pytest.approx(0.7, rel=1e-3), pytest.approx(0, abs=1e-3))


def test_optimal_interpolation_gives_back_data_and_constants(spark):
    r = random.Random(8)
    rows = [(k, r.uniform(0, 1), r.uniform(0, 1), 7.0, 0.05, k / 40, "ab"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, s double, t double, track string")
    nodes = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0)], "node long, x double, y double")
    [got] = interpolation.optimal(nodes, df, "node", "z", "s", "t", "track", 2.0, 0.5).collect()
    assert got.node == 1 and got.z == pytest.approx(7.0, abs=1e-6) and got.n == 40 and got.t_span == pytest.approx(39 / 40)
    with pytest.raises(Exception, match="at most 39"):
        interpolation.optimal(nodes, df, "node", "z", "s", "t", "track", 2.0, 0.5, most=39).collect()
    exact = df.withColumns({"z": F.sin(3 * F.col("x")) + F.col("y"), "s": F.lit(1e-9)})
    at = exact.where("pid = 11").select(F.col("pid").alias("node"), "x", "y", F.col("z").alias("want")).cache()
    [one] = interpolation.optimal(at.drop("want"), exact, "node", "z", "s", "t", "track", 2.0, 0.5, n_sigma=99.0).collect()
    assert one.z == pytest.approx(at.first().want, abs=1e-4)


def test_octant_collocation_of_a_constant(spark):
    r = random.Random(9)
    rows = [(k, r.uniform(0, 1), r.uniform(0, 1), 3.25, 0.02) for k in range(80)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, s double")
    nodes = spark.createDataFrame([(1, 0.4, 0.6)], "node long, x double, y double")
    got = interpolation.kriging(nodes, df, "node", "pid", "z", "s", 2, 0.2, 0.1, "generic", sectors=8).first()
    assert got.z == pytest.approx(3.25, abs=1e-6) and got.n <= 16


def test_extended_fields_keep_constants_and_masks(spark):
    rows = [(i, j, 5.0 if i < 4 else None) for i in range(8) for j in range(6)]
    df = spark.createDataFrame(rows, "i long, j long, z double")
    got = {(r.i, r.j): r.z for r in raster.extend_field(df, "z", [1.0, 2.0], F.col("j") >= 1).collect()}
    assert all(got[i, 0] is None for i in range(8))
    assert all(got[i, j] == pytest.approx(5.0) for i in range(7) for j in range(1, 6))


def test_sampled_sectors_hold_what_was_asked_for(spark):
    r = random.Random(10)
    df = spark.createDataFrame([(k, r.uniform(-1, 1), r.uniform(-1, 1)) for k in range(400)], "pid long, x double, y double")
    a = filters.sample_sectors(df, "x", "y", 0.0, 0.0, 5).withColumn("s", filters.sector(F.col("x"), F.col("y")))
    assert [r["count"] for r in a.groupBy("s").count().collect()] == [5] * 8
    assert {x.pid for x in a.collect()} == {x.pid for x in filters.sample_sectors(df.repartition(5), "x", "y", 0.0, 0.0, 5).collect()}


def test_intervals_of_any_length_and_number(spark):
    r = random.Random(11)
    spans = [(a, a + r.choice([0.0, 0.01, 1.0, 40.0])) for a in (r.uniform(0, 100) for _ in range(60))]
    times = [r.uniform(-10, 150) for _ in range(200)] + [spans[0][0], spans[0][1]] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "pid long, t double")
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "name long, t1 double, t2 double")
    want = sorted((k, n) for k, t in enumerate(times) for n in ([n for n, (a, b) in enumerate(spans) if t is not None and a <= t < b] or [-1]))
    assert sorted((x.pid, -1 if x.name is None else x.name) for x in spatial.interval_lookup(df, table, "t", "t1", "t2").collect()) == want
    assert spatial.interval_lookup(df, table.limit(0), "t", "t1", "t2").count() == len(times)


def test_delta_time_in_and_outside_the_table(spark):
    df = spark.createDataFrame([(t,) for t in (-5.0, 0.0, 5.0, 10.0, 30.0, 99.0)], "t double")
    table = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0), (50.0, 6.0)], "t double, delta double")
    got = {r.t: r.delta_t for r in tides.delta_time(df, table, "t").collect()}
    assert got == {-5.0: 1.0, 0.0: 1.0, 5.0: 1.5, 10.0: 2.0, 30.0: 4.0, 99.0: 6.0}


def test_nodal_corrections_know_their_constituents(spark):
    lon = tides.longitudes(F.lit(51544.0))
    for name, *_ in tides.CONSTITUENTS:
        f, u = spark.range(1).select(*tides.nodal(name, lon, "otis")).first()
        assert 0.2 < f < 2.5 and abs(u) <= math.pi
    for kind in ("otis", "got"):
        with pytest.raises(ValueError):
            tides.nodal("nonesuch", lon, kind)


def test_exact_median_of_a_column(spark):
    for values in ([3.0], [4.0, 1.0], [5.0, None, 1.0, 9.0, 9.0, 2.0], [2.0] * 50 + [7.0] * 49):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert layout.median_of_all(df, "v") == float(np.median([v for v in values if v is not None]))
    assert layout.median_of_all(spark.createDataFrame([(None,)], "v double"), "v") is None
