"""Batched fits of nodes against plain loops over nodes."""

import random

import numpy as np
import pytest

from firnline.operators import blocks, fits


@pytest.fixture(scope="module")
def cloud(spark):
    r = random.Random(11)
    rows = []
    for k in range(2500):
        x, y, t = r.uniform(-3000, 3000), r.uniform(-3000, 3000), r.uniform(2000, 2008)
        h = 50 + 0.01 * x - 0.02 * y + (0.4 + x / 1e4) * (t - 2004) + 0.3 * np.cos(2 * np.pi * t) + r.gauss(0, 0.2) + (8 if k % 40 == 0 else 0)
        rows.append((k, x, y, t, float(h), float(k % 2), 0.1 + r.random()))
    rows += [(9000, None, 1.0, 2001.0, 1.0, 0.0, 0.1), (9001, 5.0, 5.0, None, 1.0, 0.0, 0.1), (9002, 5.0, 6.0, 2003.0, None, 1.0, 0.1), (9003, 5.0, 7.0, float("nan"), 2.0, 1.0, 0.1)]
    return spark.createDataFrame(rows, "pid long, x double, y double, t double, h double, m double, s double").repartition(3)


@pytest.fixture(scope="module")
def nodes(spark):
    at = [(k, 700.0 * (k % 9 - 4), 700.0 * (k // 9 - 4)) for k in range(81)] + [(500, 90000.0, 0.0), (501, None, 0.0)]
    return spark.createDataFrame(at, "node long, x double, y double")


def plain_points(cloud):
    rows = [r for r in cloud.collect() if None not in (r.x, r.t, r.h) and r.t == r.t]
    return {c: np.array([r[c] for r in rows]) for c in ("pid", "x", "y", "t", "h", "m", "s")}


def selected(p, x, y, r, relocations):
    near = lambda a, b: (p["x"] - a) ** 2 + (p["y"] - b) ** 2 <= r * r
    ok, cx, cy = near(x, y), x, y
    for _ in range(relocations):
        if ok.sum() < 2:
            break
        mx, my = np.median(p["x"][ok]), np.median(p["y"][ok])
        if np.hypot(mx - x, my - y) > r:
            break
        cx, cy = mx, my
        ok = near(cx, cy)
    return ok, cx, cy


@pytest.mark.parametrize("relocations", [0, 2])
def test_elevation_change_is_a_loop_over_nodes(spark, cloud, nodes, relocations):
    p, r = plain_points(cloud), 600.0
    got = {g.node: g for g in fits.elevation_change(nodes, cloud, "node", "t", "h", r, least=30, n_sigma=3.0, relocations=relocations, block=2000.0).collect()}
    want = {}
    for n in nodes.where("x is not null").collect():
        ok, cx, cy = selected(p, n.x, n.y, r, relocations)
        if ok.sum() < 30:
            continue
        t, ref = p["t"][ok], p["t"][ok].mean()
        a = fits.surface_design(t - ref, (p["x"][ok] - cx) / r, (p["y"][ok] - cy) / r, trend=2, surface=1, season=True)
        c, e, good = fits.lstsq(a, p["h"][ok], 5, 3.0)
        want[n.node] = (cx, cy, c[0], c[1], c[2], e[1], np.hypot(c[-2], c[-1]), fits.mad((p["h"][ok] - a @ c)[good]), good.sum())
    assert len(want) > 60 and got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g.x, g.y, g.p0, g.p1, g.p2, g.p1_error, g.amplitude, g.rmse, g.nobs) == pytest.approx(w, rel=1e-7, abs=1e-9)


def test_block_width_changes_nothing(cloud, nodes):
    a, b = ({(g.node, round(g.p1, 9), g.nobs) for g in fits.elevation_change(nodes, cloud, "node", "t", "h", 600.0, relocations=1, block=w).collect()} for w in (700.0, 50000.0))
    assert a == b and a


def test_weights_missions_and_parameters_enter_the_model(spark):
    r = random.Random(4)
    rows = []
    for k in range(400):
        x, y, t, m, w = r.uniform(-90, 90), r.uniform(-90, 90), r.uniform(0, 6), k % 3, r.gauss(0, 1)
        rows.append((k, x, y, t, 10 + 0.1 * x - 0.3 * y + 0.5 * t + (0, 2.5, -1.5)[m] + 0.7 * w, float(m), w, 0.1 if k % 5 else 1e6))
        if k % 5 == 0:
            rows[-1] = (*rows[-1][:4], 999.0, *rows[-1][5:])  # worthless by its sigma
    df = spark.createDataFrame(rows, "pid long, x double, y double, t double, h double, m double, w double, s double")
    one = spark.createDataFrame([("a", 0.0, 0.0)], "node string, x double, y double")
    model = fits.SurfaceModel(surface=1, season=False, params=("w",), mission="m", missions=(1.0, 2.0), sigma="s", space_scale=500.0, time_scale=50.0)
    g = fits.elevation_change(one, df, "node", "t", "h", 200.0, n_sigma=None, max_rate=100.0, model=model).first()
    assert g.node == "a" and g.p1 == pytest.approx(0.5, abs=1e-4) and g.offsets == pytest.approx([2.5, -1.5], abs=1e-3)
    alone = fits.elevation_change(one, df.where("m = 1"), "node", "t", "h", 200.0, n_sigma=None, max_rate=100.0, model=model).first()
    assert alone.offsets == pytest.approx([0, 0], abs=1e-9) and alone.p1 == pytest.approx(0.5, abs=1e-4)


def test_series_are_weighted_means_of_bins(spark, cloud, nodes):
    p, r, step, window, bins = plain_points(cloud), 600.0, 0.5, 1.0, 16
    got = {(g.node, g.k): g for g in fits.elevation_series(nodes.where("node < 20"), cloud, "node", "t", "h", r, 2000.0, step, window, bins, n_sigma=3.0, relocations=1, model=fits.SurfaceModel(sigma="s")).collect()}
    want = {}
    for n in nodes.where("node < 20").collect():
        ok, cx, cy = selected(p, n.x, n.y, r, 1)
        if ok.sum() < 25:
            continue
        t, h, weight = p["t"][ok], p["h"][ok], 1 / p["s"][ok] ** 2
        a = fits.surface_design(t - t.mean(), (p["x"][ok] - cx) / r, (p["y"][ok] - cy) / r, trend=2, surface=1, season=True)
        c, _, good = fits.lstsq(a, h, 5, 3.0, weight=weight)
        resid = h - a @ c
        change = resid + a[:, [1, 2, -2, -1]] @ c[[1, 2, -2, -1]]
        kept = np.abs(resid) <= 3.0 * fits.mad(resid)
        for k in range(bins):
            at = 2000.0 + (k + 0.5) * step
            b = kept & (t >= at - window / 2) & (t <= at + window / 2)
            if b.any():
                v, w = change[b], weight[b]
                near = np.abs(v - np.median(v)) <= 3.5 * fits.mad(v)
                mean = (v[near] * w[near]).sum() / w[near].sum()
                want[n.node, k] = (at, mean, (w[near] * (v[near] - mean) ** 2).sum() / w[near].sum(), near.sum())
    assert len(want) > 150 and got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g.time, g.height, g.variance, g.n) == pytest.approx(w, rel=1e-6, abs=1e-9)


def test_topography_takes_the_best_node_of_each_point(spark, cloud, nodes):
    p, r = plain_points(cloud), 900.0
    got = {g.pid: g for g in fits.topography_residuals(nodes, cloud, "node", "pid", "t", "h", r, least=20, quad_from=60, n_sigma=3.0, scale=500.0, block=2500.0).collect()}
    best = {}
    for n in nodes.where("x is not null").orderBy("node").collect():
        ok, cx, cy = selected(p, n.x, n.y, r, 0)
        if ok.sum() < 20:
            continue
        x, y, t, h = (p["x"][ok] - cx) / r, (p["y"][ok] - cy) / r, p["t"][ok], p["h"][ok]
        order = 2 if ok.sum() > 60 else 1
        a = fits.surface_design(t - t.mean(), x, y, trend=1, surface=order)
        c, _, good = fits.lstsq(a, h, 5, 3.0, weight=1 / (1 + ((p["x"][ok] - cx) ** 2 + (p["y"][ok] - cy) ** 2) / 500.0**2))
        err, model = fits.mad((h - a @ c)[good]), a @ c - a[:, 1] * c[1]
        for pid, res, ok_here in zip(p["pid"][ok], h - model, good):
            if ok_here and (pid not in best or err < best[pid][1] - 1e-12):
                best[pid] = (res, err, n.node, order)
    assert len(best) > 2000 and got.keys() == best.keys()
    for pid, (res, err, node, order) in best.items():
        g = got[pid]
        assert (g.res, g.err) == pytest.approx((res, err), rel=1e-7, abs=1e-9) and (g.node, g.order) == (node, order)


def test_empty_tables_have_no_solutions(cloud, nodes):
    assert fits.elevation_change(nodes, cloud.limit(0), "node", "t", "h", 600.0).count() == 0
    assert fits.elevation_change(nodes.limit(0), cloud, "node", "t", "h", 600.0).count() == 0
    assert fits.topography_residuals(nodes, cloud.limit(0), "node", "pid", "t", "h", 600.0).count() == 0


def test_stacked_least_squares_of_deficient_systems_have_the_smallest_norm():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 9, 3))
    a[:, :, 2] = a[:, :, 0] * 2
    v = rng.normal(size=(6, 9))
    there = rng.random((6, 9)) < 0.8
    there[5] = False
    c, _, _ = blocks.lstsq(a, v, there)
    for k in range(5):
        assert c[k] == pytest.approx(np.linalg.lstsq(a[k][there[k]], v[k][there[k]], rcond=None)[0], abs=1e-9)
    assert np.isnan(c[5]).all()
