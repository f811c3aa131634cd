"""Linear interpolation on Delaunay triangles: the lower hull by all triples, any block width."""

import itertools
import random

import numpy as np
import pytest

from firnline.operators import triangulation


def brute(px, py, pz, nx, ny):
    """Of all triples around a node the one with the least lifted height; NaN outside the hull."""
    t = np.array(list(itertools.combinations(range(len(px)), 3)))
    corner = np.stack([px[t], py[t]], axis=2)
    area = np.abs(np.linalg.det(corner[:, 1:] - corner[:, :1]))
    t, corner = t[area > 1e-9], corner[area > 1e-9]
    lift = px**2 + py**2
    out = np.full(len(nx), np.nan)
    for k in range(len(nx)):
        w = triangulation._weights(corner, np.array([[nx[k], ny[k]]]))
        ok = np.flatnonzero((w > -1e-9).all(axis=1))
        if len(ok):
            best = ok[((w[ok] * lift[t[ok]]).sum(axis=1)).argmin()]
            out[k] = (w[best] * pz[t[best]]).sum()
    return out


def linear(spark, points, nodes, **more):
    p = spark.createDataFrame([(*map(float, r),) for r in points], "x double, y double, z double").repartition(3)
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(nodes)], "node long, x double, y double").repartition(2)
    return {r.node: r.z for r in triangulation.linear(n, p, "node", "z", **more).collect()}


def agree(got, want):
    assert len(got) == len(want)
    for k, w in enumerate(want):
        assert (got[k] is None) == bool(np.isnan(w)) and (got[k] is None or got[k] == pytest.approx(w, abs=1e-7)), (k, got[k], w)


@pytest.fixture(scope="module")
def scene():
    r = random.Random(8)
    points = [(r.uniform(-50, 50), r.uniform(-50, 50), r.gauss(0, 5)) for _ in range(45)]
    nodes = [(r.uniform(-60, 60), r.uniform(-60, 60)) for _ in range(150)] + [p[:2] for p in points[:10]]
    return points, nodes, brute(*np.array(points).T, *np.array(nodes).T)


@pytest.mark.parametrize("block,halo", [(7.0, 3.0), (40.0, None), (1000.0, 500.0)])
def test_equal_to_all_triples_for_any_block(spark, scene, block, halo):
    points, nodes, want = scene
    assert 0.5 < np.isfinite(want).mean() < 0.95
    agree(linear(spark, points, nodes, block=block, halo=halo), want)


def test_many_points_give_one_answer_for_any_block(spark):
    r = random.Random(9)
    points = [(r.uniform(0, 1000), r.uniform(0, 300), r.gauss(0, 5)) for _ in range(1500)]
    nodes = [(r.uniform(-20, 1020), r.uniform(-20, 320)) for _ in range(400)]
    a, b = (linear(spark, points, nodes, block=w) for w in (60.0, 5000.0))
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-7) for k in a)
    x, y, _ = np.array(points).T
    for k, (nx, ny) in enumerate(nodes):
        if a[k] is not None:  # in range of its neighbours' values
            assert -25 < a[k] < 25


def test_grids_planes_edges_and_repeats(spark):
    """Four points on a circle everywhere: any diagonal reproduces a plane; border nodes count; repeats are averaged."""
    points = [(x, y, 2 * x - 3 * y + 1) for x in range(9) for y in range(7)]
    nodes = [(x / 2, y / 2) for x in range(17) for y in range(13)] + [(-0.01, 3), (8.001, 3), (4, 6.5)]
    for block in (2.0, 50.0):
        got = linear(spark, points + [(4, 4, 2 * 4 - 3 * 4 + 3), (4, 4, 2 * 4 - 3 * 4 - 1)], nodes, block=block)
        agree(got, np.array([2 * x - 3 * y + 1 if 0 <= x <= 8 and 0 <= y <= 6 else np.nan for x, y in nodes]))


def test_reach_leaves_out_wide_triangles(spark):
    points = [(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1), (100, 0, 5), (101, 0, 5), (100, 1, 5)]
    got = linear(spark, points, [(0.3, 0.4), (50, 0.3), (100.2, 0.2), (0.9, 0.8), (500, 500)], block=5.0, reach=3.0)
    assert (got[0], got[1], got[2], got[3], got[4]) == (pytest.approx(1), None, pytest.approx(5), pytest.approx(1), None)
    assert linear(spark, points, [(50, 0.3)], block=5.0)[0] == pytest.approx(3, abs=0.1)


def test_edge_cases(spark):
    assert linear(spark, [], [(0, 0)], block=1.0) == {0: None}
    assert linear(spark, [(0, 0, 1), (1, 1, 2)], [(0.5, 0.5), (0, 1)], block=1.0) == {0: None, 1: None}  # no triangle
    n = spark.createDataFrame([("a", 0.2, 0.2), ("b", None, 0.0), ("c", float("nan"), 0.0)], "node string, x double, y double")
    p = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (None, 0.0, 9.0), (0.1, 0.1, None), (0.2, 0.1, float("nan"))], "x double, y double, z double")
    assert {r.node: r.z for r in triangulation.linear(n, p, "node", "z", 1.0).collect()} == {"a": pytest.approx(1.0), "b": None, "c": None}
