"""Optimal interpolation in space and time, large systems, robust covariance models."""

import random

import numpy as np
import pytest

from firnline.operators import interpolation as I


def points(n, seed=3):
    r = np.random.default_rng(seed)
    x, y, t = r.uniform(-5, 5, n), r.uniform(-5, 5, n), r.uniform(0, 4, n)
    return x, y, np.sin(x) + 0.5 * y + 0.2 * t + r.normal(0, 0.1, n), np.full(n, 0.1), t, r.integers(0, 6, n)


def plain(x0, y0, x, y, z, s, a, same, same_error, t, t0, tau):
    """The textbook system, element by element."""
    c0 = np.var(z)
    q = lambda d: (1 + d / (0.595 * a)) * np.exp(-d / (0.595 * a))
    n = len(z)
    m = np.array([[c0 * q(np.hypot(x[i] - x[j], y[i] - y[j])) * np.exp(-(((t[i] - t[j]) / tau) ** 2)) + (s[i] ** 2 + 1e-10 * c0 if i == j else same_error**2 * (same[i] == same[j])) for j in range(n)] for i in range(n)])
    to = np.array([c0 * q(np.hypot(x[i] - x0, y[i] - y0)) * np.exp(-(((t[i] - t0) / tau) ** 2)) for i in range(n)])
    w = np.linalg.inv(m) @ to
    return np.median(z) + w @ (z - np.median(z)), np.sqrt(c0 - w @ to)


def test_space_time_system_is_the_textbook_one():
    x, y, z, s, t, k = points(60)
    args = dict(same=k, same_error=0.05, t=t, t0=1.5, tau=2.0)
    want = plain(0.3, -0.2, x, y, z, s, 2.0, k, 0.05, t, 1.5, 2.0)
    assert I.solve(0.3, -0.2, x, y, z, s, 2.0, **args) == pytest.approx(want, abs=1e-9)
    assert I.solve(0.3, -0.2, x, y, z, s, 2.0, **args, dense=10) == pytest.approx(want, abs=1e-8)


def test_systems_too_large_for_one_matrix(monkeypatch):
    monkeypatch.setattr(I, "ROWS", 50_000)
    x, y, z, s, t, k = points(900, 5)
    for kind in ("markov", "gauss", "exp"):
        a = I.solve(1.0, 1.0, x, y, z, s, 1.5, kind, k, 0.02)
        assert I.solve(1.0, 1.0, x, y, z, s, 1.5, kind, k, 0.02, dense=100) == pytest.approx(a, abs=1e-6)


def test_neighbours_are_the_nearest_of_each_direction(spark):
    x, y, z, s, t, k = points(300, 8)
    df = spark.createDataFrame([(*map(float, v[:5]), int(v[5])) for v in zip(x, y, z, s, t, k)] + [(None, 0.0, 1.0, 0.1, 1.0, 1), (0.1, 0.1, None, 0.1, 1.0, 1)], "x double, y double, z double, s double, t double, k int")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "node long, x double, y double")
    got = I.optimal(nodes, df, "node", "z", "s", "t", "k", 4.0, 2.0, least=5, n_sigma=50, sectors=4, per_sector=7, tau=3.0, t_ref=2.0).collect()
    keep = []
    for turn in range(4):
        mine = [i for i in range(300) if np.hypot(x[i], y[i]) <= 4 and int(np.floor(np.arctan2(y[i], x[i]) / (np.pi / 2))) % 4 == turn]
        keep += sorted(mine, key=lambda i: np.hypot(x[i], y[i]))[:7]
    keep = np.array(sorted(keep, key=lambda i: x[i]))
    assert len(got) == 1 and got[0].n == 28
    want = plain(0.0, 0.0, x[keep], y[keep], z[keep], s[keep], 2.0, k[keep], 0.0, t[keep], 2.0, 3.0)
    assert (got[0].z, got[0].err) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("kind", ["gauss", "markov", "generic", "exp"])
def test_robust_models_pass_by_outliers(kind):
    r, d = random.Random(2), np.arange(0.5, 40) * 5.0
    cov = I._model(kind, d, 4.0, 30.0)
    noisy = cov + np.array([r.gauss(0, 0.02) for _ in d])
    noisy[[6, 17, 18, 30]] += [9.0, -6.0, 5.0, 7.0]
    found = I.robust_covariance(d[::-1], noisy[::-1], kind)
    assert (found["c0"], found["a"]) == pytest.approx((4.0, 30.0), rel=0.06)
    assert I._model(kind, found["half"], 1.0, found["a"]) == pytest.approx(0.5, abs=1e-9)
    assert I._model(kind, found["efold"], 1.0, found["a"]) == pytest.approx(1 / np.e, abs=1e-9)


def test_zero_crossing_and_running_median():
    d = np.arange(10.0)
    assert I.robust_covariance(d, 4.5 - d, "gauss", window=1)["zero"] == pytest.approx(4.5)
    assert I.robust_covariance(d, np.exp(-d), "exp", window=1)["zero"] is None
    assert I.running_median(np.array([1.0, 9.0, 2.0, 3.0]), 3).tolist() == [5.0, 2.0, 3.0, 2.5]


@pytest.mark.parametrize("kind", ["gauss", "markov", "generic", "exp"])
def test_products_by_cells_are_those_of_all_pairs(kind):
    r = np.random.default_rng(4)
    x, y = np.concatenate([r.normal(0, 1, 2000), [0.5] * 3]), np.concatenate([r.normal(0, 2, 2000), [0.25] * 3])
    v = r.normal(size=len(x))
    cov = lambda d: I._model(kind, d, 0.3, 1.0)
    times = I._by_cells(x, y, cov, 1.0)
    want = cov(np.hypot(x[:, None] - x, y[:, None] - y)) @ v
    assert times is None or np.abs(times(v) - want).max() <= 2 * I.EXACT * 0.3 * np.abs(v).sum()
    assert times is not None or kind == "exp"
    assert I._by_cells(np.zeros(5), np.zeros(5), cov, 1.0) is None  # no extent
    assert I._by_cells(x * 1e4, y, cov, 1.0) is None  # too many cells


def test_large_systems_need_fewer_covariances_than_pairs(monkeypatch):
    x, y, z, s, t, k = points(4000, 6)
    want = I.solve(1.0, 1.0, x, y, z, s, 1.5, "markov", k, 0.02, dense=5000)
    made, model = [], I._model
    monkeypatch.setattr(I, "LANDMARKS", 300)
    monkeypatch.setattr(I, "_model", lambda kind, d, *more: made.append(np.size(d)) or model(kind, d, *more))
    assert I.solve(1.0, 1.0, x, y, z, s, 1.5, "markov", k, 0.02, dense=100) == pytest.approx(want, abs=1e-8)
    assert sum(made) < 4000 * 4000


def test_few_nodes_get_a_task_each(spark):
    x, y, z, s, t, k = points(100, 9)
    df = spark.createDataFrame([(*map(float, v[:5]), int(v[5])) for v in zip(x, y, z, s, t, k)], "x double, y double, z double, s double, t double, k int")
    nodes = spark.createDataFrame([(i, float(i % 3), float(i // 3)) for i in range(9)], "node long, x double, y double")
    q = I.optimal(nodes, df, "node", "z", "s", "t", "k", 4.0, 2.0, least=5)
    assert q.rdd.getNumPartitions() >= 36 and q.count() == 9
