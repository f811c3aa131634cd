"""Chained biases of missions: planted ones come back, series are levelled."""

import random

import pytest

from firnline.operators import crosscal

BIAS = {"a": 0.0, "b": 3.0, "c": -2.0, "d": 7.5}
LIFE = {"a": (0, 40), "b": (30, 80), "c": (70, 120), "d": (130, 160)}  # a and c share no epoch; d shares none with any


def height(cell, k):
    return 100 + cell + 0.05 * k


@pytest.fixture(scope="module")
def missions(spark):
    r = random.Random(7)
    rows = [(cell, k, m, height(cell, k) + BIAS[m] + (r.gauss(0, 1e-3) if n else 50.0 * (k % 9 == 0 and m == "b" and k > 40)), n) for cell in range(4) for m, (lo, hi) in LIFE.items() for k in range(lo, hi) for n in (0, 1, 2)]
    rows += [(1, 5, "x", 1.0, 0), (1, None, "a", 1.0, 0), (2, 7, None, 1.0, 0), (2, 8, "a", None, 0), (2, 9, "a", float("nan"), 0), (77, 3, "a", 1.0, 0)]
    return spark.createDataFrame(rows, "cell long, k long, m string, h double, n int").repartition(3)


def test_biases_are_chained_through_missions_between(missions):
    q = crosscal.monthly(missions, "cell", "k", "m", "h")
    got = {(g.cell, g.m): g for g in crosscal.chained_biases(q, "cell", "k", "m", "h").collect()}
    assert {k[0] for k in got} == {0, 1, 2, 3} and len(got) == 16  # x and cell 77 have too few epochs
    for cell in range(4):
        a, b, c, d = (got[cell, m] for m in "abcd")
        assert (a.parent, b.parent, c.parent, d.parent) == (None, "a", "b", "c") and (a.common, b.common, c.common, d.common) == (0, 10, 10, 0)
        assert (a.bias, b.bias, c.bias) == pytest.approx((0.0, 3.0, -2.0), abs=0.06)  # smoothed ends bend a little
        assert d.bias == pytest.approx(7.5 + 11 * 0.05, abs=0.3)  # over a gap the trend is in the step


def test_fused_series_has_one_level(missions):
    got = {(g.cell, g.k): g for g in crosscal.chained_series(missions.where("m <> 'd'"), "cell", "k", "m", "h", reference=60).collect()}
    assert {k for c, k in got if c == 0} == set(range(120))
    assert max(abs(g.h - 0.05 * (k - 60)) for (c, k), g in got.items()) < 0.2
    assert got[0, 35].missions == 2 and got[0, 60].h == 0.0


def test_the_widest_overlaps_make_the_tree():
    import numpy as np

    span = lambda lo, hi, bias: (np.arange(lo, hi), np.full(hi - lo, float(bias)))
    tree = crosscal.overlap_tree({"p": span(0, 20, 0), "q": span(18, 60, 5), "r": span(10, 50, 2)})
    assert [(m, parent, common) for m, parent, _, common in tree] == [("p", None, 0), ("r", "p", 10), ("q", "r", 32)]
    assert [bias for *_, bias, _ in tree] == [0.0, 2.0, 5.0]
    assert crosscal.overlap_tree({}) == []


def test_no_rows_no_biases(missions):
    assert crosscal.chained_biases(missions.limit(0), "cell", "k", "m", "h").count() == 0
