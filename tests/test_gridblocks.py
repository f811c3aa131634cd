"""Blocks with halos: the same as one dense array, for any block width; exact distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.operators import gridblocks, raster


@pytest.fixture(scope="module")
def field(spark):
    r = random.Random(5)
    rows = [(g, i, j, None if r.random() < 0.15 else r.gauss(0, 10), f"{i}/{j}") for g in ("p", None) for i in range(-13, 24) for j in range(5, 40) if r.random() < 0.93]
    return spark.createDataFrame(rows, "g string, i long, j int, z double, name string").repartition(4)


def dense(field, g, pad):
    rows = [q for q in field.collect() if q.g == g]
    a = np.full((37 + 2 * pad, 35 + 2 * pad), np.nan)
    for q in rows:
        if q.z is not None:
            a[q.i + 13 + pad, q.j - 5 + pad] = q.z
    return a, {(q.i, q.j) for q in rows}


def cells(df):
    out = {(q.g, q.i, q.j): q for q in df.collect()}
    assert all(q.name == f"{q.i}/{q.j}" for q in out.values())
    return out


def agree(got, want, there, g, column="z"):
    assert {k[1:] for k in got if k[0] == g} == there
    for (i, j) in there:
        v, w = got[g, i, j][column], want[i + 13, j - 5]
        assert (v is None and np.isnan(w)) or v == pytest.approx(w, rel=1e-9, abs=1e-9), (i, j, v, w)


@pytest.mark.parametrize("side", [4, 7, 1000])
def test_gaussian_is_the_plain_sum_for_any_block_width(field, monkeypatch, side):
    monkeypatch.setattr(gridblocks, "SIDE", side)
    got = cells(raster.gaussian_fill(field, "z", 1.7, half=4, only_missing=False, extra=["g"]))
    for g in ("p", None):
        a, there = dense(field, g, 4)
        want = np.full((37, 35), np.nan)
        for i in range(37):
            for j in range(35):
                w = np.exp(-(np.add.outer(np.arange(-4, 5) ** 2, np.arange(-4, 5) ** 2)) / (2 * 1.7**2))
                v = a[i : i + 9, j : j + 9]
                ok = np.isfinite(v)
                want[i, j] = (w[ok] * v[ok]).sum() / w[ok].sum() if ok.any() else np.nan
        agree(got, want, there, g)


@pytest.mark.parametrize("side", [6, 1000])
def test_median_and_low_pass(field, monkeypatch, side):
    monkeypatch.setattr(gridblocks, "SIDE", side)
    med, low = cells(raster.median_filter(field, 5, "z", extra=["g"])), cells(raster.low_pass(field, 3, "z", extra=["g"]))
    for g in ("p", None):
        a, there = dense(field, g, 2)
        win = lambda i, j, h: a[i + 2 - h : i + 3 + h, j + 2 - h : j + 3 + h]
        many = np.array([[np.median(v[np.isfinite(v)]) if np.isfinite(v := win(i, j, 2)).any() else np.nan for j in range(35)] for i in range(37)])
        mean = np.array([[v.mean() if np.isfinite(v := win(i, j, 1)).all() else a[i + 2, j + 2] for j in range(35)] for i in range(37)])
        agree(med, many, there, g)
        agree(low, mean, there, g)


def test_extending_a_field_goes_one_width_after_another(field, monkeypatch):
    monkeypatch.setattr(gridblocks, "SIDE", 8)
    one = field.where("g = 'p'")
    got = cells(raster.extend_field(one, "z", [1.0, 2.5]))
    step = raster.gaussian_fill(raster.gaussian_fill(one, "z", 1.0, half=2), "z", 2.5, half=5)
    for k, q in cells(step).items():
        assert got[k].z == pytest.approx(q.z, rel=1e-9)


def test_gradient_keeps_other_columns_and_asks_for_whole_neighbourhoods(field):
    got = cells(raster.horn_gradient(field, "z", 2.0, 3.0, extra=["g"]))
    a, there = dense(field, "p", 1)
    want = np.full((37, 35), np.nan)
    for i in range(37):
        for j in range(35):
            v = a[i : i + 3, j : j + 3]
            want[i, j] = ((v[2] - v[0]) @ [1, 2, 1]) / 16 if np.isfinite(v).all() else np.nan
    agree(got, want, there, "p", "dzdx")
    assert got["p", min(there)[0], min(there)[1]].dzdy is None


@pytest.mark.parametrize("share", [0.004, 0.2])
def test_distances_are_exact_however_far(field, share):
    zero = F.pmod(F.xxhash64("g", "i", "j"), F.lit(1000)) < int(share * 1000)
    marked = field.withColumn("zero", zero)
    rows = marked.collect()
    got = cells(raster.distance_to(marked, F.col("zero"), extra=["g"]))
    assert len(got) == len(rows)
    for g in ("p", None):
        zeros = np.array([(q.i, q.j) for q in rows if q.g == g and q.zero])
        assert len(zeros)
        for q in rows:
            if q.g == g:
                assert got[g, q.i, q.j].distance == pytest.approx(np.hypot(zeros[:, 0] - q.i, zeros[:, 1] - q.j).min(), abs=1e-9)


def test_no_zero_no_distance_and_no_cells_no_rows(field):
    one = field.where("g = 'p'")
    assert {q.distance for q in raster.distance_to(one, F.lit(False)).collect()} == {None}
    assert raster.distance_to(one.limit(0), F.lit(True)).count() == 0
    assert raster.median_filter(one.limit(0), 3, "z").count() == 0
    assert raster.buffer_class(one, F.col("i") == 0, 5).where("(class is null) <> (distance > 5) or class <> ceil(distance)").count() == 0
