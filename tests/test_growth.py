"""Steps that must not hold or make more than their input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from firnline.operators import bins, fits, gridblocks, layout, raster, spatial


def cloud(spark, n, seed):
    r = random.Random(seed)
    rows = [(k, r.uniform(-0.3, 0.3), r.uniform(-0.3, 0.3), None if k % 17 == 3 else r.gauss(0, 1)) for k in range(n)]
    rows += [(n, None, 0.1, 1.0), (n + 1, float("nan"), 0.1, 1.0), (n + 2, rows[0][1], rows[0][2], 2.0)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double")


@pytest.mark.parametrize("block", [7, 1000])
def test_lag_products_counted_in_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(bins, "BLOCK", block)
    c = cloud(spark, 150, 5)
    want = {r.k: r for r in bins.lag_covariance(spatial.lag_pairs(c, "pid", 0.2), "l_z", "r_z", "dist", 0.02).collect()}
    got = {r.k: r for r in bins.binned_products(c, "pid", "z", 0.2, 0.02).collect()}
    assert want.keys() == got.keys() and all(got[k].n == want[k].n and abs(got[k].cov - want[k].cov) < 1e-12 and got[k].lag == want[k].lag for k in want)
    assert bins.binned_products(c.limit(0), "pid", "z", 0.2, 0.02).count() == 0


def test_lag_covariance_queries_make_no_pairs(spark, monkeypatch):
    from __spark_entry__ import queries

    monkeypatch.setattr(spatial, "radius_join", None)
    for name in ("agg7_lag_covariance", "fit10_covariance_model", "fit10_robust_covariance"):
        assert queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_nearest_within_makes_no_pairs_of_a_dense_cloud(spark, monkeypatch):
    a, b = cloud(spark, 120, 6), cloud(spark, 120, 7)
    pairs = spatial.radius_join(a, b, 0.02).groupBy("l_pid").agg(F.min(F.struct("d2", "r_pid")).alias("m"))
    want = {r.l_pid: r.m.r_pid for r in pairs.collect()}
    monkeypatch.setattr(spatial, "radius_join", None)
    got = spatial.nearest_within(a, b, 0.02, "pid", "pid", clip=False)
    assert want and {r.l_pid: r.r_pid for r in got.collect()} == want


def test_plane_of_large_groups_needs_no_window(spark):
    c = cloud(spark, 60, 8).withColumns({"z": 3 + 2 * F.col("x") - F.col("y"), "g": F.lit(1)})
    q = fits.plane_trend(c, ["g"], "x", "y", "z")
    assert "Window" not in q._jdf.queryExecution().optimizedPlan().toString()
    r = q.where("not isnan(a)").first() or fits.plane_trend(c.where("not isnan(x)"), ["g"], "x", "y", "z").first()
    assert abs(r.a - 2) < 1e-9 and abs(r.b + 1) < 1e-9 and abs(r.c - 3) < 1e-9


def test_cells_are_dealt_to_more_tasks_as_the_table_grows(spark, monkeypatch):
    from __spark_entry__ import queries

    monkeypatch.setattr(layout, "ROWS", 5_000, raising=False)
    for name in ("flagship_height_change", "cub22_summary_fields", "cub23_trend_acceleration", "cub19_dem_series", "prj13_cyclic_difference"):
        assert queries()[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 12, name


def test_buffer_classes_look_no_farther_than_they_reach(spark, monkeypatch):
    r = random.Random(9)
    at = {(a + i, b + j) for a, b in ((-6, 250), (90_000, -70_000)) for i in range(14) for j in range(14) if r.random() < 0.9}
    rows = [(i, j, r.random() < 0.03) for i, j in sorted(at)]
    zeros = [(i, j) for i, j, z in rows if z]
    c = spark.createDataFrame([*rows, (None, 3, True)], "i long, j long, zero boolean")
    monkeypatch.setattr(gridblocks, "squared_distance", None)
    got = {(q.i, q.j): q["class"] for q in raster.buffer_class(c, F.col("zero"), 5).collect()}
    want = {(i, j): min((math.ceil(math.hypot(i - a, j - b)) for a, b in zeros if math.hypot(i - a, j - b) <= 5), default=None) for i, j, _ in rows}
    assert zeros and None in want.values() and got == {**want, (None, 3): None}


def test_scattering_corrections_need_no_frame_of_a_cell(spark, monkeypatch):
    r = random.Random(10)
    rows = [(c, None if k == 4 else (1 << 60) + 100 * (c or 0) + k, k / 12, 2 * p + k / 12 if k != 7 else None, p) for c in (1, 2, None) for k, p in ((k, r.gauss(0, 1)) for k in range(80 if c != 2 else 20))]
    df = spark.createDataFrame(rows, "cell long, pid long, t double, h double, p double").repartition(5)
    monkeypatch.setattr(fits, "by_group", None)
    got = fits.scattering_correction(df, "cell", "pid", "t", "h", ["p"]).collect()
    assert len(got) == len(rows) and {q.pid for q in got} == {q[1] for q in rows}
    assert sum(q.h_bs is None for q in got) == 3 and sum(q.b_p == 0 for q in got) == 20
    assert all(abs(q.b_p) > 0.1 and q.r2 > 0.9 for q in got if q.b_p)


def test_pairs_of_a_dense_cloud_are_dealt_to_tasks(spark, monkeypatch):
    """A small cloud of many pairs is not joined in a few tasks, whatever the sizes of the sides say; pairs at the radius count."""
    from __spark_entry__ import queries

    c = cloud(spark, 200, 11).unionByName(spark.createDataFrame([(900, 0.0, 0.0, 1.0), (901, 0.25, 0.0, 1.0), (902, -0.25, 0.0, 1.0)], "pid long, x double, y double, z double"))
    want = sorted((q.l_pid, q.r_pid) for q in spatial.radius_join(c, c, 0.25).collect())
    monkeypatch.setattr(spatial, "PAIRS", 500, raising=False)
    for name in ("jn1_radius_join", "jn15_lag_pairs"):
        assert queries()[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 25, name
    got = sorted((q.l_pid, q.r_pid) for q in spatial.dealt_radius_join(c, c, 0.25).collect())
    assert got == want and (900, 901) in got and (902, 900) in got
    by = spatial.dealt_radius_join(c.withColumn("m", F.col("pid") % 3), c.withColumn("m", F.col("pid") % 3), 0.25, by=("m",))
    assert sorted((q.l_pid, q.r_pid) for q in by.collect()) == [p for p in want if p[0] % 3 == p[1] % 3]
    assert spatial.dealt_radius_join(c.limit(0), c, 0.25).count() == 0
