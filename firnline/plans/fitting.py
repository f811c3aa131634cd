"""Queries of grouped fits and of filters that fit."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from firnline.operators import crosscal, fits, interpolation, scattering
from firnline.operators.layout import cut

from .registry import cloud, points, query, series, tracks


#: Nodes so far apart leave no point farther than 4 km, the radius of the fits, from one of them.
FIT_STEP = 5000.0


def _r(df, keys, values, n=6):
    return df.select(*keys, *[F.round(v, n).alias(v) for v in values])


def _nodes(spark, points, step):
    """Nodes at multiples of `step`: the corners of the cells that hold points, numbered as in the grid around all points.

    A node whose cells are empty has no point nearer than `step`, so fits within less have none there.
    """
    low_x, high_x, low_y, high_y = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if low_x is None or low_y is None:
        low_x = low_y = high_x = high_y = 0.0
    i, j = math.floor(low_x / step), math.floor(low_y / step)
    nx, ny = math.ceil(high_x / step) - i + 1, math.ceil(high_y / step) - j + 1
    cells = points.select(F.floor(F.col("x") / step).alias("i"), F.floor(F.col("y") / step).alias("j")).dropna().distinct()
    both = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1)).alias(c)
    n = cells.select(both("i"), "j").select("i", both("j")).distinct().where((F.col("i") < i + nx) & (F.col("j") < j + ny))
    return n.select(((F.col("i") - i) * ny + F.col("j") - j).alias("node"), (F.col("i") * step).alias("x"), (F.col("j") * step).alias("y"))


def _pid(spark, sf):
    return points(spark, sf).withColumn("pid", F.xxhash64("orbit", "line", "x", "y", "h"))


@query("fit1_plane", """
with m as (select mission, x / 1000 - avg(x / 1000) over (partition by mission) as xx, y / 1000 - avg(y / 1000) over (partition by mission) as yy, x / 1000 as x, y / 1000 as y, h from {points}),
s as (select mission, sum(xx*xx) as xx, sum(xx*yy) as xy, sum(yy*yy) as y2, sum(xx*h) as xv, sum(yy*h) as yv, avg(x) as mx, avg(y) as my, avg(h) as mv, count(*) as n from m group by mission), k as (select *, (xv*y2 - yv*xy) / (xx*y2 - xy*xy) as a, (yv*xx - xv*xy) / (xx*y2 - xy*xy) as b from s)
select mission, round(a, 6) as a, round(b, 6) as b, round(mv - a*mx - b*my, 6) as c, n from k""")
def fit1(spark, sf):
    p = points(spark, sf).withColumns({"x": F.col("x") / 1000, "y": F.col("y") / 1000})
    return fits.plane_trend(p, ["mission"], "x", "y", "h").select("mission", *[F.round(c, 6).alias(c) for c in "abc"], "n")


@query("fit3_elevation_change")
def fit3(spark, sf):
    p = points(spark, sf)
    q = fits.elevation_change(_nodes(spark, p, FIT_STEP), p, "node", "t_year", "h", 4000.0)
    return _r(q, ["node", "nobs"], ["p0", "p1", "p2", "amplitude", "phase", "rmse", "tspan"])


@query("fit3_elevation_series")
def fit3_series(spark, sf):
    """Monthly height changes of half-yearly windows about each node, its centre moved to its points."""
    p = points(spark, sf)
    model = fits.SurfaceModel(surface=2, sigma="s", space_scale=2500.0)
    q = fits.elevation_series(_nodes(spark, p, FIT_STEP), p, "node", "t_year", "h", 4000.0, 1992.0, 1 / 12, 0.5, 84, relocations=2, model=model)
    return _r(q, ["node", "k", "n"], ["time", "height", "variance"], 5)


@query("fit4_robust_line")
def fit4(spark, sf):
    return _r(fits.robust_line(tracks(spark, sf).withColumn("d", (F.col("t") - 1704067200) / 86400), "orbit", "d", "h"), ["orbit", "n"], ["slope", "level"])


@query("fit5_topography_residuals")
def fit5(spark, sf):
    p = _pid(spark, sf).dropDuplicates(["pid"])
    q = fits.topography_residuals(_nodes(spark, p, FIT_STEP), p, "node", "pid", "t_year", "h", 4000.0)
    return _r(q, ["pid", "node", "order"], ["res", "mod", "err", "slope_x", "slope_y"], 5)


@query("fit7_scattering_correction")
def fit7(spark, sf):
    q = fits.scattering_correction(_pid(spark, sf).dropDuplicates(["pid"]), "y", "pid", "t_year", "h", ["bs", "lew", "tes"])
    return _r(q, ["pid"], ["h_bs", "r2", "d_std", "b_bs", "b_lew", "b_tes"], 5)


#: Cells of this radius hold some 70 points at sf0.1 and their neighbours' halves.
SCATTER_R, SCATTER_STEP = 6000.0, 8000.0


@query("fit6_best_cell_correction")
def fit6(spark, sf):
    """Of the overlapping cells around each point, the correction that lowers the spread most."""
    p = _pid(spark, sf).dropDuplicates(["pid"])
    q = scattering.correction_of_best_cell(_nodes(spark, p, SCATTER_STEP), p, "node", "pid", "t_year", "h", ["bs", "lew", "tes"], SCATTER_R, least=30, min_months=12)
    return _r(q, ["pid", "node"], ["h_bs", "r2", "d_std", "p_std", "b_bs", "b_lew", "b_tes"], 5)


@query("fit7_spread_correction")
def fit7_spread(spark, sf):
    """Corrections by the best solved cell within reach, else by the nearest solved one."""
    p = _pid(spark, sf)
    solved = cut(scattering.cell_solutions(_nodes(spark, p, SCATTER_STEP), p, "node", "t_year", "h", ["bs", "lew", "tes"], SCATTER_R, error="s", pid="pid"))
    return _r(scattering.spread_correction(solved, p, "pid", ["bs", "lew", "tes"], SCATTER_R), ["pid", "node", "inside"], ["h_bs", "r2"], 5)


@query("fit8_fused_series")
def fit8(spark, sf):
    q = fits.fused(points(spark, sf), "y", "t_year", "mission", "h")
    return _r(q, ["orbit", "line", "y", "mission"], ["fused"], 5)


@query("fit9_cross_calibration")
def fit9(spark, sf):
    return _r(fits.cross_calibrate(points(spark, sf), "y", "t_year", "mission", "h"), ["y", "mission"], ["offset"], 5)


def _epochs(spark, sf):
    """Heights by cell, month and mission; the missions are three times as many, of shorter lives."""
    p = points(spark, sf)
    k = F.floor((F.col("t_year") - 1992.0) * 12.0)
    return p.withColumns({"k": k, "mission": F.concat("mission", (F.floor(k / 24) % 3).cast("string"))})


@query("fit9_chained_biases")
def fit9_chained(spark, sf):
    q = crosscal.monthly(_epochs(spark, sf), "y", "k", "mission", "h")
    return _r(crosscal.chained_biases(q, "y", "k", "mission", "h"), ["y", "mission", "parent", "common"], ["bias"], 5)


@query("fit9_chained_series")
def fit9_series(spark, sf):
    return _r(crosscal.chained_series(_epochs(spark, sf), "y", "k", "mission", "h", reference=36), ["y", "k", "missions"], ["h"], 5)


@query("fit10_covariance_model")
def fit10(spark, sf):
    from firnline.operators import bins

    c = cloud(spark, sf)
    c = c.join(F.broadcast(c.agg(F.avg("z").alias("m")))).withColumn("z", F.col("z") - F.col("m"))
    # a covariance table has as many rows as lags, so its model is fitted on the driver
    rows = bins.binned_products(c, "pid", "z", 0.3, 0.02).orderBy("k").collect()
    out = [(kind, *map(float, interpolation.fit_covariance([r["lag"] for r in rows], [r["cov"] for r in rows], kind))) for kind in ("gauss", "markov", "generic", "exp")]
    return _r(spark.createDataFrame(out, "model string, c0 double, a double, misfit double"), ["model"], ["c0", "a", "misfit"])


@query("fit10_robust_covariance")
def fit10_robust(spark, sf):
    """Robust covariance models of the cloud's medians by lag, with their lengths."""
    from firnline.operators import bins

    c = cut(cloud(spark, sf))
    c = c.withColumn("z", F.col("z") - F.lit(c.agg(F.avg("z")).first()[0] or 0.0))
    rows = bins.binned_products(c, "pid", "z", 0.3, 0.02).orderBy("k").collect()
    out = [(kind, *interpolation.robust_covariance([r["lag"] for r in rows], [r["cov"] for r in rows], kind).values()) for kind in ("gauss", "markov", "generic", "exp")] if len(rows) > 2 else []
    q = spark.createDataFrame(out, "model string, c0 double, a double, misfit double, half double, efold double, zero double")
    return _r(q, ["model"], ["c0", "a", "misfit", "half", "efold", "zero"])


@query("out5_sigma_filter")
def out5(spark, sf):
    t = tracks(spark, sf).withColumn("d", (F.col("t") - 1704067200) / 86400)
    return fits.sigma_filter(t, "orbit", "pid", "d", "h", n_sigma=1.5, window=3.0)


@query("out6_sigma_filter_bins")
def out6(spark, sf):
    t = tracks(spark, sf).withColumn("d", (F.col("t") - 1704067200) / 86400)
    return fits.sigma_filter(t, "orbit", "pid", "d", "h", n_sigma=1.5, window=3.0, by_bins=True)


@query("out9_block_fit_filter")
def out9(spark, sf):
    p = _pid(spark, sf).dropDuplicates(["pid"]).withColumn("cell", (F.floor(F.col("x") / 10000) * 1_000_000_000 + F.floor(F.col("y") / 10000)).cast("long"))
    return fits.block_fit_filter(p, "cell", "pid", "x", "y", "h", n_sigma=2.0)


@query("out11_space_time_filter")
def out11(spark, sf):
    p = _pid(spark, sf).dropDuplicates(["pid"])
    return fits.space_time_filter(_nodes(spark, p, 2 * 4090.9), p, "node", "pid", "t_year", "h", 6000.0, 4090.9, n_sigma=2.0)


@query("out19_series_filter")
def out19(spark, sf):
    return _r(fits.series_filter(series(spark, sf), "cell", "k", "v", n_sigma=3.0), ["cell", "k"], ["v"])
