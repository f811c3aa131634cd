"""Queries of binned and grouped statistics, and the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from firnline.operators import bins, layout, robust, spatial

from .registry import cloud, points, query, series, tracks

_BINS = """b as (select *, unnest(range(greatest(0, ceil((t_year - 0.25e0 - 1995.0e0) / 0.1e0)::int), least(69, floor((t_year - 1995.0e0) / 0.1e0)::int) + 1))::int as k from {points} where h is not null)"""


@query("agg1_overlap_bins", f"""
with {_BINS}, m as (select *, median(h) over (partition by mission, k) as md from b),
a as (select mission, k, avg(h) as yb, 1.4826e0 * median(abs(h - md)) as eb, count(h) as nb from m group by mission, k)
select g.mission, g.k, round(yb, 6) as yb, round(eb, 6) as eb, coalesce(nb, 0) as nb, round(1995.0e0 + g.k * 0.1e0 + 0.125e0, 6) as xb
from (select distinct mission, k::int as k from {{points}}, range(0, 70) t(k)) g left join a using (mission, k)""")
def agg1(spark, sf):
    q = bins.binned(points(spark, sf), ["mission"], "t_year", "h", 1995.0, 2002.0, 0.1, 0.25)
    return q.select("mission", "k", F.round("yb", 6).alias("yb"), F.round("eb", 6).alias("eb"), "nb", F.round("xb", 6).alias("xb"))


@query("agg1_overlap_bins_clipped", f"""
with {_BINS}, s as (select *, avg(h) over (partition by mission, k) as a, stddev_pop(h) over (partition by mission, k) as sd from b), c as (select * from s where abs(h - a) <= 1.5e0 * sd)
select mission, k, round(avg(h), 6) as yb, round(stddev_pop(h), 6) as eb, count(h) as nb from c group by mission, k""")
def agg1c(spark, sf):
    q = bins.binned(points(spark, sf), ["mission"], "t_year", "h", 1995.0, 2002.0, 0.1, 0.25, clip=1.5, robust_error=False, empty=False)
    return q.select("mission", "k", F.round("yb", 6).alias("yb"), F.round("eb", 6).alias("eb"), "nb")


@query("agg2_resample", """
with b as (select *, unnest(range(greatest(0, ceil((t_year - 0.25e0 - (1995.0e0 - 0.125e0)) / 0.1e0)::int), least(69, floor((t_year - (1995.0e0 - 0.125e0)) / 0.1e0)::int) + 1))::int as k from {points}),
m as (select *, median(h) over (partition by mission, k) as md from b), s as (select *, 1.4826e0 * median(abs(h - md)) over (partition by mission, k) as sd from m), c as (select * from s where abs(h - md) <= 1.5e0 * sd),
a as (select *, sum(s * h) over (partition by mission, k) / sum(s) over (partition by mission, k) as w from c)
select mission, k, round(sum(s * h) / sum(s), 6) as yi, round(sum(s * (h - w) * (h - w)) / sum(s), 5) as ei, count(*) as ni, round(1995.0e0 + k * 0.1e0, 6) as xi from a group by mission, k""")
def agg2(spark, sf):
    q = bins.resampled(points(spark, sf), ["mission"], "t_year", "h", "s", 1995.0, 0.1, 0.25, 70, 1.5)
    return q.select("mission", "k", F.round("yi", 6).alias("yi"), F.round("ei", 5).alias("ei"), "ni", F.round("xi", 6).alias("xi"))


@query("agg3_summary", "select y, round(median(h), 6) as med, round(avg(h), 6) as mean, round(stddev_pop(h), 6) as std, min(h) as low, max(h) as high, count(h) as n, round(max(t_year) - min(t_year), 6) as span from {points} group by y")
def agg3(spark, sf):
    q = bins.summary(points(spark, sf), ["y"], "h", "t_year")
    return q.select("y", *[F.round(c, 6).alias(c) for c in ("med", "mean", "std")], "low", "high", "n", F.round("span", 6).alias("span"))


@query("agg4_correlation", "select mission, round(corr(h, bs), 6) as r_bs, round(corr(h, lew), 6) as r_lew, round(corr(h, tes), 6) as r_tes from {points} group by mission")
def agg4(spark, sf):
    q = bins.correlations(points(spark, sf), ["mission"], "h", ["bs", "lew", "tes"])
    return q.select("mission", *[F.round(f"r_{c}", 6).alias(f"r_{c}") for c in ("bs", "lew", "tes")])


@query("agg5_sensitivity", "select y, round(regr_slope(h, bs), 6) as s_bs, round(regr_slope(h, lew), 6) as s_lew, round(regr_slope(h, tes), 6) as s_tes from {points} group by y")
def agg5(spark, sf):
    q = bins.correlations(points(spark, sf), ["y"], "h", ["bs", "lew", "tes"])
    return q.select("y", *[F.round(f"s_{c}", 6).alias(f"s_{c}") for c in ("bs", "lew", "tes")])


@query("agg6_std_trend_change", """
with p as (select y, t_year - 1998 as t, h as a, h - 0.01e0 * bs as b from {points}),
d as (select *, a - (regr_intercept(a, t) over w + regr_slope(a, t) over w * t) as ra, b - (regr_intercept(b, t) over w + regr_slope(b, t) over w * t) as rb from p window w as (partition by y)),
m as (select *, median(ra) over (partition by y) as ma, median(rb) over (partition by y) as mb from d)
select y, round(sqrt(avg((ra - rb) * (ra - rb))), 6) as rmse, round(1.4826e0 * median(abs(rb - mb)) - 1.4826e0 * median(abs(ra - ma)), 6) as d_std, round(regr_slope(b, t) - regr_slope(a, t), 6) as d_trend from m group by y""")
def agg6(spark, sf):
    p = points(spark, sf).select("y", (F.col("t_year") - 1998).alias("t"), F.col("h").alias("a"), (F.col("h") - 0.01 * F.col("bs")).alias("b"))
    q = robust.detrended(robust.detrended(p, ["y"], "t", "a", "ra"), ["y"], "t", "b", "rb")
    q = robust.deviation(robust.deviation(q, ["y"], "ra", "da"), ["y"], "rb", "db")
    out = q.groupBy("y").agg(F.sqrt(F.avg((F.col("ra") - F.col("rb")) ** 2)).alias("rmse"), (F.first("db_std") - F.first("da_std")).alias("d_std"), (F.regr_slope("b", "t") - F.regr_slope("a", "t")).alias("d_trend"))
    return out.select("y", *[F.round(c, 6).alias(c) for c in ("rmse", "d_std", "d_trend")])


@query("agg7_lag_covariance", """
with z as (select pid, x, y, z - avg(z) over () as z from {cloud}), p as (select a.z * b.z as zz, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) as d from z a join z b on a.pid < b.pid where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.04e0)
select floor(d / 0.02e0)::bigint as k, round(avg(zz), 8) as cov, count(*) as n, round((floor(d / 0.02e0) + 0.5e0) * 0.02e0, 6) as lag from p group by 1, 4 having count(*) >= 15""")
def agg7(spark, sf):
    c = cloud(spark, sf)
    c = c.join(F.broadcast(c.agg(F.avg("z").alias("m")))).withColumn("z", F.col("z") - F.col("m"))
    q = bins.binned_products(c, "pid", "z", 0.2, 0.02)
    return q.select("k", F.round("cov", 8).alias("cov"), "n", F.round("lag", 6).alias("lag"))


@query("agg8_isotropic_covariance_by_mission", """
with z as (select pid, mission, x, y, z - avg(z) over (partition by mission) as z from {cloud}), p as (select a.mission, a.z * b.z as zz, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) as d from z a join z b on a.pid < b.pid and a.mission = b.mission where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.09e0)
select mission, floor(d / 0.05e0)::bigint as k, round(avg(zz), 8) as cov, count(*) as n from p group by 1, 2 having count(*) >= 3""")
def agg8(spark, sf):
    c = cloud(spark, sf).withColumn("z", F.col("z") - F.avg("z").over(Window.partitionBy("mission")))
    pairs = spatial.lag_pairs(c, "pid", 0.3, by=("mission",)).withColumnRenamed("l_mission", "mission")
    q = bins.lag_covariance(pairs, "l_z", "r_z", "dist", 0.05, 3, ["mission"])
    return q.select("mission", "k", F.round("cov", 8).alias("cov"), "n")


@query("agg9_autocovariance", """
with z as (select orbit, t, pid, h - avg(h) over (partition by orbit) as z, var_pop(h) over (partition by orbit) as v, row_number() over (partition by orbit order by t, pid) as r from {tracks}),
s as (select a.orbit, l.lag::int as lag, coalesce(sum(a.z * b.z), 0) as s, any_value(a.v) as v from z a cross join range(0, 6) l(lag) left join z b on a.orbit = b.orbit and b.r = a.r + l.lag group by 1, 2)
select s.orbit, s.lag, round(s.s / nullif(o.s, 0) * s.v, 6) as cov from s join s o on s.orbit = o.orbit and o.lag = 0""")
def agg9(spark, sf):
    return bins.autocovariance(tracks(spark, sf), ["orbit"], ["t", "pid"], "h", 5).select("orbit", "lag", F.round("cov", 6).alias("cov"))


@query("agg10_weighted_mean_variance", "select y, round(sum(s * h) / sum(s), 6) as mean, round(sum(s * h * h) / sum(s) - pow(sum(s * h) / sum(s), 2), 5) as var from {points} group by y")
def agg10(spark, sf):
    return points(spark, sf).groupBy("y").agg(F.round(bins.weighted_mean("h", "s"), 6).alias("mean"), F.round(bins.weighted_variance("h", "s"), 5).alias("var"))


@query("agg11_slice_means", "select k, round(avg(v), 6) as mean, round(quantile_cont(v, 0.02), 6) as lo, round(quantile_cont(v, 0.98), 6) as hi from {series} group by k")
def agg11(spark, sf):
    return series(spark, sf).groupBy("k").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", 0.02), 6).alias("lo"), F.round(F.percentile("v", 0.98), 6).alias("hi"))


@query("agg12_trend_acceleration", """
with c as (select cell, k - avg(k) over (partition by cell) as t, v from {series}), s as (select cell, count(*) as n, sum(t*t) as s2, sum(t*t*t) as s3, sum(t*t*t*t) as s4, sum(v) as y0, sum(t*v) as y1, sum(t*t*v) as y2 from c group by cell)
select cell, round(y1 / s2, 8) as trend, round((n*s2*y2 - s2*s2*y0 - n*s3*y1) / (n*s2*s4 - s2*s2*s2 - n*s3*s3), 8) as quad from s""")
def agg12(spark, sf):
    from firnline.operators.fits import quadratic

    q = quadratic(series(spark, sf), ["cell"], "k", "v")
    return q.select("cell", F.round("trend", 8).alias("trend"), F.round("quad", 8).alias("quad"))


@query("agg13_mission_median", "select y, floor(t_year * 4)::bigint as q, round(median(m), 8) as fused from (select y, mission, floor(t_year * 4) / 4 as t_year, avg(h) as m from {points} group by 1, 2, 3) group by 1, 2")
def agg13(spark, sf):
    p = points(spark, sf).withColumn("q", F.floor(F.col("t_year") * 4)).groupBy("y", "mission", "q").agg(F.avg("h").alias("m"))
    return p.groupBy("y", "q").agg(F.round(F.median("m"), 8).alias("fused"))


@query("agg14_overlap_bias", """
with m as (select y, mission, floor(t_year * 4)::bigint as q, avg(h) as v from {points} group by 1, 2, 3), a as (select * from m where mission = 'A' and q < 7996), b as (select * from m where mission = 'N' and (q > 7990 or y > 50000)),
c as (select a.y, median(b.v - a.v) as d from a join b on a.y = b.y and a.q = b.q group by 1), e as (select x.y, f - l as d from (select y, arg_max(v, q) as l from a group by 1) x join (select y, arg_min(v, q) as f from b group by 1) z on x.y = z.y)
select e.y, round(coalesce(c.d, e.d), 6) as bias from e left join c on e.y = c.y""")
def agg14(spark, sf):
    m = points(spark, sf).groupBy("y", "mission", F.floor(F.col("t_year") * 4).alias("q")).agg(F.avg("h").alias("v"))
    a, b = m.where("mission = 'A' and q < 7996"), m.where("mission = 'N' and (q > 7990 or y > 50000)")
    return bins.bias(a, b, ["y"], "q", "v").select("y", F.round("bias", 6).alias("bias"))


@query("agg15_volume_change", "select k, round(sum(v * 3000.0e0 * 3000.0e0) / 1e9, 6) as km3 from {series} group by k")
def agg15(spark, sf):
    return series(spark, sf).groupBy("k").agg(F.round(F.sum(F.col("v") * 3000.0 * 3000.0) / 1e9, 6).alias("km3"))


@query("flagship_height_change", """
with p as (select *, floor(x / 10000.0e0)::bigint as i, floor(y / 10000.0e0)::bigint as j from {points}), m as (select *, h - median(h) over (partition by i, j) as d from p), s as (select *, stddev_pop(d) over (partition by i, j) as sd from m),
c as (select * from s where abs(d) <= 2 * sd),
b as (select i, j, unnest(range(greatest(0, ceil((t_year - 0.25e0 - 1995.0e0) / 0.1e0)::int), least(69, floor((t_year - 1995.0e0) / 0.1e0)::int) + 1))::int as k, h from c), g as (select i, j, k, avg(h) as yb, count(h) as nb from b group by all)
select i, j, round(regr_slope(yb, 1995.0e0 + k * 0.1e0 + 0.125e0), 6) as trend, count(*) as n_bins, sum(nb)::bigint as n_values from g group by i, j""")
def flagship(spark, sf):
    """Height change of each cell: outliers out, overlapping bins, trend of the bin means."""
    p = points(spark, sf).withColumns({"i": F.floor(F.col("x") / 10000.0), "j": F.floor(F.col("y") / 10000.0)})
    clean = robust.clip(layout.spread(p, ["i", "j"]), ["i", "j"], "h", 2.0, "std").where(F.col("h").isNotNull())
    b = bins.overlap_bins(clean, ["i", "j"], "t_year", 1995.0, 0.1, 0.25, 70).groupBy("i", "j", "k").agg(F.avg("h").alias("yb"), F.count("h").alias("nb"))
    t = 1995.0 + F.col("k") * 0.1 + 0.125
    return b.groupBy("i", "j").agg(F.round(F.regr_slope(F.col("yb"), t), 6).alias("trend"), F.count("*").alias("n_bins"), F.sum("nb").alias("n_values"))
