"""Queries of raster and cube operators, over a grid of mean heights by cell and year."""

from __future__ import annotations


from pyspark.sql import functions as F

from firnline.functions import columns as C
from firnline.operators import alongtrack, layout, raster, robust

from .registry import points, query

_GRID_SQL = "(select floor(y / 5000.0e0)::bigint as j, (line + 7 * floor(x / 20000.0e0))::bigint as i, round(avg(h) * 1.4142135623730951e0, 12) as z from {points} group by 1, 2)"
_CUBE_SQL = "(select floor(x / 20000.0e0)::bigint as i, floor(y / 10000.0e0)::bigint as j, floor(t_year)::bigint as k, round(avg(h) * 1.4142135623730951e0, 12) as v from {points} group by 1, 2, 3)"


def _grid(spark, sf):
    p = points(spark, sf).withColumns({"j": F.floor(F.col("y") / 5000.0), "i": (F.col("line") + 7 * F.floor(F.col("x") / 20000.0)).cast("long")})
    return layout.spread(p, ["i", "j"]).groupBy("j", "i").agg(F.round(F.avg("h") * 1.4142135623730951, 12).alias("z"))


def _cube(spark, sf):
    p = points(spark, sf).withColumns({"i": F.floor(F.col("x") / 20000.0), "j": F.floor(F.col("y") / 10000.0)})
    return layout.spread(p, ["i", "j"]).groupBy("i", "j", F.floor("t_year").alias("k")).agg(F.round(F.avg("h") * 1.4142135623730951, 12).alias("v"))


_NEAR = "from {grid} a join {grid} b on abs(a.i - b.i) <= {k} and abs(a.j - b.j) <= {k}"


def _near(k: int) -> str:
    return _NEAR.replace("{grid}", _GRID_SQL).replace("{k}", str(k))


@query("cub1_gaussian_fill", f"with g as (select i, j, case when z > 90 then null else z end as z from {_GRID_SQL}) select a.i, a.j, round(coalesce(any_value(a.z), sum(case when b.z is not null then exp(-(pow(a.i-b.i, 2) + pow(a.j-b.j, 2)) / (2 * 1.5e0 * 1.5e0)) * b.z end) / sum(case when b.z is not null then exp(-(pow(a.i-b.i, 2) + pow(a.j-b.j, 2)) / (2 * 1.5e0 * 1.5e0)) end)), 6) as z from g a join g b on abs(a.i-b.i) <= 3 and abs(a.j-b.j) <= 3 group by 1, 2")
def cub1(spark, sf):
    g = _grid(spark, sf).withColumn("z", F.when(F.col("z") <= 90, F.col("z")))
    return raster.gaussian_fill(g, "z", 1.5, half=3).select("i", "j", F.round("z", 6).alias("z"))


@query("cub2_median_filter", f"select a.i, a.j, round(median(b.z), 6) as z {_near(1)} group by 1, 2")
def cub2(spark, sf):
    return raster.median_filter(_grid(spark, sf), 3, "z").select("i", "j", F.round("z", 6).alias("z"))


_SG = raster.savgol2d_weights(5, 2, "x")
_SG_CASE = "case (a.i - a.i) " if False else "case " + " ".join(f"when b.i - a.i = {a} and b.j - a.j = {b} then {w!r}::double" for (a, b), w in _SG.items()) + " end"


@query("cub3_savgol_2d", f"select a.i, a.j, round(case when count(*) = 25 then sum({_SG_CASE} * b.z) end, 6) as dzdx {_near(2)} group by 1, 2")
def cub3(spark, sf):
    return raster.savgol2d(_grid(spark, sf), 5, 2, "z", "x").select("i", "j", F.round("z", 6).alias("dzdx"))


@query("cub4_low_pass", f"select a.i, a.j, round(case when count(*) = 25 then avg(b.z) else any_value(a.z) end, 6) as z {_near(2)} group by 1, 2")
def cub4(spark, sf):
    return raster.low_pass(_grid(spark, sf), 5, "z").select("i", "j", F.round("z", 6).alias("z"))


@query("cub5_horn_gradient", f"select a.i, a.j, round(case when count(*) = 9 then sum((b.i-a.i) * (2 - abs(b.j-a.j)) / 16.0e0 * b.z) end, 6) as dzdx, round(case when count(*) = 9 then sum((b.j-a.j) * (2 - abs(b.i-a.i)) / 24.0e0 * b.z) end, 6) as dzdy {_near(1)} group by 1, 2")
def cub5(spark, sf):
    return raster.horn_gradient(_grid(spark, sf), "z", 2.0, 3.0).select("i", "j", F.round("dzdx", 6).alias("dzdx"), F.round("dzdy", 6).alias("dzdy"))


@query("cub6_hillshade", f"""
with g as (select a.i, a.j, case when count(*) = 9 then sum((b.i-a.i) * (2 - abs(b.j-a.j)) / 240.0e0 * b.z) end as gx, case when count(*) = 9 then sum((b.j-a.j) * (2 - abs(b.i-a.i)) / 240.0e0 * b.z) end as gy {_near(1)} group by 1, 2),
s as (select *, sin(radians(45)) * cos(atan(sqrt(gx*gx + gy*gy))) + cos(radians(45)) * sin(atan(sqrt(gx*gx + gy*gy))) * cos(radians(360.0e0 - 315.0e0 + 90.0e0) - atan2(gy, -gx)) as s from g)
select i, j, floor(255 * (s - min(s) over ()) / (max(s) over () - min(s) over ()))::int as shade from s""")
def cub6(spark, sf):
    return raster.hillshade(_grid(spark, sf), "z", 30.0, 30.0).select("i", "j", "shade")


@query("cub7_flux_divergence", f"""
with g as (select i, j, z, 10 + 0.3e0 * i as u, 5 - 0.2e0 * j as v from {_GRID_SQL}),
d as (select a.i, a.j, any_value(a.z) as z, any_value(a.u) as u, any_value(a.v) as v, case when count(*) = 9 then sum((b.i-a.i) / 6.0e0 * b.u) / 3000 end as ux, case when count(*) = 9 then sum((b.j-a.j) / 6.0e0 * b.v) / 3000 end as vy, case when count(*) = 9 then sum((b.i-a.i) / 6.0e0 * b.z) / 3000 end as zx, case when count(*) = 9 then sum((b.j-a.j) / 6.0e0 * b.z) / 3000 end as zy from g a join g b on abs(a.i-b.i) <= 1 and abs(a.j-b.j) <= 1 group by 1, 2)
select i, j, round(z * (ux + vy) + u * zx + v * zy, 8) as div, round(z * (ux + vy), 8) as stretching, round(u * zx + v * zy, 8) as advection from d""")
def cub7(spark, sf):
    g = _grid(spark, sf).withColumns({"u": 10 + 0.3 * F.col("i"), "v": 5 - 0.2 * F.col("j")})
    q = raster.flux_divergence(g, "z", "u", "v", 3000.0, 3000.0)
    return q.select("i", "j", *[F.round(c, 8).alias(c) for c in ("div", "stretching", "advection")])


@query("cub9_buffer_classes", f"with g as (select *, z > 85 as zero from {_GRID_SQL}) select a.i, a.j, ceil(min(sqrt(pow(a.i-b.i, 2) + pow(a.j-b.j, 2))))::int as class from g a left join g b on b.zero and pow(a.i-b.i, 2) + pow(a.j-b.j, 2) <= 25 group by 1, 2")
def cub9(spark, sf):
    return raster.buffer_class(_grid(spark, sf), F.col("z") > 85, 5).select("i", "j", "class")


@query("cub10_masks", f"select i, j, (floor(z) % 3 in (0, 1))::int as grounded, (floor(z) % 3 = 2)::int as floating from {_GRID_SQL}")
def cub10(spark, sf):
    g = _grid(spark, sf).withColumn("kind", F.floor("z") % 3)
    return raster.classes(g, "kind", {"grounded": [0, 1], "floating": [2]}).select("i", "j", "grounded", "floating")


@query("cub12_firn_series", f"select i, j, k, round(avg(v) over w, 6) as v from {_CUBE_SQL} window w as (partition by i, j order by k rows between 1 preceding and 1 following)")
def cub12(spark, sf):
    return alongtrack.running_mean(_cube(spark, sf), ["i", "j"], ["k"], "v", 1, "m", ends="shrink").select("i", "j", "k", F.round("m", 6).alias("v"))


@query("cub14_cube_filter", f"""
with f as (select *, v - (regr_intercept(v, k) over (partition by i, j) + regr_slope(v, k) over (partition by i, j) * k) as r from {_CUBE_SQL}), m as (select *, median(r) over (partition by i, j) as md from f), s as (select *, 1.4826e0 * median(abs(r - md)) over (partition by i, j) as sd from m),
c as (select i, j, k, case when abs(r - md) <= 2 * sd then v end as v from s), g as (select *, last_value(v ignore nulls) over b as bv, last_value(case when v is not null then k end ignore nulls) over b as bk, first_value(v ignore nulls) over a as av, first_value(case when v is not null then k end ignore nulls) over a as ak from c window b as (partition by i, j order by k rows between unbounded preceding and current row), a as (partition by i, j order by k rows between current row and unbounded following))
select i, j, k, round(coalesce(v, bv + (av - bv) * (k - bk) / nullif(ak - bk, 0)::double, bv, av), 6) as v from g""")
def cub14(spark, sf):
    """Series outliers out, gaps filled by lines."""
    q = robust.series_std_filter(_cube(spark, sf), ["i", "j"], "k", "v", 2.0)
    return alongtrack.fill_linear(q, ["i", "j"], "k", "v", "f").select("i", "j", "k", F.round("f", 6).alias("v"))


@query("cub15_melt", f"""
with d as (select *, case when lag(v) over w is null then lead(v) over w - v when lead(v) over w is null then v - lag(v) over w else (lead(v) over w - lag(v) over w) / 2 end as dh from {_CUBE_SQL} window w as (partition by i, j order by k))
select i, j, round(avg(dh + (0.1e0 * i - 0.05e0 * j) - 0.3e0), 6) as melt, round(avg(dh * 917.0e-12) * 1e9, 6) as mass from d group by i, j""")
def cub15(spark, sf):
    q = alongtrack.gradient(_cube(spark, sf), ["i", "j"], "k", "v", "dh").withColumn("div", 0.1 * F.col("i") - 0.05 * F.col("j"))
    m, w = C.melt_rate(F.col("dh"), F.col("div"), F.lit(0.3)), C.mass_rate(F.col("dh"))
    return q.groupBy("i", "j").agg(F.round(F.avg(m), 6).alias("melt"), F.round(F.avg(w) * 1e9, 6).alias("mass"))


@query("cub16_thickness", f"select i, j, k, round((v - first_value(v) over (partition by i, j order by abs(k - 1998), k rows between unbounded preceding and unbounded following)) * (1028.0e0 / 111.0e0), 6) as thickness_change from {_CUBE_SQL}")
def cub16(spark, sf):
    q = alongtrack.relative_to_epoch(_cube(spark, sf), ["i", "j"], "k", "v", 1998, "dv")
    return q.select("i", "j", "k", F.round(C.thickness(F.col("dv")), 6).alias("thickness_change"))


@query("cub17_error_cube", f"""
with f as (select *, v - (regr_intercept(v, k) over (partition by i, j) + regr_slope(v, k) over (partition by i, j) * k) as r from {_CUBE_SQL}), m as (select *, median(r) over (partition by i, j) as md from f), s as (select *, 1.4826e0 * median(abs(r - md)) over (partition by i, j) as e from m)
select i, j, k, round(sqrt(e*e + 0.01e0) * (1028.0e0 / 111.0e0), 6) as err_h, round(2 * abs(v) * (5.0e0 / 3000.0e0), 6) as err_div from s""")
def cub17(spark, sf):
    q = robust.deviation(robust.detrended(_cube(spark, sf), ["i", "j"], "k", "v", "r"), ["i", "j"], "r", "d")
    return q.select("i", "j", "k", F.round(C.thickness_error(F.col("d_std"), F.lit(0.1)), 6).alias("err_h"), F.round(C.divergence_error(F.col("v")), 6).alias("err_div"))


@query("cub23_trend_acceleration", f"select i, j, round(regr_slope(v, k), 6) as trend, count(*) as n from {_CUBE_SQL} group by 1, 2")
def cub23(spark, sf):
    return _cube(spark, sf).groupBy("i", "j").agg(F.round(F.regr_slope("v", "k"), 6).alias("trend"), F.count("*").alias("n"))


@query("int10_regrid_bilinear", f"""
with n as (select i * 1000 + j as node, 0.5e0 + i * (33 / 41.0e0) as x, 0.5e0 + j * (18 / 25.0e0) as y from range(0, 42) t(i), range(0, 26) u(j)), p as (select node, least(greatest(x - 1, 0), 34) as fi, least(greatest(y, 0), 19) as fj from n where x between 1 and 35 and y between 0 and 19),
c as (select *, least(floor(fi), 33)::bigint as i0, least(floor(fj), 18)::bigint as j0 from p), k as (select node, fi, fj, i0 + a as i, j0 + b as j from c, (values (0), (1)) s(a), (values (0), (1)) t(b)),
v as (select node, (1 - abs(fi - k.i)) * (1 - abs(fj - k.j)) as w, g.z from k left join {_GRID_SQL} g on g.i = k.i and g.j = k.j), r as (select node, case when count(*) filter (where z is null and w > 0) = 0 then sum(coalesce(w * z, 0)) end as z from v group by node)
select n.node::int as node, round(r.z, 6) as z from n left join r on n.node = r.node""")
def int10(spark, sf):
    from firnline.operators.interpolation import grid

    nodes = grid(spark, 0.5, 33.5, 0.5, 18.5, 0.8, 0.7).select((F.col("i") * 1000 + F.col("j")).alias("node"), "x", "y")
    g = raster.regrid(nodes, _grid(spark, sf), 1.0, 0.0, 1.0, 1.0, 35, 20, "z", "node")
    return g.select("node", F.round("z", 6).alias("z"))


@query("flt5_raster_mask", f"select orbit, line, x, y from {{points}} p join (select i, j, z > 75 as keep from {_GRID_SQL}) g on g.i = p.line + 7 * floor(p.x / 20000.0e0) and g.j = floor(p.y / 5000.0e0) where keep")
def flt5(spark, sf):
    """Points whose cell of a mask is set."""
    mask = _grid(spark, sf).select("i", "j", (F.col("z") > 75).alias("keep"))
    p = points(spark, sf).withColumns({"i": (F.col("line") + 7 * F.floor(F.col("x") / 20000.0)).cast("long"), "j": F.floor(F.col("y") / 5000.0)})
    return p.join(mask.where("keep"), ["i", "j"], "left_semi").select("orbit", "line", "x", "y")
