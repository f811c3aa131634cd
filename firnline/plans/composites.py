"""Queries that compose operators into the longer chains: fields, corrections, pre-filters, mosaics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from firnline.functions import columns as C
from firnline.functions import tides
from firnline.operators import alongtrack, fits, interpolation, layout, raster, robust, spatial, triangulation
from firnline.sources import readers

from .grids import _CUBE_SQL, _GRID_SQL, _cube, _grid
from .neighbours import _NODES_SQL, _RASTER_SQL, _nodes, _raster
from .registry import cloud, points, query, series, table, tracks


@query("prj8_centre_normalise", """
with m as (select *, h - median(h) over (partition by y) as c, h - avg(h) over (partition by y) as d from {points}), s as (select *, stddev_pop(h) over (partition by y) as sd, 1.4826e0 * median(abs(h - md)) over (partition by y) as mad from (select *, median(h) over (partition by y) as md from m))
select orbit, line, round(c, 7) as centred_median, round(d, 7) as centred_mean, round(c / sd, 7) as by_std, round(d / mad, 7) as by_mad from s""")
def prj8(spark, sf):
    w = Window.partitionBy("y")
    q = robust.deviation(points(spark, sf), ["y"], "h", "c").withColumns({"d": F.col("h") - F.avg("h").over(w), "sd": F.stddev_pop("h").over(w)})
    return q.select("orbit", "line", F.round("c", 7).alias("centred_median"), F.round("d", 7).alias("centred_mean"), F.round(F.col("c") / F.col("sd"), 7).alias("by_std"), F.round(F.col("d") / F.col("c_std"), 7).alias("by_mad"))


@query("prj13_cyclic_difference", f"""
with r as (select *, row_number() over (partition by i, j order by k) - 1 as p, count(*) over (partition by i, j) as n from {_CUBE_SQL})
select a.i, a.j, a.k, round(sqrt(a.v * a.v + b.v * b.v), 7) as err from r a join r b on a.i = b.i and a.j = b.j and b.p = (a.p - 3 + 3 * a.n) % a.n""")
def prj13c(spark, sf):
    """Error of a difference over three steps of a cyclic series."""
    w = Window.partitionBy("i", "j")
    q = _cube(spark, sf).withColumns({"all": F.array_sort(F.collect_list(F.struct("k", "v")).over(w)), "p": F.row_number().over(w.orderBy("k")) - 1})
    n = F.size("all")
    other = F.get("all", F.pmod(F.col("p") - 3, n))["v"]
    return q.select("i", "j", "k", F.round(C.root_sum_square(F.col("v"), other), 7).alias("err"))


@query("out12_global_filter", """
with f as (select *, h - (regr_intercept(h, t_year - 1998) over () + regr_slope(h, t_year - 1998) over () * (t_year - 1998)) as r from {points}), m as (select *, median(r) over () as md from f), s as (select *, 1.4826e0 * median(abs(r - md)) over () as sd from m)
select mission, count(*) filter (where abs(r - md) <= 1.5e0 * sd) as kept, count(*) as n from s group by mission""")
def out12(spark, sf):
    """One line and one spread for the whole table; medians by ranges of values, not in one task."""
    p = points(spark, sf).withColumn("t", F.col("t_year") - 1998)
    b, a = p.agg(F.regr_slope("h", "t"), F.regr_intercept("h", "t")).first()
    q = layout.cut(p.select("mission", (F.col("h") - F.lit(a) - F.lit(b) * F.col("t")).alias("r")))
    off = q.withColumn("off", F.abs(F.col("r") - F.lit(layout.median_of_all(q, "r"))))
    most = F.lit(layout.median_of_all(off, "off")) * robust.MAD_SCALE * 1.5
    return off.groupBy("mission").agg(F.count_if(F.col("off") <= most).alias("kept"), F.count("*").alias("n"))


@query("out20_mission_filter", """
with m as (select cell, k, v, list_median(list(v) over (partition by cell order by k rows between 1 preceding and 1 following)) as md from {series}), c as (select cell, k, case when abs(v - md) <= 10 then v end as v from m),
g as (select *, last_value(v ignore nulls) over b as bv, last_value(case when v is not null then k end ignore nulls) over b as bk, first_value(v ignore nulls) over a as av, first_value(case when v is not null then k end ignore nulls) over a as ak from c window b as (partition by cell order by k rows between unbounded preceding and current row), a as (partition by cell order by k rows between current row and unbounded following))
select cell, k, round(coalesce(v, bv + (av - bv) * (k - bk) / nullif(ak - bk, 0)::double, bv, av), 8) as v from g""")
def out20(spark, sf):
    """Running median of three, absolute limit about it, gaps filled."""
    near = F.collect_list("v").over(Window.partitionBy("cell").orderBy("k").rowsBetween(-1, 1))
    q = series(spark, sf).withColumn("near", near)
    q = q.withColumn("v", F.when(F.abs(F.col("v") - robust.median_of("near")) <= 10, F.col("v"))).drop("near")
    return alongtrack.fill_linear(q, ["cell"], "k", "v", "f").select("cell", "k", F.round("f", 8).alias("v"))


@query("out21_series_prefilter")
def out21(spark, sf):
    """Frequent values out, then what is far from the trend."""
    t = tracks(spark, sf).withColumn("d", (F.col("t") - 1704067200) / 86400)
    return fits.sigma_filter(robust.mode_filter(t, ["orbit"], "h"), "orbit", "pid", "d", "h", order=2, n_sigma=2.0, window=3.0)


@query("win6_recursive_mean", """
with recursive r as (select cell, k, v, row_number() over (partition by cell order by k) as p, count(*) over (partition by cell) as n from {series}),
f as (select cell, k, p, v as s from r where p = 1 union all select r.cell, r.k, r.p, case when r.p = r.n then r.v else (f.s + r.v + x.v) / 3 end from f join r on r.cell = f.cell and r.p = f.p + 1 left join r x on x.cell = r.cell and x.p = r.p + 1)
select cell, k, round(s, 7) as s from f""")
def win6r(spark, sf):
    """A mean of three that uses the left neighbour as already smoothed: a fold over each series."""
    rows = F.array_sort(F.collect_list(F.struct("k", "v")))
    s = series(spark, sf).groupBy("cell").agg(rows.alias("a"))
    n = F.size("a")
    start = F.array(F.get("a", F.lit(0))["v"])
    fold = F.aggregate(F.sequence(F.lit(1), n - 1), start, lambda acc, p: F.array_append(acc, F.when(p == n - 1, F.get("a", p)["v"]).otherwise((F.get(acc, p - 1) + F.get("a", p)["v"] + F.get("a", p + 1)["v"]) / 3)))
    out = s.select("cell", F.explode(F.arrays_zip(F.col("a.k").alias("k"), F.when(n > 1, fold).otherwise(start).alias("s"))).alias("r"))
    return out.select("cell", "r.k", F.round("r.s", 7).alias("s"))


@query("set6_join_series_tiles", "select cell, list(round(v, 9) order by k)::varchar is not null as whole, count(*) as n, round(sum(v), 5) as total from {series} group by cell")
def set6(spark, sf):
    """Series as arrays, tiles joined, and back to rows."""
    s = series(spark, sf).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("sec"))
    both = s.where("cell <= 50").unionByName(s.where("cell > 50"))
    return both.select("cell", F.explode("sec").alias("r")).groupBy("cell").agg(F.lit(True).alias("whole"), F.count("*").alias("n"), F.round(F.sum("r.v"), 5).alias("total"))


@query("fit11_seasonal_fit")
def fit11(spark, sf):
    """Trend, acceleration, and amplitude and phase of the year, of each cell's monthly series."""

    def fit(k, g):
        import numpy as np

        g = g.dropna().sort_values("k")
        if len(g) < 12:
            return []
        t = g["k"].to_numpy(float) / 12
        c, _, _ = fits.lstsq(fits.surface_design(t - t.mean(), t, t, trend=2, surface=0, season=True), g["v"].to_numpy(), 5, 5.0)
        return [(k, c[1], c[2], float(np.hypot(c[3], c[4])), float(np.arctan2(c[3], c[4])))]

    q = fits.by_group(series(spark, sf), "cell", fit, "cell long, trend double, accel double, amplitude double, phase double")
    return q.select("cell", *[F.round(c, 6).alias(c) for c in ("trend", "accel", "amplitude", "phase")])


@query("fit12_track_spline")
def fit12(spark, sf):
    """Cubic interpolation along each track at its middle time, through the four samples around it."""

    def fit(k, g):
        import numpy as np

        g = g.dropna().sort_values(["t", "pid"]).drop_duplicates("t")
        if len(g) < 4:
            return []
        t, h = g["t"].to_numpy(), g["h"].to_numpy()
        at = (t[0] + t[-1]) / 2
        j = int(np.clip(np.searchsorted(t, at) - 2, 0, len(t) - 4))
        x, y = t[j : j + 4], h[j : j + 4]
        w = [math.prod((at - x[m]) / (x[i] - x[m]) for m in range(4) if m != i) for i in range(4)]
        return [(k, float(at), float(np.dot(w, y)))]

    q = fits.by_group(tracks(spark, sf), "orbit", fit, "orbit long, t double, h double")
    return q.select("orbit", F.round("t", 3).alias("t"), F.round("h", 5).alias("h"))


@query("int5_octant_collocation")
def int5(spark, sf):
    c = cloud(spark, sf).withColumn("s", F.lit(0.02))
    q = interpolation.kriging(_nodes(spark), c, "node", "pid", "z", "s", 2, 0.2, 0.1, "generic", sectors=8)
    return q.select("node", F.round("z", 6).alias("z"), F.round("err", 6).alias("err"), "n")


@query("int6_space_time_interpolation")
def int6_space_time(spark, sf):
    """Optimal interpolation in space and time from the nearest points of eight directions."""
    c = cloud(spark, sf).withColumns({"s": F.lit(0.05), "t": F.col("pid") % 12, "track": F.col("pid") % 20})
    q = interpolation.optimal(_nodes(spark), c, "node", "z", "s", "t", "track", 0.2, 0.1, least=8, track_error=0.02, tau=6.0, t_ref=6.0, sectors=8, per_sector=12)
    return q.select("node", "n", *[F.round(v, 7).alias(v) for v in ("z", "err", "t_mean", "d_mean")])


@query("int9_scattered_regrid", f"with k as (select a.node, b.z, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2, row_number() over (partition by a.node order by (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.pid) as r from {_NODES_SQL} a, {{cloud}} b) select node, round(sum(z / d2) / sum(1 / d2), 8) as z from k where r <= 3 and d2 <= 0.09e0 group by node")
def int9(spark, sf):
    """Scattered data to nodes by the three nearest points (in place of a triangulation)."""
    return interpolation.inverse_distance(_nodes(spark), cloud(spark, sf), "node", "pid", "z", 3, 0.3, 0.05).select("node", F.round("z", 8).alias("z"))


@query("int9_linear_regrid")
def int9_linear(spark, sf):
    """Scattered data to nodes by the Delaunay triangles that hold them."""
    return triangulation.linear(_nodes(spark), cloud(spark, sf), "node", "z", 0.25, 0.05).select("node", F.round("z", 8).alias("z"))


@query("cub8_extend_field")
def cub8(spark, sf):
    g = _grid(spark, sf).withColumn("z", F.when(F.col("z") <= 80, F.col("z")))
    return raster.extend_field(g, "z", [1.0, 2.0], F.col("j") >= 1).select("i", "j", F.round("z", 6).alias("z"))


@query("cub11_mean_sea_level", f"""
with m as (select r.i, r.j, z - 0.1e0 * r.i as mdt, j >= 10 as ocean from {_GRID_SQL} r), o as (select avg(mdt) as off from m where ocean) select i, j, round(mdt - off + 0.1e0 * i, 6) as msl from m, o""")
def cub11(spark, sf):
    """Dynamic topography relative to the open ocean, back on the geoid."""
    g = _grid(spark, sf).withColumns({"geoid": 0.1 * F.col("i"), "mdt": F.col("z") - 0.1 * F.col("i")})
    off = g.where("j >= 10").agg(F.avg("mdt").alias("off"))
    return g.join(F.broadcast(off)).select("i", "j", F.round(F.col("mdt") - F.col("off") + F.col("geoid"), 6).alias("msl"))


@query("cub13_cube_resample", f"select i // 2 as i, j // 2 as j, k, round(avg(v), 7) as v from {_CUBE_SQL} group by 1, 2, 3")
def cub13(spark, sf):
    return _cube(spark, sf).groupBy(F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j"), "k").agg(F.round(F.avg("v"), 7).alias("v"))


@query("cub18_masked_regrid", f"""
with m as (select i, j, k, case when i between 1 and 2 and j between 2 and 4 and abs(v) > 75 then null else v end as v from {_CUBE_SQL}) select m.i * 2 + a.d as i, m.j * 2 + b.d as j, k, v from m, (values (0), (1)) a(d), (values (0), (1)) b(d)""")
def cub18(spark, sf):
    """Values over a limit inside a box out, then every cell split in four."""
    from firnline.operators import filters

    q = filters.clamp_boxes(_cube(spark, sf), "v", [(1, 2, 2, 4, 75.0)], "i", "j")
    two = F.sequence(F.lit(0), F.lit(1))
    q = q.withColumn("a", F.explode(two)).withColumn("b", F.explode(two))
    return q.select((F.col("i") * 2 + F.col("a")).alias("i"), (F.col("j") * 2 + F.col("b")).alias("j"), "k", "v")


@query("cub19_dem_series", f"with d as (select i, j, avg(v) as dem from {_CUBE_SQL} group by 1, 2), r as (select i, j, (arg_max(v, k) - arg_min(v, k)) / nullif(max(k) - min(k), 0)::double as rate from {_CUBE_SQL} group by 1, 2) select i, j, k, round(dem + rate * (k - 1998), 7) as h, round(rate, 7) as rate from {_CUBE_SQL} join d using (i, j) join r using (i, j)")
def cub19(spark, sf):
    c = _cube(spark, sf)
    d = c.groupBy("i", "j").agg(F.avg("v").alias("dem"), F.try_divide(F.max_by("v", "k") - F.min_by("v", "k"), F.max("k") - F.min("k")).alias("rate"))
    return c.join(d, ["i", "j"]).select("i", "j", "k", F.round(C.height_at(F.col("dem"), F.col("rate"), F.col("k") - 1998), 7).alias("h"), F.round("rate", 7).alias("rate"))


@query("cub20_filled_dem")
def cub20(spark, sf):
    """Gaps filled, median, then a finer grid."""
    g = _grid(spark, sf).withColumn("z", F.when(F.col("z") <= 85, F.col("z")))
    g = raster.median_filter(raster.gaussian_fill(g, "z", 1.5, 4), 3, "z")
    nodes = interpolation.grid(spark, 2, 30, 1, 18, 0.9, 0.9).select((F.col("i") * 1000 + F.col("j")).alias("node"), "x", "y")
    return raster.regrid(nodes, g, 1.0, 0.0, 1.0, 1.0, 35, 20, "z", "node").select("node", F.round("z", 6).alias("z"))


@query("cub21_velocity_fields", f"with s as (select i, j, k, v from {_CUBE_SQL} where k <> 1998), g as (select i, j, k, v, last_value(v) over (partition by i, j order by k) as f from s) select c.i, c.j, c.k, coalesce(s.v, (select arg_max(x.v, x.k) from s x where x.i = c.i and x.j = c.j and x.k < c.k), (select arg_min(x.v, x.k) from s x where x.i = c.i and x.j = c.j and x.k > c.k)) as v from {_CUBE_SQL} c left join s on s.i = c.i and s.j = c.j and s.k = c.k")
def cub21(spark, sf):
    """A year without data, filled from the year before, else after."""
    c = _cube(spark, sf).withColumn("v", F.when(F.col("k") != 1998, F.col("v")))
    return alongtrack.fill_both(c, ["i", "j"], "k", "v", "f").select("i", "j", "k", F.col("f").alias("v"))


@query("cub22_summary_fields", f"select i, j, round(avg(v), 7) as mean, round(regr_slope(v, k), 7) as trend, count(*) as n from {_CUBE_SQL} group by 1, 2")
def cub22(spark, sf):
    return _cube(spark, sf).groupBy("i", "j").agg(F.round(F.avg("v"), 7).alias("mean"), F.round(F.regr_slope("v", "k"), 7).alias("trend"), F.count("*").alias("n"))


@query("cub24_mask_resample", f"select pid, coalesce(z > 12, false) as inside from (select pid, floor((x + 0.5e0) / 0.05e0 + 0.5e0)::bigint as i, floor((y + 0.5e0) / 0.05e0 + 0.5e0)::bigint as j from {{cloud}}) left join {_RASTER_SQL} using (i, j)")
def cub24(spark, sf):
    mask = _raster(spark).select("i", "j", (F.col("z") > 12).alias("m"))
    q = raster.sample_nearest(cloud(spark, sf).select("pid", "x", "y"), mask, -0.5, -0.5, 0.05, 0.05, "m")
    return q.select("pid", F.coalesce("m", F.lit(False)).alias("inside"))


@query("tid7_constituent_sampling", f"""
with p as (select pid, least(greatest((x + 0.5e0) / 0.05e0, 0), 20) as fi, least(greatest((y + 0.5e0) / 0.05e0, 0), 20) as fj from {{cloud}}), c as (select *, least(floor(fi), 19)::bigint as i0, least(floor(fj), 19)::bigint as j0 from p),
s as (select pid, sum((1 - abs(fi - r.i)) * (1 - abs(fj - r.j)) * z) as re, sum((1 - abs(fi - r.i)) * (1 - abs(fj - r.j)) * (z - 20)) as im from c join {_RASTER_SQL} r on r.i between i0 and i0 + 1 and r.j between j0 and j0 + 1 group by pid)
select pid, round(sqrt(re*re + im*im), 6) as amplitude, round(case when degrees(atan2(-im, re)) < 0 then degrees(atan2(-im, re)) + 360 else degrees(atan2(-im, re)) end, 5) as phase from s""")
def tid7(spark, sf):
    """Amplitude and phase lag of a constituent at points, from rasters of its two parts."""
    c, g = cloud(spark, sf).select("pid", "x", "y"), _raster(spark)
    args = (-0.5, -0.5, 0.05, 0.05, 21, 21, "z", "pid")
    re = raster.sample(c, g, *args).withColumnRenamed("z", "re")
    im = raster.sample(c, g.withColumn("z", F.col("z") - 20), *args).withColumnRenamed("z", "im")
    lag = F.degrees(F.atan2(-F.col("im"), F.col("re")))
    return re.join(im, "pid").select("pid", F.round(F.hypot("re", "im"), 6).alias("amplitude"), F.round(F.when(lag < 0, lag + 360).otherwise(lag), 5).alias("phase"))


@query("tid9_inverse_barometer_correction", f"""
with p as (select pid, z, least(greatest((x + 0.5e0) / 0.05e0, 0), 20) as fi, least(greatest((y + 0.5e0) / 0.05e0, 0), 20) as fj from {{cloud}}), c as (select *, least(floor(fi), 19)::bigint as i0, least(floor(fj), 19)::bigint as j0 from p),
s as (select pid, any_value(c.z) as z, sum((1 - abs(fi - r.i)) * (1 - abs(fj - r.j)) * (101325 + 50 * r.z)) as pr from c join {_RASTER_SQL} r on r.i between i0 and i0 + 1 and r.j between j0 and j0 + 1 group by pid)
select pid, round(z + (pr - 101325) / (1028.0e0 * 9.80665e0), 6) as h from s""")
def tid9(spark, sf):
    c = cloud(spark, sf)
    at = raster.sample(c.select("pid", "x", "y"), _raster(spark).withColumn("p", 101325 + 50 * F.col("z")).drop("z"), -0.5, -0.5, 0.05, 0.05, 21, 21, "p", "pid")
    ibe = C.inverse_barometer(F.col("p"), F.lit(101325.0))
    return c.join(at, "pid").select("pid", F.round(C.corrected(F.col("z"), [ibe]), 6).alias("h"))


@query("src2_ascii_columns", "select part, part * 1.5e0 as a, (-part)::double as b from (select p_partkey as part from part)")
def src2(spark, sf):
    k = F.col("p_partkey")
    lines = table(spark, sf, "part").select(F.explode(F.array(F.lit("# part, a and b"), F.format_string("  %s  %s,%s", k, k * 1.5, -k), F.lit(" "))).alias("value"))
    return readers.parsed_columns(lines, ["part", "a", "b"]).withColumn("part", F.col("part").cast("long"))


@query("src5_ascii_grid", "select r_regionkey as region, j, i, 10.0e0 + i as x, j::double as y, ((1 - j) * 3 + i + r_regionkey)::double as z from region, (select unnest(range(0, 3))::int as i), (select unnest(range(0, 2))::int as j)")
def src5(spark, sf):
    r = table(spark, sf, "region")
    text = F.concat(F.lit("0 1 10 12 1 1 "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k + F.col("r_regionkey")).cast("string")), " "))
    q = readers.grid_rows(r.select(F.col("r_regionkey").alias("path"), text.alias("value")))
    return q.select(F.col("path").alias("region"), "j", "i", "x", "y", "z")


@query("src17_polygon_regions", "select n_nationkey as nation, count(*) as n from nation, {cloud} where x between n_nationkey * 0.01e0 - 0.15e0 and n_nationkey * 0.01e0 - 0.05e0 and y between -0.1e0 and 0.1e0 group by 1")
def src17(spark, sf):
    """Points in many polygons, through the cells that the polygons' boxes touch."""
    n = table(spark, sf, "nation").withColumns({"x": F.col("n_nationkey") * 0.01 - 0.15, "x2": F.col("n_nationkey") * 0.01 - 0.05, "y": F.lit(-0.1), "y2": F.lit(0.1)})
    c = cloud(spark, sf).withColumns({"x2": F.col("x"), "y2": F.col("y")})
    q = spatial.overlapping_boxes(n, c, ("x", "x2", "y", "y2"), 0.1)
    corners = (("l_x", "l_y"), ("l_x2", "l_y"), ("l_x2", "l_y2"), ("l_x", "l_y2"))
    ring = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in corners])
    return q.where(spatial.in_polygon(F.col("r_x"), F.col("r_y"), ring)).groupBy(F.col("l_n_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("jn14_same_track_pairs", "select a.mission, count(*) as n, round(sum(a.z * b.z), 6) as zz from {cloud} a join {cloud} b on a.mission = b.mission and a.pid <> b.pid and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.04e0 group by 1")
def jn14(spark, sf):
    c = cloud(spark, sf)
    q = spatial.radius_join(c, c, 0.2, by=("mission",)).where("l_pid <> r_pid")
    return q.groupBy(F.col("l_mission").alias("mission")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_z") * F.col("r_z")), 6).alias("zz"))


@query("tid_all_models_longitudes")
def longitudes(spark, sf):
    """The three formulas for the mean longitudes, side by side."""
    d = tracks(spark, sf).withColumn("mjd", F.col("t") / 86400 + 40587.0)
    out = ["orbit", "pid"]
    for kind in ("linear", "centuries", "days"):
        lon = tides.longitudes(F.col("mjd"), kind)
        out += [F.round(lon[k], 5).alias(f"{k}_{kind}") for k in ("s", "h", "p", "n")]
    return d.select(*out)


@query("set2_tiles_by_size", "select mission, floor(x / 25000)::bigint as tile, count(*) as n from {points} group by 1, 2")
def set2t(spark, sf):
    p = points(spark, sf)
    low_x, high_x, low_y, high_y = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    (a, b), (c, d) = ((math.floor((low or 0) / 25000), math.floor((high or 0) / 25000) + 1) for low, high in ((low_x, high_x), (low_y, high_y)))
    t = layout.tile(p, (a * 25000.0, b * 25000.0), (c * 25000.0, d * 25000.0), 25000.0, closed=False)
    return t.groupBy("mission", (F.col("tile_x") + a).cast("long").alias("tile")).agg(F.count("*").alias("n"))
