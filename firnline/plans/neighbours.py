"""Queries of spatial and temporal joins and of interpolation to nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import crossover, interpolation, raster, spatial

from .grids import _GRID_SQL, _grid
from .registry import cloud, points, query, series, tracks

_D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))"
#: Nodes of a 9 x 9 grid over the cloud.
_NODES_SQL = "(select i * 9 + j as node, -0.2e0 + 0.05e0 * i as x, -0.2e0 + 0.05e0 * j as y from range(0, 9) t(i), range(0, 9) u(j))"


def _nodes(spark):
    n = spark.range(81).withColumnRenamed("id", "node")
    i, j = F.floor(F.col("node") / 9), F.col("node") % 9
    return n.select("node", (-0.2 + 0.05 * i).alias("x"), (-0.2 + 0.05 * j).alias("y"))


@query("jn1_radius_join", f"select a.pid as pid_a, b.pid as pid_b, round({_D2}, 10) as d2 from {{cloud}} a, {{cloud}} b where {_D2} <= 0.0025e0")
def jn1(spark, sf):
    c = cloud(spark, sf)
    return spatial.dealt_radius_join(c, c, 0.05).select(F.col("l_pid").alias("pid_a"), F.col("r_pid").alias("pid_b"), F.round("d2", 10).alias("d2"))


@query("jn2_relocated_radius", """
with c as (select n.node, b.pid, b.x, b.y, n.x as nx, n.y as ny from {nodes} n join {cloud} b on (n.x-b.x)*(n.x-b.x) + (n.y-b.y)*(n.y-b.y) <= 0.01e0), m as (select node, any_value(nx) as nx, any_value(ny) as ny, median(x) as mx, median(y) as my from c group by node),
k as (select node, case when sqrt((mx-nx)*(mx-nx) + (my-ny)*(my-ny)) <= 0.1e0 then mx else nx end as x, case when sqrt((mx-nx)*(mx-nx) + (my-ny)*(my-ny)) <= 0.1e0 then my else ny end as y from m)
select a.node, b.pid from k a join {cloud} b on """.replace("{nodes}", _NODES_SQL) + _D2 + " <= 0.01e0")
def jn2(spark, sf):
    return interpolation.relocated_join(_nodes(spark), cloud(spark, sf), 0.1, "node", times=1).select(F.col("l_node").alias("node"), F.col("r_pid").alias("pid"))


@query("jn3_knn", f"select * from (select a.node, b.pid, row_number() over (partition by a.node order by {_D2}, b.pid) as place from {_NODES_SQL} a, {{cloud}} b) where place <= 5")
def jn3(spark, sf):
    return spatial.knn_join(_nodes(spark), cloud(spark, sf), 5, 0.05, "node", "pid").select(F.col("l_node").alias("node"), F.col("r_pid").alias("pid"), "place")


_SECT = "floor((case when degrees(atan2(b.y-a.y, b.x-a.x)) < 0 then degrees(atan2(b.y-a.y, b.x-a.x)) + 360 else degrees(atan2(b.y-a.y, b.x-a.x)) end) / {w})::int % {n}"


@query("jn4_quadrant_knn", f"select * from (select a.node, b.pid, {_SECT.format(w='90.0e0', n=4)} as sector, row_number() over (partition by a.node, {_SECT.format(w='90.0e0', n=4)} order by {_D2}, b.pid) as place from {_NODES_SQL} a, {{cloud}} b where a.x <> b.x and a.y <> b.y) where place <= 2")
def jn4(spark, sf):
    return spatial.knn_join(_nodes(spark), cloud(spark, sf), 2, 0.1, "node", "pid", sectors=4).select(F.col("l_node").alias("node"), F.col("r_pid").alias("pid"), "sector", "place")


@query("jn5_octant_knn", f"select * from (select a.node, b.pid, {_SECT.format(w='45.0e0', n=8)} as sector, row_number() over (partition by a.node, {_SECT.format(w='45.0e0', n=8)} order by {_D2}, b.pid) as place from {_NODES_SQL} a, {{cloud}} b) where place <= 1")
def jn5(spark, sf):
    return spatial.knn_join(_nodes(spark), cloud(spark, sf), 1, 0.1, "node", "pid", sectors=8).select(F.col("l_node").alias("node"), F.col("r_pid").alias("pid"), "sector", "place")


@query("jn6_nearest_difference", f"""
with a as (select * from {{cloud}} where mission < 5), b as (select * from {{cloud}} where mission >= 5), l as (select greatest((select min(x) from a), (select min(x) from b)) as x1, least((select max(x) from a), (select max(x) from b)) as x2, greatest((select min(y) from a), (select min(y) from b)) as y1, least((select max(y) from a), (select max(y) from b)) as y2),
p as (select a.pid as pa, b.pid as pb, a.z - b.z as dz, a.mission - b.mission as dt, {_D2} as d2, row_number() over (partition by a.pid order by {_D2}, b.pid) as r from a, b, l where a.x > x1 and a.x < x2 and a.y > y1 and a.y < y2 and b.x > x1 and b.x < x2 and b.y > y1 and b.y < y2)
select pa as ref, pb as obs, round(dz, 8) as diff, round(sqrt(d2), 8) as distance from p where r = 1 and d2 <= 0.0025e0 and abs(dt) <= 4""")
def jn6(spark, sf):
    c = cloud(spark, sf)
    q = spatial.nearest_within(c.where("mission < 5"), c.where("mission >= 5"), 0.05, "pid", "pid", "mission", 4)
    return q.select(F.col("l_pid").alias("ref"), F.col("r_pid").alias("obs"), F.round(F.col("l_z") - F.col("r_z"), 8).alias("diff"), F.round(F.sqrt("d2"), 8).alias("distance"))


_SEG = "(select mission as track, row_number() over w as seq, x as x1, y as y1, z as h1, pid::double as t1, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as h2, lead(pid::double) over w as t2 from {cloud} window w as (partition by mission order by pid))"


@query("jn7_track_crossovers", f"""
with p as (select a.track as ta, b.track as tb, a.seq as ka, b.seq as kb, a.x1, a.y1, (b.x1-a.x1) as dx, (b.y1-a.y1) as dy, a.x2-a.x1 as ax, a.y2-a.y1 as ay, b.x2-b.x1 as bx, b.y2-b.y1 as b_y, a.h1 as ah, a.h2 - a.h1 as adh, a.t1 as at1, a.t2 - a.t1 as adt, b.h1 as bh, b.h2 - b.h1 as bdh, b.t1 as bt1, b.t2 - b.t1 as bdt from {_SEG} a, {_SEG} b where a.track < b.track and a.x2 is not null and b.x2 is not null),
u as (select *, (dx*b_y - dy*bx) / nullif(ax*b_y - ay*bx, 0) as u, (dx*ay - dy*ax) / nullif(ax*b_y - ay*bx, 0) as v from p), f as (select *, row_number() over (partition by ta, tb order by ka, u, kb) as r from u where u between 0 and 1 and v between 0 and 1)
select ta as track_1, tb as track_2, round(x1 + u*ax, 6) as x, round(y1 + u*ay, 6) as y, round(ah + u*adh - (bh + v*bdh), 6) as dh, round(at1 + u*adt - (bt1 + v*bdt), 5) as dtime from f where r = 1""")
def jn7(spark, sf):
    c = cloud(spark, sf).withColumn("t", F.col("pid").cast("double"))
    q = crossover.crossovers(c, c, "mission", ["pid"], "t", "z", 0.1, same_table=True)
    return q.select("track_1", "track_2", *[F.round(n, 6).alias(n) for n in ("x", "y", "dh")], F.round("dtime", 5).alias("dtime"))


_RASTER_SQL = "(select i, j, 10.0e0 + 0.5e0 * i - 0.25e0 * j + 0.01e0 * i * j as z from range(0, 21) t(i), range(0, 21) u(j))"


def _raster(spark):
    n = spark.range(441)
    i, j = F.floor(F.col("id") / 21), F.col("id") % 21
    return n.select(i.alias("i"), j.alias("j"), (10.0 + 0.5 * i - 0.25 * j + 0.01 * i * j).alias("z"))


@query("jn9_raster_bilinear", f"""
with p as (select pid, least(greatest((x + 0.5e0) / 0.05e0, 0), 20) as fi, least(greatest((y + 0.5e0) / 0.05e0, 0), 20) as fj from {{cloud}}), c as (select *, least(floor(fi), 19)::bigint as i0, least(floor(fj), 19)::bigint as j0 from p)
select pid, round(sum((1 - abs(fi - r.i)) * (1 - abs(fj - r.j)) * z), 6) as z from c join {_RASTER_SQL} r on r.i between i0 and i0 + 1 and r.j between j0 and j0 + 1 group by pid""")
def jn9(spark, sf):
    return raster.sample(cloud(spark, sf).select("pid", "x", "y"), _raster(spark), -0.5, -0.5, 0.05, 0.05, 21, 21, "z", key="pid").select("pid", F.round("z", 6).alias("z"))


@query("jn9_raster_nearest", f"with p as (select pid, floor((x + 0.5e0) / 0.05e0 + 0.5e0)::bigint as i, floor((y + 0.5e0) / 0.05e0 + 0.5e0)::bigint as j from {{cloud}}) select pid, coalesce(z, 0) as z from p left join {_RASTER_SQL} r using (i, j)")
def jn9n(spark, sf):
    return raster.sample_nearest(cloud(spark, sf).select("pid", "x", "y"), _raster(spark), -0.5, -0.5, 0.05, 0.05, "z", outside=0.0).select("pid", "z")


@query("jn10_cube_trilinear", f"""
with p as (select pid, least(greatest((x + 0.5e0) / 0.05e0, 0), 20) as fi, least(greatest((y + 0.5e0) / 0.05e0, 0), 20) as fj, least(greatest((z + 0.5e0) * 4, 0), 4) as fk from {{cloud}}), c as (select *, least(floor(fi), 19)::bigint as i0, least(floor(fj), 19)::bigint as j0, least(floor(fk), 3)::bigint as k0 from p)
select pid, round(sum((1 - abs(fi - r.i)) * (1 - abs(fj - r.j)) * (1 - abs(fk - k)) * (r.z + 3 * k)), 6) as v from c join {_RASTER_SQL} r on r.i between i0 and i0 + 1 and r.j between j0 and j0 + 1 join range(0, 5) t(k) on k between k0 and k0 + 1 group by pid""")
def jn10(spark, sf):
    cube = _raster(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("v", F.col("z") + 3 * F.col("k")).drop("z")
    p = cloud(spark, sf).select("pid", "x", "y", F.col("z").alias("t"))
    return raster.sample_cube(p, cube, (-0.5, -0.5, -0.5), (0.05, 0.05, 0.25), (21, 21, 5), "v", key="pid").select("pid", F.round("v", 6).alias("v"))


_OBS, _REF = "(select * from {tracks} where kind <> 'view')", "(select * from {tracks} where kind = 'view')"


@query("jn11_nearest_time", f"select a.orbit, a.pid, arg_min(b.h, (abs(a.t - b.t), b.t)) as h_ref from {_OBS} a left join {_REF} b on a.orbit = b.orbit group by 1, 2")
def jn11(spark, sf):
    t = tracks(spark, sf)
    return spatial.nearest_time(t.where("kind <> 'view'"), t.where("kind = 'view'"), ["orbit"], "t", "h", "h_ref").select("orbit", "pid", "h_ref")


@query("jn12_interpolated_asof", f"""
with n as (select a.orbit, a.pid, any_value(a.h) as h, any_value(a.t) as t, max(b.t) filter (where b.t <= a.t) as tb, arg_max(b.h, b.t) filter (where b.t <= a.t) as hb, min(b.t) filter (where b.t >= a.t) as ta, arg_min(b.h, b.t) filter (where b.t >= a.t) as ha from {_OBS} a left join {_REF} b on a.orbit = b.orbit group by 1, 2)
select orbit, pid, round(h - coalesce(hb + (ha - hb) * coalesce((t - tb) / nullif(ta - tb, 0), 0), hb, ha), 6) as dh from n""")
def jn12(spark, sf):
    t = tracks(spark, sf)
    q = spatial.as_of(t.where("kind <> 'view'"), t.where("kind = 'view'"), ["orbit"], "t", "h", "ref")
    return q.select("orbit", "pid", F.round(F.col("h") - F.col("ref"), 6).alias("dh"))


@query("jn13_campaign_lookup", "select orbit, line, campaign from {points} left join (values (1995.0e0, 1996.0e0, 'A1'), (1996.0e0, 1999.5e0, 'B2'), (2000.0e0, 2001.0e0, 'C3')) c(t1, t2, campaign) on t_year >= t1 and t_year < t2")
def jn13(spark, sf):
    c = spark.createDataFrame([(1995.0, 1996.0, "A1"), (1996.0, 1999.5, "B2"), (2000.0, 2001.0, "C3")], "t1 double, t2 double, campaign string")
    return spatial.interval_lookup(points(spark, sf), c, "t_year", "t1", "t2").select("orbit", "line", "campaign")


@query("jn15_lag_pairs", f"select a.pid as a, b.pid as b, round(sqrt({_D2}), 8) as dist from {{cloud}} a join {{cloud}} b on a.pid < b.pid and {_D2} <= 0.0036e0")
def jn15(spark, sf):
    return spatial.lag_pairs(cloud(spark, sf), "pid", 0.06).select(F.col("l_pid").alias("a"), F.col("r_pid").alias("b"), F.round("dist", 8).alias("dist"))


_RING = [(-0.15, -0.1), (0.1, -0.15), (0.15, 0.1), (0.0, 0.02), (-0.1, 0.15)]
_EDGES = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(_RING, _RING[1:] + _RING[:1]))


@query("jn16_point_in_polygon", f"select pid, sum(case when (ay > y) <> (b_y > y) and x < (bx - ax) * (y - ay) / (b_y - ay) + ax then 1 else 0 end) % 2 = 1 as inside from {{cloud}}, (values {_EDGES}) e(ax, ay, bx, b_y) group by pid")
def jn16(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING])
    return cloud(spark, sf).select("pid", spatial.in_polygon(F.col("x"), F.col("y"), ring).alias("inside"))


@query("jn17_coalesce_fields", "select s.cell, s.k, coalesce(case when s.k % 4 = 0 then s.v end, m.v) as v from {series} s left join (select cell, min(v) as v from {series} group by cell) m on s.cell = m.cell")
def jn17(spark, sf):
    s = series(spark, sf)
    static = s.groupBy("cell").agg(F.min("v").alias("v0"))
    return s.join(static, "cell", "left").select("cell", "k", F.coalesce(F.when(F.col("k") % 4 == 0, F.col("v")), "v0").alias("v"))


@query("jn19_poleward_fill", f"with p as (select i, j, case when j > 10 then null else z end as a, z + 1 as b from {_GRID_SQL}) select i, j, round(coalesce(a, case when j >= 10 then b end), 8) as v from p")
def jn19(spark, sf):
    r = _grid(spark, sf)
    first = r.withColumn("z", F.when(F.col("j") <= 10, F.col("z")))
    return raster.fill_from(first, r.withColumn("z", F.col("z") + 1), "z", F.col("j") >= 10).select("i", "j", F.round("z", 8).alias("v"))


@query("jn20_nearest_gap_fill", f"""
with g as (select *, case when abs(z) > 0.15e0 then null else z end as q from {{cloud}}), n as (select a.pid, b.q, row_number() over (partition by a.pid order by {_D2}, b.pid) as r from g a, g b where a.q is null and b.q is not null)
select g.pid, coalesce(g.q, n.q) as z from g left join n on g.pid = n.pid and n.r = 1""")
def jn20(spark, sf):
    c = cloud(spark, sf).withColumn("z", F.when(F.abs("z") <= 0.15, F.col("z")))
    return interpolation.fill_nearest(c, "z", "pid", 0.05).select("pid", "z")


@query("int1_median_knn", f"with k as (select a.node, b.z, row_number() over (partition by a.node order by {_D2}, b.pid) as r, min({_D2}) over (partition by a.node) as near from {_NODES_SQL} a, {{cloud}} b) select node, round(median(z), 8) as z, count(*) as n from k where r <= 7 and near <= 0.01e0 group by node")
def int1(spark, sf):
    return interpolation.median_knn(_nodes(spark), cloud(spark, sf), "node", "pid", "z", 7, 0.1, 0.05).select("node", F.round("z", 8).alias("z"), "n")


@query("int2_gaussian_knn", f"""
with k as (select a.node, b.z, exp(-{_D2} / (2 * 0.0025e0)) / pow(0.1e0 + abs(b.z), 2) + 1e-6 as w, row_number() over (partition by a.node order by {_D2}, b.pid) as r, min({_D2}) over (partition by a.node) as near from {_NODES_SQL} a, {{cloud}} b)
select node, round(sum(w * z) / sum(w), 8) as z, count(*) as n from k where r <= 7 and near <= 0.01e0 group by node""")
def int2(spark, sf):
    c = cloud(spark, sf).withColumn("s", 0.1 + F.abs("z"))
    return interpolation.gaussian_knn(_nodes(spark), c, "node", "pid", "z", "s", 7, 0.1, 0.05, 0.05).select("node", F.round("z", 8).alias("z"), "n")


@query("int3_space_time_gaussian", f"""
with p as (select a.node, t.k, b.z, exp(-{_D2} / (2 * 0.0025e0)) * exp(-pow(b.mission - t.k, 2) / (2 * 4.0e0)) as w from {_NODES_SQL} a, {{cloud}} b, range(0, 10, 3) t(k) where {_D2} <= 0.01e0 and abs(b.z) >= 1e-6)
select node, k::int as k, round(sum(w * z) / sum(w), 8) as z, count(*) as n from p group by node, k""")
def int3(spark, sf):
    return interpolation.gaussian_space_time(_nodes(spark), cloud(spark, sf), "node", "z", "mission", [0, 3, 6, 9], 0.1, 0.05, 2.0).select("node", F.col("epoch").cast("int").alias("k"), F.round("z", 8).alias("z"), "n")


@query("int4_ordinary_kriging")
def int4(spark, sf):
    c = cloud(spark, sf).withColumn("s", F.lit(0.01))
    q = interpolation.kriging(_nodes(spark), c, "node", "pid", "z", "s", 12, 0.2, 0.1)
    return q.select("node", F.round("z", 6).alias("z"), F.round("err", 6).alias("err"), "n")


@query("int6_optimal_interpolation")
def int6(spark, sf):
    c = cloud(spark, sf).withColumns({"s": F.lit(0.01), "t": F.col("mission").cast("double")})
    q = interpolation.optimal(_nodes(spark), c, "node", "z", "s", "t", "mission", 0.15, 0.05, least=10)
    return q.select("node", *[F.round(n, 6).alias(n) for n in ("z", "err", "t_mean", "t_span", "d_mean")], "n")


@query("int8_inverse_distance", f"with k as (select a.node, b.z, {_D2} as d2, row_number() over (partition by a.node order by {_D2}, b.pid) as r from {_NODES_SQL} a, {{cloud}} b) select node, round(sum(z / d2) / sum(1 / d2), 8) as z from k where r <= 10 and d2 <= 0.01e0 group by node")
def int8(spark, sf):
    return interpolation.inverse_distance(_nodes(spark), cloud(spark, sf), "node", "pid", "z", 10, 0.1, 0.05).select("node", F.round("z", 8).alias("z"))


@query("int11_grid_nodes", """
with b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from {points}), n as (select *, floor((x1 - x0) / 20000.0e0)::bigint + 1 as nx, floor((y1 - y0) / 10000.0e0)::bigint + 1 as ny from b),
k as (select *, unnest(range(0, nx)) as i from n), l as (select *, unnest(range(0, ny)) as j from k)
select i::int as i, j::int as j, round(x0 + i * ((x1 - x0) / greatest(1, nx - 1)), 6) as x, round(y0 + j * ((y1 - y0) / greatest(1, ny - 1)), 6) as y from l""")
def int11(spark, sf):
    """Nodes about 20 and 10 km apart over the place of the points."""
    box = points(spark, sf).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    g = interpolation.grid(spark, *(v or 0.0 for v in box), 20000.0, 10000.0)
    return g.select("i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
