"""Queries of robust statistics and outlier filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import robust

from .registry import points, query, series, tracks

_CELLS = "(select *, floor(x / 10000.0e0)::bigint as i, floor(y / 10000.0e0)::bigint as j from {points})"


def _cells(spark, sf):
    return points(spark, sf).withColumns({"i": F.floor(F.col("x") / 10000.0), "j": F.floor(F.col("y") / 10000.0)})


@query("out1_mad_std", f"""
with m as (select *, median(h) over (partition by i, j) as md from {_CELLS})
select i, j, round(any_value(md), 6) as med, round(1.4826e0 * median(abs(h - md)), 6) as mad, count(h) as n from m group by i, j""")
def out1(spark, sf):
    s = robust.mad_std(_cells(spark, sf), ["i", "j"], "h")
    return s.select("i", "j", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), "n")


@query("out2_mad_se", f"""
with m as (select *, median(h) over (partition by i, j) as md from {_CELLS})
select i, j, round(1.4826e0 * median(abs(h - md)) / sqrt(count(h)), 9) as se from m group by i, j""")
def out2(spark, sf):
    return robust.mad_std(_cells(spark, sf), ["i", "j"], "h").select("i", "j", F.round("se", 9).alias("se"))


@query("out3_mad_clip", f"""
with m as (select *, median(h) over (partition by i, j) as md from {_CELLS}), d as (select *, 1.4826e0 * median(abs(h - md)) over (partition by i, j) as sd from m)
select orbit, line, case when abs(h - md) <= 1.5e0 * sd then h end as h, case when abs(h) <= 2.0e0 * sd then h end as h0 from d""")
def out3(spark, sf):
    p = _cells(spark, sf).withColumn("h0", F.col("h"))
    q = robust.clip(p, ["i", "j"], "h", 1.5)
    q = q.withColumnRenamed("h", "hc").withColumnRenamed("h0", "h")
    return robust.clip(q, ["i", "j"], "h", 2.0, about_zero=True).select("orbit", "line", F.col("hc").alias("h"), F.col("h").alias("h0"))


@query("out4_mode_filter", f"""
with c as (select i, j, bs, count(*) as n from {_CELLS} group by all having count(*) > 10), t as (select *, row_number() over (partition by i, j order by n desc, bs) as r from c)
select p.i, p.j, p.orbit, p.line, case when t.bs is null then p.bs end as bs from {_CELLS} p left join (select * from t where r <= 3) t on p.i = t.i and p.j = t.j and p.bs = t.bs""")
def out4(spark, sf):
    return robust.mode_filter(_cells(spark, sf), ["i", "j"], "bs").select("i", "j", "orbit", "line", "bs")


@query("out7_block_filter", f"""
with m as (select *, h - median(h) over (partition by i, j) as d from {_CELLS}), s as (select *, stddev_pop(d) over (partition by i, j) as sd from m)
select orbit, line, case when abs(d) <= 1.2e0 * sd then h end as h from s""")
def out7(spark, sf):
    return robust.block_filter(points(spark, sf), "h", 10000.0, 10000.0, 1.2).select("orbit", "line", "h")


@query("out8_block_filter_limited", f"""
with l as (select * replace (case when abs(h) < 70 then h end as h) from {_CELLS}), m as (select *, h - median(h) over (partition by i, j) as d from l), s as (select *, stddev_pop(d) over (partition by i, j) as sd from m)
select orbit, line, case when abs(d) <= 1.2e0 * sd then h end as h from s""")
def out8(spark, sf):
    return robust.block_filter(points(spark, sf), "h", 10000.0, 10000.0, 1.2, most=70.0).select("orbit", "line", "h")


@query("out10_hampel", """
with w as (select *, row_number() over (partition by orbit order by t, pid) as r, count(*) over (partition by orbit) as n, list(h) over (partition by orbit order by t, pid rows between 3 preceding and 3 following) as l from {tracks}),
m as (select *, list_median(l) as md from w), d as (select *, list_median(list_transform(l, lambda x: abs(x - md))) as mad from m)
select orbit, pid, case when not (r > 4 and r <= n - 3 and abs(h - md) > 3 * 1.4826e0 * mad) then h end as h from d""")
def out10(spark, sf):
    return robust.hampel(tracks(spark, sf), ["orbit"], ["t", "pid"], "h", 3).select("orbit", "pid", "h")


@query("out13_abs_residual", """
with f as (select *, h - (regr_intercept(h, t) over (partition by orbit) + regr_slope(h, t) over (partition by orbit) * t) as r from (select orbit, pid, (t - 1704067200) / 86400 as t, h from {tracks}))
select orbit, pid, case when abs(r) <= 60 then h end as h from f""")
def out13(spark, sf):
    p = tracks(spark, sf).withColumn("t", (F.col("t") - 1704067200) / 86400)
    return robust.abs_filter(p, ["orbit"], "t", "h", 60.0).select("orbit", "pid", "h")


_GRAD = """g as (select *, row_number() over w as r, count(*) over (partition by cell) as n, case when row_number() over w = 1 then lead(v) over w - v when row_number() over w = count(*) over (partition by cell) then v - lag(v) over w else (lead(v) over w - lag(v) over w) / 2 end as g0 from {series} window w as (partition by cell order by k))"""


@query("out14_gradient_filter", f"""
with {_GRAD}, a as (select *, round(g0, 8) as g from g), m as (select *, median(g) over (partition by cell) as md from a), s as (select *, 1.4826e0 * median(abs(g - md)) over (partition by cell) as sd from m)
select cell, k, case when not coalesce(g = 0 or abs(g - md) > 2 * sd, false) then v end as v from s""")
def out14(spark, sf):
    return robust.gradient_filter(series(spark, sf), ["cell"], "k", "v", 2.0, digits=8).select("cell", "k", "v")


@query("out15_deviation_filter", f"""
with {_GRAD}, m as (select *, median(g0) over (partition by cell) as md, median(v) over (partition by cell) as mv from g),
s as (select *, 1.4826e0 * median(abs(g0 - md)) over (partition by cell) as sd, 1.4826e0 * median(abs(v - mv)) over (partition by cell) as sv from m)
select cell, k, case when not coalesce(abs(g0 - md) > 2 * sd or abs(v - mv) > 2 * sv, false) then v end as v from s""")
def out15(spark, sf):
    return robust.deviation_filter(series(spark, sf), ["cell"], "k", "v", 2.0).select("cell", "k", "v")


@query("out16_end_point_filter", f"""
with {_GRAD}, a as (select *, round(g0, 8) as g from g), m as (select *, median(g) over (partition by cell) as md from a), s as (select *, 1.4826e0 * median(abs(g - md)) over (partition by cell) as sd from m)
select cell, k, case when not coalesce((g = 0 or abs(g - md) > 1 * sd) and (r <= 3 or r > n - 3), false) then v end as v from s""")
def out16(spark, sf):
    return robust.gradient_filter(series(spark, sf), ["cell"], "k", "v", 1.0, ends=3, digits=8).select("cell", "k", "v")


@query("out17_slice_filter", """
with m as (select *, median(v) over (partition by k) as md from {series}), s as (select *, 1.4826e0 * median(abs(v - md)) over (partition by k) as sd from m)
select cell, k, case when not (abs(v) - md > 1.5e0 * sd) then v end as v from s""")
def out17(spark, sf):
    return robust.slice_filter(series(spark, sf), ["k"], "v", 1.5).select("cell", "k", "v")


@query("out18_series_std_filter", """
with f as (select *, v - (regr_intercept(v, k) over (partition by cell) + regr_slope(v, k) over (partition by cell) * k) as r from {series}),
m as (select *, median(r) over (partition by cell) as md from f), s as (select *, 1.4826e0 * median(abs(r - md)) over (partition by cell) as sd from m)
select cell, k, case when abs(r - md) <= 1.5e0 * sd then v end as v from s""")
def out18(spark, sf):
    return robust.series_std_filter(series(spark, sf), ["cell"], "k", "v", 1.5).select("cell", "k", "v")


@query("out22_three_sigma", "select orbit, pid from {tracks}, (select avg(h) as a, stddev_pop(h) as s from {tracks}) where abs(h - a) <= 1.5e0 * s")
def out22(spark, sf):
    return robust.three_sigma(tracks(spark, sf), "h", 1.5).select("orbit", "pid")
