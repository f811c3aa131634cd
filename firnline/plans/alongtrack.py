"""Queries of window operators along tracks and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import alongtrack as A

from .registry import points, query, series, tracks

_O = "window w as (partition by orbit order by t, pid)"
_GAPS = "(select cell, k, case when v > 80 then null else v end as v from {series})"


def _gaps(spark, sf):
    return series(spark, sf).withColumn("v", F.when(F.col("v") <= 80, F.col("v")))


@query("win1_gap_sessions", "with d as (select *, case when abs(t - lag(t) over (partition by orbit order by t, pid)) > 43200 then 1 else 0 end as b from {tracks}) select orbit, pid, sum(b) over (partition by orbit order by t, pid rows unbounded preceding)::bigint as seg from d")
def win1(spark, sf):
    return A.sessions(tracks(spark, sf), ["orbit"], ["t", "pid"], "t", 43200.0).select("orbit", "pid", "seg")


@query("win2_ascending", """
with d as (select *, case when abs(t - lag(t) over (partition by orbit order by t, pid)) > 43200 then 1 else 0 end as b from {tracks}), s as (select *, sum(b) over (partition by orbit order by t, pid rows unbounded preceding) as seg from d)
select orbit, pid, arg_max(h, t) over (partition by orbit, seg) - arg_min(h, t) over (partition by orbit, seg) > 0 as ascending from s""")
def win2(spark, sf):
    s = A.sessions(tracks(spark, sf), ["orbit"], ["t", "pid"], "t", 43200.0)
    return A.ascending(s, ["orbit", "seg"], "t", "h").select("orbit", "pid", "ascending")


@query("win2_turning_point", """
with r as (select *, row_number() over (partition by orbit order by t, pid) as r from {tracks}), m as (select *, first_value(r) over (partition by orbit order by abs(h - 50) desc, r) as top from r)
select orbit, pid, case when r <= top then 0 else 1 end as part from m""")
def win2t(spark, sf):
    return A.turning_point(tracks(spark, sf).withColumn("lat", F.col("h") - 50), ["orbit"], ["t", "pid"], "lat").select("orbit", "pid", "part")


_HANN = [0.0, 0.09549150281252627, 0.3454915028125263, 0.6545084971874737, 0.9045084971874737, 1.0, 0.9045084971874737, 0.6545084971874737, 0.3454915028125263, 0.09549150281252627, 0.0]
_SMOOTH = " + ".join(f"{x / sum(_HANN)!r}::double * coalesce({'lag' if k < 5 else 'lead'}(m, {abs(k - 5)}) over w, 0)" for k, x in enumerate(_HANN))


@query("win3_track_filter", f"""
with a as (select *, list_sort([coalesce(lag(h) over w, 0), h, coalesce(lead(h) over w, 0)])[2] as m, row_number() over w as r, count(*) over (partition by orbit) as n from {{tracks}} {_O}), s as (select *, {_SMOOTH} as sm from a {_O})
select orbit, pid, round(case when n < 11 then null when r <= 3 or r > n - 3 then h else sm end, 8) as h_filt from s""")
def win3(spark, sf):
    return A.track_filter(tracks(spark, sf), ["orbit"], ["t", "pid"], "h", "h_filt").select("orbit", "pid", F.round("h_filt", 8).alias("h_filt"))


@query("win4_box_mean", "select orbit, pid, round(avg(h) over (partition by orbit order by t, pid rows between 4 preceding and 4 following), 8) as m from {tracks}")
def win4(spark, sf):
    return A.box_mean(tracks(spark, sf), ["orbit"], ["t", "pid"], "h", 4, "m").select("orbit", "pid", F.round("m", 8).alias("m"))


@query("win5_range_median", "select a.orbit, a.pid, round(median(b.h), 8) as m from {tracks} a join {tracks} b on a.orbit = b.orbit and abs(a.t - b.t) < 86400 group by 1, 2")
def win5(spark, sf):
    return A.range_median(tracks(spark, sf), ["orbit"], "t", "h", 86400.0, "m", scale=1.0).select("orbit", "pid", F.round("m", 8).alias("m"))


@query("win6_running_mean", """
select cell, k, round(case when count(*) over f < 5 then v when count(v) over f = 5 then avg(v) over f end, 8) as m, round(avg(v) over f, 8) as m_shrink from {series} window f as (partition by cell order by k rows between 2 preceding and 2 following)""")
def win6(spark, sf):
    q = A.running_mean(series(spark, sf), ["cell"], ["k"], "v", 2, "m")
    return A.running_mean(q, ["cell"], ["k"], "v", 2, "s", ends="shrink").select("cell", "k", F.round("m", 8).alias("m"), F.round("s", 8).alias("m_shrink"))


_SG = [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35]
_SGSUM = " + ".join(f"{x!r}::double * coalesce({'lag' if k < 2 else 'lead'}(v, {abs(k - 2)}) over w, {'first_value' if k < 2 else 'last_value'}(v) over (partition by cell order by k rows between unbounded preceding and unbounded following))" for k, x in enumerate(_SG))


@query("win7_savitzky_golay", f"select cell, k, round({_SGSUM}, 8) as smooth from {{series}} window w as (partition by cell order by k)")
def win7(spark, sf):
    return A.savgol(series(spark, sf), ["cell"], "k", "v", "smooth", 5, 2).select("cell", "k", F.round("smooth", 8).alias("smooth"))


@query("win8_gradient", "select cell, k, round(case when lag(v) over w is null then lead(v) over w - v when lead(v) over w is null then v - lag(v) over w else (lead(v) over w - lag(v) over w) / 2 end, 8) as g from {series} window w as (partition by cell order by k)")
def win8(spark, sf):
    return A.gradient(series(spark, sf), ["cell"], "k", "v", "g").select("cell", "k", F.round("g", 8).alias("g"))


_FILL = f"""with g as (select *, last_value(v ignore nulls) over b as bv, last_value(case when v is not null then k end ignore nulls) over b as bk, first_value(v ignore nulls) over a as av, first_value(case when v is not null then k end ignore nulls) over a as ak
  from {_GAPS} window b as (partition by cell order by k rows between unbounded preceding and current row), a as (partition by cell order by k rows between current row and unbounded following))"""


@query("win9_linear_gaps", f"{_FILL} select cell, k, round(coalesce(v, bv + (av - bv) * (k - bk) / nullif(ak - bk, 0)::double, bv, av), 8) as v from g")
def win9(spark, sf):
    return A.fill_linear(_gaps(spark, sf), ["cell"], "k", "v", "f").select("cell", "k", F.round("f", 8).alias("v"))


@query("win10_fill_both_ways", f"{_FILL} select cell, k, coalesce(bv, av) as v from g")
def win10(spark, sf):
    return A.fill_both(_gaps(spark, sf), ["cell"], "k", "v", "f").select("cell", "k", F.col("f").alias("v"))


@query("win11_index_gaps", f"""
with r as (select *, row_number() over (partition by cell order by k) as i from {_GAPS}), g as (select *, last_value(v ignore nulls) over b as bv, last_value(case when v is not null then i end ignore nulls) over b as bk, first_value(v ignore nulls) over a as av, first_value(case when v is not null then i end ignore nulls) over a as ak
  from r window b as (partition by cell order by i rows between unbounded preceding and current row), a as (partition by cell order by i rows between current row and unbounded following))
select cell, k, round(coalesce(v, bv + (av - bv) * (i - bk) / nullif(ak - bk, 0)::double), 8) as v from g""")
def win11(spark, sf):
    from pyspark.sql import Window

    q = _gaps(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("k")))
    return A.fill_linear(q, ["cell"], "i", "v", "f", ends="keep").select("cell", "k", F.round("f", 8).alias("v"))


@query("win12_peaks", """
with d as (select *, h - lag(h) over w as u, lead(h) over w - h as e from {tracks} window w as (partition by orbit order by t, pid)) select orbit, pid from d where u > 0 and e <= 0 and h >= 60 and least(u, -e) >= 5""")
def win12(spark, sf):
    return A.peaks(tracks(spark, sf), ["orbit"], ["t", "pid"], "h", height=60.0, threshold=5.0).select("orbit", "pid")


@query("win12_peaks_apart")
def win12d(spark, sf):
    return A.peaks(tracks(spark, sf), ["orbit"], ["t", "pid"], "h", distance=6).select("orbit", "pid")


@query("win13_cumulative_fill", f"""
with a as (select *, v - lag(v) over (partition by cell order by k) as g from {_GAPS}), b as (select *, sum(coalesce(g, mg, 0)) over (partition by cell order by k rows unbounded preceding) as c from (select *, avg(g) over (partition by cell) as mg from a))
select cell, k, round(coalesce(v, c + avg(v - c) over (partition by cell)), 7) as v from b""")
def win13(spark, sf):
    return A.cumulative_fill(_gaps(spark, sf), ["cell"], "k", "v", "f").select("cell", "k", F.round("f", 7).alias("v"))


@query("win14_track_offsets", "select orbit, line, round(h - (avg(h) over (partition by y, mission) - avg(h) over (partition by y)), 8) as h from {points}")
def win14(spark, sf):
    return A.remove_track_offsets(points(spark, sf), "mission", "h", ["y"]).select("orbit", "line", F.round("h", 8).alias("h"))


@query("win15_relative_to_epoch", "select cell, k, round(v - first_value(v) over (partition by cell order by abs(k - 40), k rows between unbounded preceding and unbounded following), 8) as dv from {series}")
def win15(spark, sf):
    return A.relative_to_epoch(series(spark, sf), ["cell"], "k", "v", 40, "dv").select("cell", "k", F.round("dv", 8).alias("dv"))


@query("win16_detrend", "select cell, k, round(v - (regr_intercept(v, k) over (partition by cell) + regr_slope(v, k) over (partition by cell) * k), 8) as r from {series}")
def win16(spark, sf):
    from firnline.operators.robust import detrended

    return detrended(series(spark, sf), ["cell"], "k", "v", "r").select("cell", "k", F.round("r", 8).alias("r"))
