"""Queries of tides."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.functions import tides

from .registry import query, tracks

_DAYS_SQL = "(select orbit, pid, h, t / 86400e0 - 8035.0e0 as d, t / 86400e0 - 8035.0e0 + 48622.0e0 as mjd from {tracks})"


def _days(spark, sf):
    return tracks(spark, sf).withColumn("d", F.col("t") / 86400 - 8035.0)


@query("tid1_mean_longitudes", f"""
with a as (select orbit, pid, mjd - 51544.4993e0 as t from {_DAYS_SQL}), l as (select orbit, pid, 218.3164e0 + 13.17639648e0 * t as s, 280.4661e0 + 0.98564736e0 * t as h, 83.3535e0 + 0.11140353e0 * t as p, 125.0445e0 - 0.05295377e0 * t as n from a)
select orbit, pid, round(s - 360 * floor(s / 360), 6) as s, round(h - 360 * floor(h / 360), 6) as h, round(p - 360 * floor(p / 360), 6) as p, round(n - 360 * floor(n / 360), 6) as n, 282.8e0 as pp from l""")
def tid1(spark, sf):
    lon = tides.longitudes(F.col("d") + tides.MJD_1992)
    return _days(spark, sf).select("orbit", "pid", *[F.round(lon[k], 6).alias(k) for k in ("s", "h", "p", "n")], lon["pp"].alias("pp"))


_LON_SQL = f"(select *, radians((125.0445e0 - 0.05295377e0 * q) - 360 * floor((125.0445e0 - 0.05295377e0 * q) / 360)) as n, radians((83.3535e0 + 0.11140353e0 * q) - 360 * floor((83.3535e0 + 0.11140353e0 * q) / 360)) as p from (select *, mjd - 51544.4993e0 as q from {_DAYS_SQL}))"


@query("tid2_nodal_corrections", f"""
select orbit, pid, round(sqrt(pow(1 - 0.03731e0*cos(n) + 0.00052e0*cos(2*n), 2) + pow(0.03731e0*sin(n) - 0.00052e0*sin(2*n), 2)), 8) as f_m2, round(atan((-0.03731e0*sin(n) + 0.00052e0*sin(2*n)) / (1 - 0.03731e0*cos(n) + 0.00052e0*cos(2*n))), 8) as u_m2,
  round(sqrt(pow(1 + 0.1158e0*cos(n) - 0.0029e0*cos(2*n), 2) + pow(0.1554e0*sin(n) - 0.0029e0*sin(2*n), 2)), 8) as f_k1, round(radians(10.8e0*sin(n) - 1.3e0*sin(2*n) + 0.2e0*sin(3*n)), 8) as u_o1,
  round(sqrt(pow(1.36e0*cos(p) + 0.267e0*cos(p - n), 2) + pow(0.64e0*sin(p) + 0.135e0*sin(p - n), 2)), 8) as f_m1, round(atan2(0.64e0*sin(p) + 0.135e0*sin(p - n), 1.36e0*cos(p) + 0.267e0*cos(p - n)), 8) as u_m1,
  round(sqrt(pow(1 - 0.25e0*cos(2*p) - 0.11e0*cos(2*p - n) - 0.04e0*cos(n), 2) + pow(0.25e0*sin(2*p) + 0.11e0*sin(2*p - n) + 0.04e0*sin(n), 2)), 8) as f_l2,
  round(atan(-(0.25e0*sin(2*p) + 0.11e0*sin(2*p - n) + 0.04e0*sin(n)) / (1 - 0.25e0*cos(2*p) - 0.11e0*cos(2*p - n) - 0.04e0*cos(n))), 8) as u_l2,
  round(1.043e0 + 0.414e0*cos(n), 8) as f_mf, round(radians(-23.7e0*sin(n) + 2.7e0*sin(2*n) - 0.4e0*sin(3*n)), 8) as u_mf,
  round(sqrt(pow(1 + 0.169e0*cos(n), 2) + pow(0.227e0*sin(n), 2)), 8) as f_j1, round(atan(-0.227e0*sin(n) / (1 + 0.169e0*cos(n))), 8) as u_j1,
  round(sqrt(pow(1 + 0.640e0*cos(n) + 0.134e0*cos(2*n), 2) + pow(0.640e0*sin(n) + 0.134e0*sin(2*n), 2)), 8) as f_oo1, round(atan(-(0.640e0*sin(n) + 0.134e0*sin(2*n)) / (1 + 0.640e0*cos(n) + 0.134e0*cos(2*n))), 8) as u_oo1,
  round(sqrt(pow(1 + 0.221e0*cos(n), 2) + pow(0.221e0*sin(n), 2)), 8) as f_chi1, round(atan(-0.436e0*sin(n) / (1 + 0.436e0*cos(n))), 8) as u_eta2, round(atan(-(0.203e0*sin(n) + 0.040e0*sin(2*n)) / (1 + 0.203e0*cos(n) + 0.040e0*cos(2*n))), 8) as u_mt from {_LON_SQL}""")
def tid2(spark, sf):
    lon = tides.longitudes(F.col("d") + tides.MJD_1992)
    wanted = ["f_m2", "u_m2", "f_k1", "u_o1", "f_m1", "u_m1", "f_l2", "u_l2", "f_mf", "u_mf", "f_j1", "u_j1", "f_oo1", "u_oo1", "f_chi1", "u_eta2", "u_mt"]
    return _days(spark, sf).select("orbit", "pid", *[F.round(tides.nodal(w[2:], lon, "otis")["fu".index(w[0])], 8).alias(w) for w in wanted])


_CONSTITUENTS_SQL = "(select * from (values " + ", ".join(f"('{c[0]}', {c[1]!r}::double, {c[2]!r}::double, {c[3]!r}::double, {c[4]!r}::double, {c[5]}::int)" for c in tides.CONSTITUENTS) + ") t(name, amplitude, phase, omega, alpha, species))"


@query("tid3_constituents", f"with f as (select kind, min(t) as t from {{tracks}} group by kind) select kind, name, amplitude, phase, omega, alpha, species, round(phase + omega * (t - 694224000.0e0), 4) as angle from f, {_CONSTITUENTS_SQL} c")
def tid3(spark, sf):
    """The constants of every constituent, and its angle at the first time of each kind of track."""
    first = tracks(spark, sf).groupBy("kind").agg(F.min("t").alias("t"))
    q = first.join(F.broadcast(tides.constituents(spark)))
    return q.select("kind", "name", "amplitude", "phase", "omega", "alpha", "species", F.round(F.col("phase") + F.col("omega") * (F.col("t") - 694224000.0), 4).alias("angle"))


@query("tid4_harmonic_prediction", f"""
with a as (select *, radians((125.0445e0 - 0.05295377e0 * (mjd - 51544.4993e0)) - 360 * floor((125.0445e0 - 0.05295377e0 * (mjd - 51544.4993e0)) / 360)) as n from {_DAYS_SQL}),
f as (select *, sqrt(pow(1 - 0.03731e0*cos(n) + 0.00052e0*cos(2*n), 2) + pow(0.03731e0*sin(n) - 0.00052e0*sin(2*n), 2)) as f2, 1.405189e-04 * 86400 * d + 1.731557546e0 + atan((-0.03731e0*sin(n) + 0.00052e0*sin(2*n)) / (1 - 0.03731e0*cos(n) + 0.00052e0*cos(2*n))) as t2, 1.454441e-04 * 86400 * d as t1 from a)
select orbit, pid, round(f2 * (h / 100 * cos(t2) - 0.2e0 * sin(t2)) + (0.3e0 * cos(t1) + h / 200 * sin(t1)), 6) as tide from f""")
def tid4(spark, sf):
    re = {"m2": F.col("h") / 100, "s2": F.lit(0.3)}
    im = {"m2": F.lit(0.2), "s2": -F.col("h") / 200}
    return _days(spark, sf).select("orbit", "pid", F.round(tides.predicted(F.col("d"), ["m2", "s2"], re, im), 6).alias("tide"))


def _wrapped(poly: str) -> str:
    return f"(({poly}) - 360 * floor(({poly}) / 360))"


_LINEAR = {"s": _wrapped("218.3164e0 + 13.17639648e0 * q"), "h": _wrapped("280.4661e0 + 0.98564736e0 * q"), "p": _wrapped("83.3535e0 + 0.11140353e0 * q"), "n": _wrapped("125.0445e0 - 0.05295377e0 * q"), "pp": "282.8e0"}
_CENTURIES = {
    "s": _wrapped("218.3164477e0 + 481267.88123421e0*c - 1.5786e-3*c*c + 1.855835e-6*c*c*c - 1.53388e-8*c*c*c*c"),
    "h": _wrapped("(218.3164477e0 - 297.8501921e0) + (481267.88123421e0 - 445267.1114034e0)*c + (1.8819e-3 - 1.5786e-3)*c*c + (1.855835e-6 - 1.83195e-6)*c*c*c + (8.8445e-9 - 1.53388e-8)*c*c*c*c"),
    "p": _wrapped("83.3532465e0 + 4069.0137287e0*c - 1.032e-2*c*c - 1.249172e-5*c*c*c"),
    "n": _wrapped("125.04452e0 - 1934.136261e0*c + 2.0708e-3*c*c + 2.22222e-6*c*c*c"),
    "pp": "(282.94e0 + 1.7192e0*c)",
}


def _tidal(kind: dict[str, str]) -> str:
    """Points with their longitudes in degrees and the hour of the day."""
    names = ", ".join(f"{v} as lon_{k}" for k, v in kind.items())
    return f"(select *, radians(lon_n) as n, radians(lon_p) as p from (select *, (mjd - floor(mjd)) * 24 as hour, {names} from (select *, mjd - 51544.4993e0 as q, (mjd - 51544.5e0) / 36525 as c from {_DAYS_SQL})))"


def _angle(name: str) -> str:
    m = tides.ARGUMENTS[name]
    return f"radians({m[0]} * 15 * hour + {m[1]} * lon_s + {m[2]} * lon_h + {m[3]} * lon_p + {m[4]} * lon_pp + {m[5]})"


def _minor_sql(re: dict[str, str], im: dict[str, str], given: list[str]) -> str:
    """The sum of the minor terms as one expression."""
    out = []
    for name, (one, two, node) in tides.MINOR.items():
        if name.removesuffix("b") in given:
            continue
        zr, zi = (" + ".join(f"{x[1]}e0 * {side[x[0]]}" for x in (one, two) if x) for side in (re, im))
        f, theta = "1", _angle(name)
        if node:
            real, imag = f"(1 + {node[0]}e0 * cos(n) + {node[1]}e0 * cos(2 * n))", f"({node[0]}e0 * sin(n) + {node[1]}e0 * sin(2 * n))"
            f, theta = f"sqrt({real} * {real} + {imag} * {imag})", f"({theta} + atan2({node[2]} * {imag}, {real}))"
        out.append(f"{f} * (({zr}) * cos({theta}) - ({zi}) * sin({theta}))")
    return " + ".join(out)


_GOT_NODAL = {
    "q1": ("(1.009e0 + 0.187e0*cos(n) - 0.015e0*cos(2*n))", "radians(10.8e0*sin(n) - 1.3e0*sin(2*n))"),
    "k1": ("(1.006e0 + 0.115e0*cos(n) - 0.009e0*cos(2*n))", "radians(-8.9e0*sin(n) + 0.7e0*sin(2*n))"),
    "m2": ("(1 - 0.037e0*cos(n))", "radians(-2.1e0*sin(n))"),
    "k2": ("(1.024e0 + 0.286e0*cos(n) + 0.008e0*cos(2*n))", "radians(-17.7e0*sin(n) + 0.7e0*sin(2*n))"),
}
_GOT_NODAL |= {"o1": _GOT_NODAL["q1"], "n2": _GOT_NODAL["m2"], "p1": ("1", "0"), "s2": ("1", "0")}
_MINOR_RE = {m: f"(h / {100 + 10 * k}e0)" for k, m in enumerate(tides.MAJORS)}
_MINOR_IM = {m: f"{0.01 * (k + 1)!r}" for k, m in enumerate(tides.MAJORS)}
_GOT_SQL = " + ".join(f"{f} * ({_MINOR_RE[m]} * cos({_angle(m)} + {u}) - {_MINOR_IM[m]} * sin({_angle(m)} + {u}))" for m in tides.MAJORS for f, u in [_GOT_NODAL[m]])


@query("tid5_minor_terms", f"""
select a.orbit, a.pid, minor, major_got from (select orbit, pid, round({_minor_sql(_MINOR_RE, _MINOR_IM, list(tides.MAJORS))}, 6) as minor from {_tidal(_LINEAR)}) a
join (select orbit, pid, round({_GOT_SQL}, 6) as major_got from {_tidal(_CENTURIES)}) b using (orbit, pid)""")
def tid5(spark, sf):
    re = {m: F.col("h") / (100 + 10 * k) for k, m in enumerate(tides.MAJORS)}
    im = {m: F.lit(0.01 * (k + 1)) for k, m in enumerate(tides.MAJORS)}
    return _days(spark, sf).select("orbit", "pid", F.round(tides.minor_terms(F.col("d"), re, im, list(tides.MAJORS)), 6).alias("minor"), F.round(tides.predicted(F.col("d"), list(tides.MAJORS), re, im, "got"), 6).alias("major_got"))


_DT = [(1.7e9, 69.1), (1.7045e9, 69.18), (1.706e9, 69.2), (1.72e9, 69.25)]


@query("tid6_delta_time", """
with d as (select * from (values """ + ", ".join(f"({a!r}::double, {b!r}::double)" for a, b in _DT) + """) x(t, delta)), n as (select p.orbit, p.pid, p.t, max(d.t) filter (where d.t <= p.t) as b, min(d.t) filter (where d.t >= p.t) as a from {tracks} p, d group by 1, 2, 3)
select orbit, pid, round(coalesce(x.delta + (y.delta - x.delta) * coalesce((n.t - b) / nullif(a - b, 0), 0), x.delta, y.delta), 6) as delta_t from n left join d x on x.t = b left join d y on y.t = a""")
def tid6(spark, sf):
    table = spark.createDataFrame(_DT, "t double, delta double")
    return tides.delta_time(tracks(spark, sf), table, "t").select("orbit", "pid", F.round("delta_t", 6).alias("delta_t"))


def _otis_nodal(a: str, b: str, c: str, d: str) -> tuple[str, str]:
    """Factor and phase from 1 + a + b (cosines) and c + d (sines)."""
    return f"sqrt(pow(1 + {a} + {b}, 2) + pow({c} + {d}, 2))", f"atan(({c} + {d}) / (1 + {a} + {b}))"


_M2 = _otis_nodal("-0.03731e0*cos(n)", "0.00052e0*cos(2*n)", "-0.03731e0*sin(n)", "0.00052e0*sin(2*n)")
_OTIS_NODAL = {
    "m2": _M2, "n2": _M2, "s2": ("1", "0"), "p1": ("1", "0"),
    "k1": _otis_nodal("0.1158e0*cos(n)", "-0.0029e0*cos(2*n)", "-0.1554e0*sin(n)", "0.0029e0*sin(2*n)"),
    "k2": _otis_nodal("0.2852e0*cos(n)", "0.0324e0*cos(2*n)", "-0.3108e0*sin(n)", "-0.0324e0*sin(2*n)"),
    "q1": ("sqrt(pow(1 + 0.188e0*cos(n), 2) + pow(0.188e0*sin(n), 2))", "atan(0.189e0*sin(n) / (1 + 0.189e0*cos(n)))"),
    "o1": ("sqrt(pow(1 + 0.189e0*cos(n) - 0.0058e0*cos(2*n), 2) + pow(0.189e0*sin(n) - 0.0058e0*sin(2*n), 2))", "radians(10.8e0*sin(n) - 1.3e0*sin(2*n) + 0.2e0*sin(3*n))"),
}
_RE8, _IM8 = ({m: f"{lo + step * k!r}::double" for k, m in enumerate(tides.MAJORS)} for lo, step in ((0.1, 0.01), (0.0, 0.02)))
_MAJOR_SQL = " + ".join(f"{f} * ({_RE8[m]} * cos({w!r} * 86400 * d + {ph!r} + {u}) - {_IM8[m]} * sin({w!r} * 86400 * d + {ph!r} + {u}))" for m, _, ph, w, _, _ in tides.CONSTITUENTS if m in tides.MAJORS for f, u in [_OTIS_NODAL[m]])


@query("tid8_tide_correction", f"select orbit, pid, round(tide, 6) as h_tide, round(h - tide, 6) as h from (select orbit, pid, h, {_MAJOR_SQL} + {_minor_sql(_RE8, _IM8, list(tides.MAJORS))} as tide from {_tidal(_LINEAR)})")
def tid8(spark, sf):
    """Heights with the predicted tide, major and inferred minor terms, taken off."""
    re = {m: F.lit(0.1 + 0.01 * k) for k, m in enumerate(tides.MAJORS)}
    im = {m: F.lit(0.02 * k) for k, m in enumerate(tides.MAJORS)}
    tide = tides.predicted(F.col("d"), list(tides.MAJORS), re, im) + tides.minor_terms(F.col("d"), re, im, list(tides.MAJORS))
    return _days(spark, sf).select("orbit", "pid", F.round(tide, 6).alias("h_tide"), F.round(F.col("h") - tide, 6).alias("h"))
