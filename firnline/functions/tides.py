"""Ocean tides as Columns: astronomical longitudes, nodal corrections, harmonic prediction, minor terms.

Tables of constants are rendered as expressions over the time column, so a prediction for any number of
points is one projection. Amplitudes come as columns <constituent>_re and <constituent>_im.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MJD_1992 = 48622.0

# Constituent, amplitude (m), phase at 1992-01-01 (rad), frequency (rad/s), load Love number, species.
CONSTITUENTS = (
    ("m2", 0.2441, 1.731557546, 1.405189e-04, 0.693, 2),
    ("s2", 0.112743, 0.0, 1.454441e-04, 0.693, 2),
    ("k1", 0.141565, 0.173003674, 7.292117e-05, 0.736, 1),
    ("o1", 0.100661, 1.558553872, 6.759774e-05, 0.695, 1),
    ("n2", 0.046397, 6.050721243, 1.378797e-04, 0.693, 2),
    ("p1", 0.046848, 6.110181633, 7.252295e-05, 0.706, 1),
    ("k2", 0.030684, 3.487600001, 1.458423e-04, 0.693, 2),
    ("q1", 0.019273, 5.877717569, 6.495854e-05, 0.695, 1),
    ("2n2", 0.006141, 4.086699633, 1.352405e-04, 0.693, 2),
    ("mu2", 0.007408, 3.463115091, 1.355937e-04, 0.693, 2),
    ("nu2", 0.008811, 5.427136701, 1.382329e-04, 0.693, 2),
    ("l2", 0.006931, 0.553986502, 1.431581e-04, 0.693, 2),
    ("t2", 0.006608, 0.052841931, 1.452450e-04, 0.693, 2),
    ("j1", 0.007915, 2.137025284, 7.556036e-05, 0.695, 1),
    ("m1", 0.007915, 2.436575100, 7.028195e-05, 0.695, 1),
    ("oo1", 0.004338, 1.929046130, 7.824458e-05, 0.695, 1),
    ("rho1", 0.003661, 5.254133027, 6.531174e-05, 0.695, 1),
    ("mf", 0.042041, 1.756042456, 0.053234e-04, 0.693, 0),
    ("mm", 0.022191, 1.964021610, 0.026392e-04, 0.693, 0),
    ("ssa", 0.019567, 3.487600001, 0.003982e-04, 0.693, 0),
    ("m4", 0.0, 3.463115091, 2.810377e-04, 0.693, 0),
    ("ms4", 0.0, 1.731557546, 2.859630e-04, 0.693, 0),
    ("mn4", 0.0, 1.499093481, 2.783984e-04, 0.693, 0),
    ("m6", 0.0, 5.194672637, 4.215566e-04, 0.693, 0),
    ("m8", 0.0, 6.926230184, 5.620755e-04, 0.693, 0),
    ("mk3", 0.0, 1.904561220, 2.134402e-04, 0.693, 0),
    ("s6", 0.0, 0.0, 4.363323e-04, 0.693, 0),
    ("2sm2", 0.0, 4.551627762, 1.503693e-04, 0.693, 0),
    ("2mk3", 0.0, 3.809122439, 2.081166e-04, 0.693, 0),
)
_BY_NAME = {c[0]: c for c in CONSTITUENTS}

# Multiples of (15 degrees an hour, s, h, p, solar perigee) and a constant, in degrees.
ARGUMENTS = {
    "q1": (1, -3, 1, 1, 0, -90), "o1": (1, -2, 1, 0, 0, -90), "p1": (1, 0, -1, 0, 0, -90), "k1": (1, 0, 1, 0, 0, 90),
    "n2": (2, -3, 2, 1, 0, 0), "m2": (2, -2, 2, 0, 0, 0), "s2": (2, 0, 0, 0, 0, 0), "k2": (2, 0, 2, 0, 0, 0),
    "s1": (1, 0, 0, 0, 0, 180), "m4": (4, -4, 4, 0, 0, 0),
    "2q1": (1, -4, 1, 2, 0, -90), "sigma1": (1, -4, 3, 0, 0, -90), "rho1": (1, -3, 3, -1, 0, -90),
    "m12": (1, -1, 1, -1, 0, 90), "m11": (1, -1, 1, 1, 0, 90), "chi1": (1, -1, 3, -1, 0, 90), "pi1": (1, 0, -2, 0, 1, -90),
    "phi1": (1, 0, 3, 0, 0, 90), "theta1": (1, 1, -1, 1, 0, 90), "j1": (1, 1, 1, -1, 0, 90), "oo1": (1, 2, 1, 0, 0, 90),
    "2n2": (2, -4, 2, 2, 0, 0), "mu2": (2, -4, 4, 0, 0, 0), "nu2": (2, -3, 4, -1, 0, 0), "lambda2": (2, -1, 0, 1, 0, 180),
    "l2": (2, -1, 2, -1, 0, 180), "l2b": (2, -1, 2, 1, 0, 0), "t2": (2, 0, -1, 0, 1, 0),
}
# Minor constituent, its two majors with their shares, nodal terms (cos N, cos 2N; sign of the phase).
MINOR = {
    "2q1": (("q1", 0.263), ("o1", -0.0252), (0.189, -0.0058, 1)), "sigma1": (("q1", 0.297), ("o1", -0.0264), (0.189, -0.0058, 1)),
    "rho1": (("q1", 0.164), ("o1", 0.0048), (0.189, -0.0058, 1)), "m12": (("o1", 0.0140), ("k1", 0.0101), (0.185, 0, 1)),
    "m11": (("o1", 0.0389), ("k1", 0.0282), (0.201, 0, -1)), "chi1": (("o1", 0.0064), ("k1", 0.0060), (0.221, 0, -1)),
    "pi1": (("o1", 0.0030), ("k1", 0.0171), None), "phi1": (("o1", -0.0015), ("k1", 0.0152), None),
    "theta1": (("o1", -0.0065), ("k1", 0.0155), None), "j1": (("o1", -0.0389), ("k1", 0.0836), (0.198, 0, -1)),
    "oo1": (("o1", -0.0431), ("k1", 0.0613), (0.640, 0.134, -1)), "2n2": (("n2", 0.264), ("m2", -0.0253), (-0.0373, 0, -1)),
    "mu2": (("n2", 0.298), ("m2", -0.0264), (-0.0373, 0, -1)), "nu2": (("n2", 0.165), ("m2", 0.00487), (-0.0373, 0, -1)),
    "lambda2": (("m2", 0.0040), ("s2", 0.0074), None), "l2": (("m2", 0.0131), ("s2", 0.0326), (-0.0373, 0, -1)),
    "l2b": (("m2", 0.0033), ("s2", 0.0082), (0.441, 0, -1)), "t2": (("s2", 0.0585), None, None),
}
#: Majors of which at least six are needed to infer the minor ones.
MAJORS = ("q1", "o1", "p1", "k1", "n2", "m2", "s2", "k2")
_D = math.pi / 180


def constituents(spark) -> DataFrame:
    return spark.createDataFrame(CONSTITUENTS, "name string, amplitude double, phase double, omega double, alpha double, species int")


def longitudes(mjd: Column, kind: str = "linear") -> dict[str, Column]:
    """Mean longitudes in degrees: moon s, sun h, lunar perigee p, lunar node n, solar perigee pp."""
    # Coefficients of the polynomials in time.
    if kind == "linear":
        t = mjd - 51544.4993
        poly = {"s": (218.3164, 13.17639648), "h": (280.4661, 0.98564736), "p": (83.3535, 0.11140353), "n": (125.0445, -0.05295377)}
        perigee = F.lit(282.8)
    elif kind == "centuries":
        t = (mjd - 51544.5) / 36525.0
        poly = {
            "s": (218.3164477, 481267.88123421, -1.5786e-3, 1.855835e-6, -1.53388e-8),
            "h": (218.3164477 - 297.8501921, 481267.88123421 - 445267.1114034, -1.5786e-3 + 1.8819e-3, 1.855835e-6 - 1.83195e-6, -1.53388e-8 + 8.8445e-9),
            "p": (83.3532465, 4069.0137287, -1.032e-2, -1.249172e-5),
            "n": (125.04452, -1934.136261, 2.0708e-3, 2.22222e-6),
        }
        perigee = 282.94 + 1.7192 * t
    else:
        t = mjd - 51544.5
        poly = {
            "s": (218.3164591, 13.17639647754579, -9.9454632e-13, 3.8086292e-20, -8.6184958e-27),
            "h": (280.46645, 0.985647360164271, 2.2727347e-13),
            "p": (83.3532430, 0.11140352391786447, -7.7385418e-12, -2.5636086e-19, 2.95738836e-26),
            "n": (125.0445550, -0.052953762762491446, 1.55628359e-12, 4.390675353e-20, -9.26940435e-27),
        }
        perigee = 282.94 + 1.7192 * t
    out = {k: reduce(lambda acc, c: acc * t + c, list(reversed(v))[1:], F.lit(v[-1])) for k, v in poly.items()}
    return {k: v - 360.0 * F.floor(v / 360.0) for k, v in out.items()} | {"pp": perigee}


def argument(name: str, mjd: Column, lon: dict[str, Column]) -> Column:
    """Equilibrium argument in degrees."""
    m = ARGUMENTS[name]
    hour = (mjd - F.floor(mjd)) * 24.0
    return m[0] * 15.0 * hour + m[1] * lon["s"] + m[2] * lon["h"] + m[3] * lon["p"] + m[4] * lon["pp"] + float(m[5])


# Constituents that the lunar node leaves alone.
STEADY = {
    "otis": "sa ssa msf alpha1 tau1 pi1 p1 s1 psi1 phi1 theta1 m2a m2b lambda2 t2 s2 r2 s3 s4 s5 s6 s7 s8 z0".split(),
    "got": "p1 s1 s2".split(),
}


def nodal(name: str, lon: dict[str, Column], kind: str) -> tuple[Column, Column]:
    """Factor f and phase u (radians) of the lunar node; `kind` is "otis" or "got". Unknown names are an error."""
    if name in STEADY[kind]:
        return F.lit(1.0), F.lit(0.0)
    n, p = lon["n"] * _D, lon["p"] * _D
    # Coefficients of the node's and the perigee's angles.
    sin, cos, sin2, cos2, sin3 = F.sin(n), F.cos(n), F.sin(2 * n), F.cos(2 * n), F.sin(3 * n)
    one, zero = F.lit(1.0), F.lit(0.0)
    if kind == "got":
        m2 = (1.0 - 0.037 * cos, -2.1 * sin * _D)
        q1 = (1.009 + 0.187 * cos - 0.015 * cos2, (10.8 * sin - 1.3 * sin2) * _D)
        known = {"q1": q1, "o1": q1, "k1": (1.006 + 0.115 * cos - 0.009 * cos2, (-8.9 * sin + 0.7 * sin2) * _D), "n2": m2, "m2": m2, "k2": (1.024 + 0.286 * cos + 0.008 * cos2, (-17.7 * sin + 0.7 * sin2) * _D), "m4": (m2[0] * m2[0], -4.2 * sin * _D)}
        if name not in known:
            raise ValueError(f"no nodal correction of {name} in this kind of model")
        return known[name]

    def vector(re: Column, im_f: Column, im_u: Column) -> tuple[Column, Column]:
        return F.sqrt(re * re + im_f * im_f), F.atan(im_u / re)

    m2 = vector(1.0 - 0.03731 * cos + 0.00052 * cos2, 0.03731 * sin - 0.00052 * sin2, -0.03731 * sin + 0.00052 * sin2)
    k1 = vector(1.0 + 0.1158 * cos - 0.0029 * cos2, 0.1554 * sin - 0.0029 * sin2, -0.1554 * sin + 0.0029 * sin2)
    k2 = vector(1.0 + 0.2852 * cos + 0.0324 * cos2, 0.3108 * sin + 0.0324 * sin2, -(0.3108 * sin + 0.0324 * sin2))
    q1 = (F.sqrt((1.0 + 0.188 * cos) ** 2 + (0.188 * sin) ** 2), F.atan(0.189 * sin / (1.0 + 0.189 * cos)))
    o1 = (F.sqrt((1.0 + 0.189 * cos - 0.0058 * cos2) ** 2 + (0.189 * sin - 0.0058 * sin2) ** 2), (10.8 * sin - 1.3 * sin2 + 0.2 * sin3) * _D)
    oo1 = vector(1.0 + 0.640 * cos + 0.134 * cos2, 0.640 * sin + 0.134 * sin2, -(0.640 * sin + 0.134 * sin2))
    m1 = (1.36 * F.cos(p) + 0.267 * F.cos(p - n), 0.64 * F.sin(p) + 0.135 * F.sin(p - n))
    l2 = (1.0 - 0.25 * F.cos(2 * p) - 0.11 * F.cos(2 * p - n) - 0.04 * cos, 0.25 * F.sin(2 * p) + 0.11 * F.sin(2 * p - n) + 0.04 * sin)
    known = {
        "m2": m2, "n2": m2, "2n2": m2, "mu2": m2, "nu2": m2, "2sm2": m2, "k1": k1, "k2": k2, "q1": q1, "rho1": q1, "2q1": q1, "sigma1": q1, "o1": o1, "oo1": oo1,
        "j1": vector(1.0 + 0.169 * cos, 0.227 * sin, -0.227 * sin), "mf": (1.043 + 0.414 * cos, (-23.7 * sin + 2.7 * sin2 - 0.4 * sin3) * _D), "mm": (1.0 - 0.130 * cos, zero),
        "mt": vector(1.0 + 0.203 * cos + 0.040 * cos2, 0.203 * sin + 0.040 * sin2, -(0.203 * sin + 0.040 * sin2)),
        "chi1": vector(1.0 + 0.221 * cos, 0.221 * sin, -0.221 * sin), "eta2": vector(1.0 + 0.436 * cos, 0.436 * sin, -0.436 * sin),
        "m1": (F.hypot(m1[0], m1[1]), F.atan2(m1[1], m1[0])), "l2": vector(l2[0], l2[1], -l2[1]),
        "mns2": (m2[0] ** 2, 2 * m2[1]), "mk4": (m2[0] * k2[0], m2[1] + k2[1]), "m3": (one, 1.5 * m2[1]), "m8": (m2[0] ** 4, 4 * m2[1]), "2mk3": (m2[0] ** 2 * k1[0], 2 * m2[1] - k1[1]),
        "m4": (m2[0] ** 2, 2 * m2[1]), "mn4": (m2[0] ** 2, 2 * m2[1]), "ms4": (m2[0] ** 2, m2[1]), "m6": (m2[0] ** 3, 3 * m2[1]), "mk3": (m2[0] * k1[0], m2[1] + k1[1]),
    }
    if name not in known:
        raise ValueError(f"no nodal correction of {name}")
    return known[name]


def predicted(days: Column, names: list[str], re: dict[str, Column], im: dict[str, Column], kind: str = "otis", delta_t: Column | float = 0.0) -> Column:
    """Tide at days since 1992-01-01, the sum over the constituents' complex amplitudes."""
    mjd = days + MJD_1992
    lon = longitudes(mjd + delta_t, "centuries" if kind == "got" else "linear")
    total = F.lit(0.0)
    for c in names:
        f, u = nodal(c, lon, kind)
        if kind == "got":
            theta = argument(c, mjd, lon) * _D + u
        else:
            _, _, phase, omega, _, _ = _BY_NAME[c]
            theta = omega * 86400.0 * days + phase + u
        total = total + f * (re[c] * F.cos(theta) - im[c] * F.sin(theta))
    return total


def minor_terms(days: Column, re: dict[str, Column], im: dict[str, Column], given: list[str], kind: str = "otis", delta_t: Column | float = 0.0) -> Column:
    """Sum of minor constituents inferred from the major ones; those given already are left out.

    The phase of all terms uses sin 2N consistently.
    """
    if sum(m in re for m in MAJORS) < 6:
        raise ValueError("too few major constituents")
    mjd = days + MJD_1992
    lon = longitudes(mjd + delta_t, "centuries" if kind == "got" else "linear")
    n = lon["n"] * _D
    total = F.lit(0.0)
    for name, (a, b, node) in MINOR.items():
        if name.removesuffix("b") in given or a[0] not in re or (b and b[0] not in re):
            continue
        zr = re[a[0]] * a[1] + (re[b[0]] * b[1] if b else F.lit(0.0))
        zi = im[a[0]] * a[1] + (im[b[0]] * b[1] if b else F.lit(0.0))
        f, u = F.lit(1.0), F.lit(0.0)
        if node:
            c1, c2, sign = node
            real, imag = 1.0 + c1 * F.cos(n) + c2 * F.cos(2 * n), c1 * F.sin(n) + c2 * F.sin(2 * n)
            f, u = F.hypot(real, imag), F.atan2(sign * imag, real)
        theta = argument(name, mjd, lon) * _D + u
        total = total + f * (zr * F.cos(theta) - zi * F.sin(theta))
    return total


def delta_time(df: DataFrame, table: DataFrame, t: str, name: str = "delta_t") -> DataFrame:
    """`df` with TT - UT1 interpolated from a table (t, delta), constant outside; the table's times differ.

    The rows of `df` stay where they lie: each looks up the stretch of the table that it falls into.
    """
    from firnline.operators.spatial import interval_lookup

    ends = table.agg(F.min_by("delta", "t").alias("first"), F.max_by("delta", "t").alias("last"), F.min("t").alias("start")).first()
    by_time = Window.orderBy("t")  # over the table alone, a row for each time of it
    parts = table.select(F.col("t").alias("\x01t"), F.col("delta").alias("\x01d"), F.lead("t").over(by_time).alias("\x01u"), F.lead("delta").over(by_time).alias("\x01e")).where(F.col("\x01u").isNotNull())
    q = interval_lookup(df, parts, t, "\x01t", "\x01u")
    inside = F.col("\x01d") + (F.col("\x01e") - F.col("\x01d")) * (F.col(t) - F.col("\x01t")) / (F.col("\x01u") - F.col("\x01t"))
    outside = F.when(F.col(t) < ends["start"], F.lit(ends["first"])).when(F.col(t) >= ends["start"], F.lit(ends["last"])) if ends["start"] is not None else F.lit(None).cast("double")
    return q.withColumn(name, F.coalesce(inside, outside)).drop("\x01t", "\x01d", "\x01u", "\x01e")
