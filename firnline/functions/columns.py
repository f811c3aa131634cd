"""Scalar expressions over point tables: projections, corrections, time and physical algebra.

All take and return Columns, so they stay in generated code and can be pushed down. Missing values are
NULL; every function returns NULL where an argument is.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS-84 ellipsoid; densities of sea water and ice in kg/m3; standard gravity in m/s2.
WGS84_A, WGS84_E2 = 6378137.0, 0.00669437999014
RHO_OCEAN, RHO_ICE, GRAVITY = 1028.0, 917.0, 9.80665
YEAR_DAYS = 365.25

#: EPSG code: hemisphere sign, latitude of true scale, central longitude (degrees).
POLAR = {3031: (-1.0, 71.0, 0.0), 3413: (1.0, 70.0, -45.0), 3976: (-1.0, 70.0, 0.0)}


def nan_to_null(df: DataFrame, *sentinels: float) -> DataFrame:
    """Floating-point NaN, and any of the sentinels, become NULL in every double column."""

    def clean(c: str, kind: str) -> Column:
        if kind not in ("double", "float"):
            return F.col(c)
        bad = reduce(lambda a, b: a | b, [F.isnan(c), *[F.col(c) == F.lit(s) for s in sentinels]])
        return F.when(~bad, F.col(c)).alias(c)

    return df.select(*[clean(c, k) for c, k in df.dtypes])


def optional(df: DataFrame, name: str, default: float) -> Column:
    """The column, or a constant where the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(float(default))


# PRJ-1
def polar_xy(lon: Column, lat: Column, epsg: int = 3031) -> tuple[Column, Column]:
    """Polar stereographic x, y in metres (ellipsoidal, secant at the latitude of true scale)."""
    sign, true, lon0 = POLAR[epsg]
    e = math.sqrt(WGS84_E2)
    tc = math.tan(math.pi / 4 - math.radians(true) / 2) / ((1 - e * math.sin(math.radians(true))) / (1 + e * math.sin(math.radians(true)))) ** (e / 2)
    mc = math.cos(math.radians(true)) / math.sqrt(1 - WGS84_E2 * math.sin(math.radians(true)) ** 2)
    phi = F.radians(lat * sign)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho = t * (WGS84_A * mc / tc)
    lam = F.radians((lon - lon0) * sign)
    return rho * F.sin(lam) * sign, rho * F.cos(lam) * -1.0 * sign if sign > 0 else rho * F.cos(lam)


def polar_lonlat(x: Column, y: Column, epsg: int = 3031) -> tuple[Column, Column]:
    """Longitude (-180 to 180) and latitude of polar stereographic metres; series for the latitude."""
    sign, true, lon0 = POLAR[epsg]
    e = math.sqrt(WGS84_E2)
    tc = math.tan(math.pi / 4 - math.radians(true) / 2) / ((1 - e * math.sin(math.radians(true))) / (1 + e * math.sin(math.radians(true)))) ** (e / 2)
    mc = math.cos(math.radians(true)) / math.sqrt(1 - WGS84_E2 * math.sin(math.radians(true)) ** 2)
    chi = math.pi / 2 - 2 * F.atan(F.hypot(x, y) * (tc / (WGS84_A * mc)))
    e2, e4, e6, e8 = (WGS84_E2**k for k in (1, 2, 3, 4))
    terms = (
        (2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360),
        (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520),
        (6, 7 * e6 / 120 + 81 * e8 / 1120),
        (8, 4279 * e8 / 161280),
    )
    phi = reduce(lambda acc, t: acc + t[1] * F.sin(t[0] * chi), terms, chi)
    lon = F.degrees(F.atan2(x * sign, -y if sign > 0 else y)) * sign + lon0
    return wrap_180(lon), F.degrees(phi) * sign


# PRJ-2
def tide_xy_north(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Kilometres of the spherical polar grid that some tide models use."""
    r = (90.0 - lat) * 111.7
    return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon))


def tide_lonlat_north(x: Column, y: Column) -> tuple[Column, Column]:
    lon = F.degrees(F.atan2(y, x))
    return F.when(lon < 0, lon + 360.0).otherwise(lon), 90.0 - F.hypot(x, y) / 111.7


# PRJ-3
def wrap_360(lon: Column) -> Column:
    """Into 0 to 360; positive multiples of 360 stay 360."""
    m = lon - 360.0 * F.floor(lon / 360.0)
    return F.when((m == 0) & (lon > 0), F.lit(360.0)).otherwise(m)


def wrap_180(lon: Column) -> Column:
    """Into -180 to 180; both ends stay as they are."""
    return F.when((lon < -180) | (lon > 180), wrap_360(lon + 180.0) - 180.0).otherwise(lon)


# PRJ-4
def corrected(value: Column, corrections: list[Column], undo: bool = False) -> Column:
    """`value` less its corrections, or with them put back."""
    total = reduce(lambda a, b: a + b, corrections)
    return value + total if undo else value - total


# PRJ-5
#: Laser, bias in metres (fixed values).
LASER_BIAS = {"l1": 0.0, "l2": 0.017, "l3": -0.011}


def laser_bias(campaign: Column) -> Column:
    """Bias of the laser whose name begins the campaign's; 0 for no campaign."""
    laser = F.lower(F.substring(campaign, 1, 2))
    return reduce(lambda acc, kv: acc.when(laser == kv[0], F.lit(kv[1])), list(LASER_BIAS.items())[1:], F.when(laser == "l1", F.lit(0.0))).otherwise(F.lit(0.0))


# PRJ-10
def height_at(h: Column, trend: Column, dt: Column, accel: Column | None = None, amplitude: Column | None = None, phase: Column | None = None) -> Column:
    """Height after `dt` years from a trend, and if given an acceleration and an annual cycle."""
    out = h + trend * dt
    if accel is not None:
        out = out + 0.5 * accel * dt * dt
    if amplitude is not None:
        out = out + amplitude * F.sin(2 * math.pi * dt + phase)
    return out


# PRJ-11
def freeboard(h: Column, msl: Column) -> Column:
    return h - msl


def draft(free: Column) -> Column:
    return free * (RHO_OCEAN / (RHO_OCEAN - RHO_ICE) - 1)


def thickness(free: Column) -> Column:
    return free * (RHO_OCEAN / (RHO_OCEAN - RHO_ICE))


def height_change_corrected(dh: Column, firn: Column, sea_level_trend: Column, t: Column, t_ref: float = 2014.0) -> Column:
    return dh - firn - sea_level_trend * (t - t_ref)


# PRJ-12
def melt_rate(dhdt: Column, div: Column, smb: Column) -> Column:
    return dhdt + div - smb


def steady_melt(div: Column, smb: Column) -> Column:
    return div - smb


def mass_rate(dhdt: Column) -> Column:
    """Gigatonnes a year for a square metre."""
    return dhdt * (RHO_ICE * 1e-12)


# PRJ-13
def thickness_error(err_h: Column, err_firn: Column) -> Column:
    return F.sqrt(err_h * err_h + err_firn * err_firn) * (RHO_OCEAN / (RHO_OCEAN - RHO_ICE))


def root_sum_square(*errors: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [e * e for e in errors]))


def divergence_error(thick: Column, velocity_error: float = 5.0, spacing: float = 3000.0) -> Column:
    return 2 * F.abs(thick) * (velocity_error / spacing)


# PRJ-14
def smb_to_ice_per_year(smb: Column, monthly: bool = False) -> Column:
    """kg/m2 per second-like daily (or monthly) rates to metres of ice a year."""
    return smb * ((12.0 if monthly else 365.2425) * 1000.0 / RHO_ICE)


# PRJ-15
def slope_angle(slope: Column) -> Column:
    return F.degrees(F.atan(slope))


# PRJ-9
def inverse_barometer(pressure: Column, mean_pressure: Column) -> Column:
    """Sea-level response in metres to a departure of the air pressure (Pa) from its mean."""
    return -(pressure - mean_pressure) / (RHO_OCEAN * GRAVITY)


# PRJ-17
def decimal_year(ts: Column) -> Column:
    """Years of 365.25 days since 1970-01-01, plus 1970."""
    return 1970.0 + F.unix_micros(ts.cast("timestamp")) / 1e6 / (YEAR_DAYS * 86400.0)


def calendar_year(ts: Column) -> Column:
    """Year and the fraction of that very year."""
    begin = F.unix_micros(F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.unix_micros(F.make_timestamp(F.year(ts) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.year(ts) + (F.unix_micros(ts.cast("timestamp")) - begin) / (end - begin)


def modified_julian_day(ts: Column) -> Column:
    return 40587.0 + F.unix_micros(ts.cast("timestamp")) / 86400e6


def datenum(ts: Column) -> Column:
    """Days since year 0 as MATLAB counts them."""
    return 719529.0 + F.unix_micros(ts.cast("timestamp")) / 86400e6


def change_epoch(seconds: Column, epoch: str, to: str) -> Column:
    """Seconds since `epoch` (a date) as seconds since `to`."""
    return seconds + F.datediff(F.lit(epoch), F.lit(to)) * 86400.0


#: Dates (fixed values) on which GPS time gained a second on UTC, from its start in 1980.
LEAP_DATES = (
    "1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 "
    "1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01"
).split()


def gps_to_utc(seconds: Column) -> Column:
    """Seconds since 1980-01-06 in GPS time as a UTC timestamp."""
    import datetime as dt

    start = dt.datetime(1980, 1, 6)
    gps = [(dt.datetime.fromisoformat(d) - start).total_seconds() + k for k, d in enumerate(LEAP_DATES)]
    leaps = reduce(lambda acc, g: acc + F.when(seconds > g, 1).otherwise(0), gps, F.lit(0))
    return F.timestamp_micros(((seconds - leaps) * 1e6).cast("long") + int((start - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000)


# PRJ-16, geometric part
def slope_correction(rng: Column, slope: Column, curvature: Column, relocate: bool = False) -> Column:
    """Range change for a slope (radians): direct method, or relocation to the closest point."""
    d = rng * F.sin(slope)
    along = d * d / (2 * curvature)
    return rng - (rng * F.cos(slope) + along) if relocate else rng - (rng / F.cos(slope) + along)


def azimuth(dzdx: Column, dzdy: Column) -> Column:
    """Direction of steepest ascent, degrees clockwise from north."""
    return wrap_360(F.degrees(F.atan2(dzdx, dzdy)))


# 2.N predicates
def overlap(x1: Column, x2: Column, y1: Column, y2: Column) -> Column:
    return (x2 >= y1) & (x1 <= y2)


def boxes_intersect(x1, x2, y1, y2, a1, a2, b1, b2) -> Column:
    return overlap(x1, x2, a1, a2) & overlap(y1, y2, b1, b2)
