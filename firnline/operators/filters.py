"""Row filters: windows, boxes, quality predicates, sampling, blacklists and limits.

Filters keep all columns. A comparison with NULL is not true, so rows that miss a value tested are
dropped by the filters and left alone by the clamps (which only set values to NULL).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def remove_invalid(df: DataFrame, names: list[str], zeros: bool = False) -> DataFrame:
    """Rows whose named values are all present, and not zero if `zeros`."""
    tests = [F.col(n).isNotNull() & ~F.isnan(n) & ((F.col(n) != 0) if zeros else F.lit(True)) for n in names]
    return df.where(reduce(lambda a, b: a & b, tests))


def window(df: DataFrame, **limits: tuple[float, float]) -> DataFrame:
    """Closed limits for each named column."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in limits.items()], F.lit(True)))


def inside(xmin: float, xmax: float, ymin: float, ymax: float, x: str = "x", y: str = "y", closed: bool = True) -> Column:
    if closed:
        return F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax)
    return (F.col(x) > xmin) & (F.col(x) < xmax) & (F.col(y) > ymin) & (F.col(y) < ymax)


def bbox(df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, closed: bool = True) -> DataFrame:
    return df.where(inside(xmin, xmax, ymin, ymax, closed=closed))


def quality(df: DataFrame, predicates: list[str]) -> DataFrame:
    """Rows that meet all predicates (SQL)."""
    return reduce(lambda d, p: d.where(p), predicates, df)


def along_track_consistency(df: DataFrame, track: str, order: list[str], h: str, slope: str, step: float = 20.0, tol: float = 2.0) -> DataFrame:
    """Rows whose height agrees, along their slope, with the rows before and after; short tracks stay whole."""
    w = Window.partitionBy(track).orderBy(*order)
    after = F.abs(F.col(h) + step * F.col(slope) - F.lead(h).over(w))
    before = F.abs(F.lag(h).over(w) - (F.col(h) - step * F.col(slope)))
    worst = F.greatest(F.coalesce(after, F.lit(0.0)), F.coalesce(before, F.lit(0.0)))
    few = F.count("*").over(Window.partitionBy(track)) < 3
    return df.select("*", (few | (worst < tol)).alias("\x01keep")).where("`\x01keep`").drop("\x01keep")


def stride(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Every n-th row of each group, from the first."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.select("*", place.alias("\x01at")).where(F.col("\x01at") % n == 0).drop("\x01at")


def sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A share of the rows, chosen by the hash of their key: the same rows on every run."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def sector(x: Column, y: Column, n: int = 8) -> Column:
    """Which of n equal sectors around the origin, counted from the positive x axis."""
    angle = F.degrees(F.atan2(y, x))
    return F.floor(F.when(angle < 0, angle + 360.0).otherwise(angle) / (360.0 / n)).cast("int") % n


def sample_sectors(df: DataFrame, x: str, y: str, x0: float, y0: float, per_sector: int, seed: int = 0, key: str = "pid", n: int = 8) -> DataFrame:
    """At most `per_sector` rows of each sector around a centre, drawn by hash."""
    placed = df.withColumn("sector", sector(F.col(x) - x0, F.col(y) - y0, n))
    order = Window.partitionBy("sector").orderBy(F.xxhash64(F.lit(seed), key), key)
    return placed.select("*", F.row_number().over(order).alias("\x01at")).where(F.col("\x01at") <= per_sector).drop("\x01at")


def without(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return df.join(listed, on, "left_anti")


def clamp_boxes(df: DataFrame, value: str, boxes: list[tuple[float, float, float, float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Values whose size is over a box's limit, inside that box, become NULL."""
    bad = reduce(lambda a, b: a | b, [inside(x1, x2, y1, y2, x, y) & (F.abs(value) > lim) for x1, x2, y1, y2, lim in boxes], F.lit(False))
    return df.withColumn(value, F.when(~bad, F.col(value)))


def null_around(df: DataFrame, value: str, *spans: tuple[str, float, float]) -> DataFrame:
    """Values inside an open box, given as (column, centre, half width), become NULL."""
    bad = reduce(lambda a, b: a & b, [(F.col(c) > m - d) & (F.col(c) < m + d) for c, m, d in spans])
    return df.withColumn(value, F.when(~bad, F.col(value)))


def limit_abs(df: DataFrame, value: str, most: float, where: Column | None = None) -> DataFrame:
    """Values over a size limit, or in a region, become NULL."""
    bad = F.abs(value) > most
    return df.withColumn(value, F.when(~(bad if where is None else bad | where), F.col(value)))
