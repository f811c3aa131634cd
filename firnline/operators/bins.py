"""Binned and grouped statistics in time and in lag.

Overlapping bins are closed intervals [x0 + k dx, x0 + k dx + window]; a value lies in several. Values
are exploded to their bins by arithmetic, never joined to a table of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .robust import MAD_SCALE

#: Points in a part of a block whose pairs are counted together, and pairs of parts in a task.
BLOCK, PART_PAIRS = 1000, 200

def overlap_bins(df: DataFrame, by: list[str], x: str, x0: float, dx: float, window: float, n_bins: int) -> DataFrame:
    """One row for each bin (column k, 0 .. n_bins - 1) that a value lies in."""
    first = F.greatest(F.lit(0), F.ceil((F.col(x) - window - x0) / dx).cast("int"))
    last = F.least(F.lit(n_bins - 1), F.floor((F.col(x) - x0) / dx).cast("int"))
    return df.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last))))


def binned(df: DataFrame, by: list[str], x: str, value: str, x0: float, x1: float, dx: float, window: float, median: bool = False, clip: float | None = None, robust_error: bool = True, empty: bool = True) -> DataFrame:
    """For each bin: centre xb, yb (mean or median), eb (MAD or standard deviation), nb and sb (sum).

    `clip`: values farther than so many standard deviations from the bin's mean are left out once.
    `empty`: bins without values have their row too, with n 0.
    """
    n = int((x1 - x0) / dx + 1e-9) + (1 if x0 + int((x1 - x0) / dx + 1e-9) * dx < x1 - 1e-9 else 0)
    q = overlap_bins(df.where(F.col(value).isNotNull()), by, x, x0, dx, window, n)
    key = [*by, "k"]
    w = Window.partitionBy(*key)
    if clip is not None:
        q = q.withColumns({"\x01a": F.avg(value).over(w), "\x01s": F.stddev_pop(value).over(w)}).where(F.abs(F.col(value) - F.col("\x01a")) <= clip * F.col("\x01s"))
    q = q.withColumn("\x01m", F.median(value).over(w)) if robust_error or median else q
    middle = F.first("\x01m") if median else F.avg(value)
    error = MAD_SCALE * F.median(F.abs(F.col(value) - F.col("\x01m"))) if robust_error else F.stddev_pop(value)
    out = q.groupBy(*key).agg(middle.alias("yb"), error.alias("eb"), F.count(value).alias("nb"), F.sum(value).alias("sb"))
    if empty:
        grid = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
        grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        out = grid.join(out, key, "left").withColumn("nb", F.coalesce("nb", F.lit(0)))
    return out.withColumn("xb", x0 + F.col("k") * dx + window / 2)


def resampled(df: DataFrame, by: list[str], x: str, value: str, weight: str, x0: float, dx: float, window: float, n_bins: int, n_sigma: float = 3.5) -> DataFrame:
    """Weighted means in bins centred on x0 + k dx, after an edit by n MADs: xi, yi, ei (weighted variance), ni."""
    q = overlap_bins(df, by, x, x0 - window / 2, dx, window, n_bins)
    w = Window.partitionBy(*by, "k")
    q = q.withColumn("\x01m", F.median(value).over(w))
    q = q.withColumn("\x01s", MAD_SCALE * F.median(F.abs(F.col(value) - F.col("\x01m"))).over(w)).where(F.abs(F.col(value) - F.col("\x01m")) <= n_sigma * F.col("\x01s"))
    mean = weighted_mean(value, weight)
    q = q.withColumn("\x01a", F.try_divide(F.sum(F.col(weight) * F.col(value)).over(w), F.sum(weight).over(w)))
    var = F.try_divide(F.sum(F.col(weight) * (F.col(value) - F.col("\x01a")) ** 2), F.sum(weight))
    return q.groupBy(*by, "k").agg(mean.alias("yi"), var.alias("ei"), F.count("*").alias("ni")).withColumn("xi", x0 + F.col("k") * dx)


def weighted_mean(value: str, weight: str):
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))


def weighted_variance(value: str, weight: str):
    s, s1, s2 = F.sum(weight), F.sum(F.col(weight) * F.col(value)), F.sum(F.col(weight) * F.col(value) * F.col(value))
    return F.try_divide(s2, s) - F.pow(F.try_divide(s1, s), F.lit(2))


def summary(df: DataFrame, by: list[str], value: str, t: str) -> DataFrame:
    """Median, mean, std, extremes, count of the values, and the span of time, of each group."""
    return df.groupBy(*by).agg(F.median(value).alias("med"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), (F.max(t) - F.min(t)).alias("span"))


def correlations(df: DataFrame, by: list[str], h: str, params: list[str]) -> DataFrame:
    """Pearson correlation and slope of `h` with each parameter, over rows that have them all."""
    full = df.dropna(subset=[h, *params])
    stats = [s for p in params for s in (F.corr(h, p).alias(f"r_{p}"), F.regr_slope(h, p).alias(f"s_{p}"))]
    return full.groupBy(*by).agg(*stats)


def lag_covariance(pairs: DataFrame, zl: str, zr: str, dist: str, step: float, at_least: int = 15, by: list[str] = ()) -> DataFrame:
    """Mean product for each distance class k = floor(dist / step), centred at (k + 1/2) step."""
    out = pairs.groupBy(*by, F.floor(F.col(dist) / step).alias("k")).agg(F.avg(F.col(zl) * F.col(zr)).alias("cov"), F.count("*").alias("n"))
    return out.where(F.col("n") >= at_least).withColumn("lag", (F.col("k") + 0.5) * step)


def binned_products(df: DataFrame, key: str, value: str, most: float, step: float, at_least: int = 15, x: str = "x", y: str = "y") -> DataFrame:
    """`lag_covariance` of all pairs at most `most` apart, counted in the tasks: k, cov, n and lag; no row is made for a pair.

    Points go to square blocks half as wide as `most`, parts of at most about BLOCK points; each part meets those of its
    own and of the blocks around, a pair of parts in one row. In a task a slab of distances is all that is held.
    Every pair counts once; rows without a place or key have no pairs. Time grows with the pairs, memory does not.
    """
    import pyarrow as pa

    from .layout import cut

    size = most / 2
    rows = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.col(value).isNotNull().cast("int").alias("has"))
    rows = rows.dropna().where(~F.isnan("x") & ~F.isnan("y")).withColumns({"i": F.floor(F.col("x") / size), "j": F.floor(F.col("y") / size)})
    rows = rows.join(rows.groupBy("i", "j").agg(F.ceil(F.count("*") / BLOCK).alias("of")), ["i", "j"])
    parts = cut(rows.groupBy("i", "j", F.pmod(F.xxhash64("k"), "of").alias("part")).agg(F.collect_list(F.struct("k", "x", "y", "v", "has")).alias("points")))
    around = F.sequence(F.lit(-3), F.lit(3))
    probe = parts.select("i", "j", "part", F.col("points").alias("here"), F.explode(around).alias("di")).withColumn("dj", F.explode(around))
    probe = probe.select("i", "j", "part", "here", (F.col("i") + F.col("di")).alias("oi"), (F.col("j") + F.col("dj")).alias("oj"))
    there = parts.select(F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("part").alias("opart"), F.col("points").alias("there"))
    pairs = probe.join(there, ["oi", "oj"]).where(F.struct("i", "j", "part") <= F.struct(F.col("oi").alias("i"), F.col("oj").alias("j"), F.col("opart").alias("part")))
    same = (F.col("i") == F.col("oi")) & (F.col("j") == F.col("oj")) & (F.col("part") == F.col("opart"))
    n_bins = int(most / step) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, n, valid = np.zeros(n_bins), np.zeros(n_bins, np.int64), np.zeros(n_bins, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = ([batch.column(c)[r].values.field(f).to_numpy() for f in ("k", "x", "y", "v", "has")] for c in (0, 1))
                one = batch.column(2)[r].as_py()
                slab = max(1, 250_000 // len(b[0]))
                for s in range(0, len(a[0]), slab):
                    k, px, py, v, has = (c[s : s + slab, None] for c in a)
                    d2 = (px - b[1]) ** 2 + (py - b[2]) ** 2
                    ok = d2 <= most * most
                    ok &= (k < b[0]) if one else (k != b[0])
                    at = np.floor(np.sqrt(d2[ok]) / step).astype(np.int64)
                    n += np.bincount(at, minlength=n_bins)
                    here = (has * b[4])[ok] == 1
                    valid += np.bincount(at[here], minlength=n_bins)
                    total += np.bincount(at[here], (v * b[3])[ok][here], n_bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_bins)), pa.array(total), pa.array(n), pa.array(valid)], names=["k", "total", "n", "valid"])

    spread = pairs.select("here", "there", same.alias("same")).repartition(max(8, -(-(parts.count() ** 2) // (2 * PART_PAIRS))))
    out = spread.mapInArrow(count, "k long, total double, n long, valid long").groupBy("k").agg(F.try_divide(F.sum("total"), F.sum("valid")).alias("cov"), F.sum("n").alias("n"))
    return out.where(F.col("n") >= at_least).withColumn("lag", (F.col("k") + 0.5) * step)


def autocovariance(df: DataFrame, by: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """Sum of products of a centred series with itself at lags 0 .. most rows, over its sum of squares, times its variance."""
    from functools import reduce

    w = Window.partitionBy(*by)
    o = w.orderBy(*order)
    q = df.withColumns({"\x01z": F.col(value) - F.avg(value).over(w), "\x01v": F.var_pop(value).over(w)})
    q = q.withColumns({f"\x01p{k}": F.col("\x01z") * F.lead("\x01z", k).over(o) for k in range(most + 1)})
    products = [F.struct(F.lit(k).alias("lag"), F.col(f"\x01p{k}").alias("p")) for k in range(most + 1)]
    long = q.select(*by, "\x01v", F.explode(F.array(*products)).alias("\x01p")).select(*by, "\x01v", "\x01p.*")
    sums = long.groupBy(*by, "lag").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("\x01s"), F.first("\x01v").alias("\x01v"))
    zero = sums.where("lag = 0").select(*by, F.col("\x01s").alias("\x01s0"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"\x01{c}") for c in by])
    zero = zero.select(*[F.col(c).alias(f"\x01{c}") for c in by], "\x01s0")
    return sums.join(zero, on).select(*by, "lag", (F.try_divide("\x01s", "\x01s0") * F.col("\x01v")).alias("cov"))


def bias(a: DataFrame, b: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Median of b - a on common epochs; without any, first of b less last of a."""
    common = a.select(*by, t, F.col(value).alias("\x01a")).join(b.select(*by, t, F.col(value).alias("\x01b")), [*by, t]).groupBy(*by).agg(F.median(F.col("\x01b") - F.col("\x01a")).alias("\x01d"))
    ends = a.groupBy(*by).agg(F.max_by(value, t).alias("\x01last")).join(b.groupBy(*by).agg(F.min_by(value, t).alias("\x01first")), by)
    return ends.join(common, by, "left").select(*by, F.coalesce("\x01d", F.col("\x01first") - F.col("\x01last")).alias("bias"))
